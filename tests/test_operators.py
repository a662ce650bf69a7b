"""Operators on small frames with results worked out by hand."""

import datetime as dt
import json
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.functions import figures, stats, text
from kelpie.operators import chunking, evalruns, facts, grading, html, retrieval, sampling
from kelpie.sources import sinks, tables
from kelpie.streaming import incremental


def entry(fy, val, end, accn, start=None, form="10-K"):
    return {"fy": fy, "fp": "FY", "form": form, "val": val, "start": start, "end": end, "accn": accn}


def test_company_facts(spark):
    revenue = [
        entry(2023, 100, "2022-12-31", "0002", "2022-01-01"),
        entry(2023, 110, "2023-12-31", "0002", "2023-01-01"),
        entry(2022, 101, "2022-12-31", "0001", "2022-01-01"),
        entry(2023, 30, "2023-03-31", "0002", "2023-01-01"),
        entry(2023, 7, "2023-12-31", "0003", "2023-01-01", "8-K"),
    ]
    assets = [entry(2023, 900, "2023-12-31", "0002"), entry(2023, 800, "2023-06-30", "0002")]
    j = json.dumps({"facts": {"us-gaap": {"Revenues": {"units": {"USD": revenue}}, "Assets": {"units": {"USD": assets}}, "Other": {"units": {"USD": assets}}}}})
    raw = spark.createDataFrame([("1", j)], "cik string, json string")
    kept = facts.annual(facts.exploded(raw), ["10-K"]).withColumnRenamed("val", "value")
    won = facts.earliest(kept, [*facts.SERIES, "fiscal_year"])
    out = {(r["tag"], r["fiscal_year"]): (int(r["value"]), r["accession"], r["prior_year_value"]) for r in facts.prior_as_printed(won, kept).collect()}
    assert out == {("Revenues", 2022): (101, "0001", None), ("Revenues", 2023): (110, "0002", Decimal("100.000000")), ("Assets", 2023): (900, "0002", None)}


def test_earliest_keeps_a_first_arrival_without_accession(spark):
    df = spark.createDataFrame([("a", None, 1, 10), ("a", "1", 2, 20), ("b", "2", 1, 30), ("b", None, 2, 40), ("b", "1", 3, 50)], "k string, accession string, ord int, value int")
    assert {r["k"]: r["value"] for r in facts.earliest(df, ["k"]).collect()} == {"a": 10, "b": 50}


def test_fiscal_year(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 3), 9), (dt.date(2024, 1, 8), 9), (None, 2021)], "d date, fy int")
    assert [r[0] for r in df.select(figures.fiscal_year_of(F.col("d"), F.col("fy"))).collect()] == [2023, 2024, 2021]


def test_misdated_scales_with_the_gap(spark):
    rows = [("1", "x", "T", "USD", y, dt.date(y, 12, 31)) for y in (2019, 2020, 2022)] + [("1", "x", "T", "USD", 2023, dt.date(2023, 6, 30))]
    df = spark.createDataFrame(rows, "cik string, taxonomy string, tag string, unit string, fiscal_year int, period_end date")
    assert [(r["fiscal_year"], r["next_year"]) for r in facts.misdated(df).collect()] == [(2022, 2023)]


def test_fusion_breaks_ties_by_text(spark):
    a = spark.createDataFrame([(1, 62001, 1)], "query_id int, id long, rank int")
    b = spark.createDataFrame([(1, 57400, 1)], "query_id int, id long, rank int")
    assert [r["id"] for r in retrieval.fuse([a, b]).orderBy("rank").collect()] == [57400, 62001]
    with pytest.raises(ValueError):
        retrieval.hybrid(a, b, 8, mode="none")


def test_ir_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, id string, rank int")
    rel = spark.createDataFrame([(1, "b", 1.0), (1, "z", 1.0)], "query_id int, id string, gain double")
    out = {r["query_id"]: r.asDict() for r in retrieval.ir_metrics(ranked, rel, spark.createDataFrame([(1,), (2,)], "query_id int"), (1, 5)).collect()}
    assert out[1]["rr"] == 0.5 and out[1]["hit@1"] == 0 and out[1]["recall@5"] == 0.5 and out[1]["precision@5"] == pytest.approx(1 / 3)
    assert out[1]["ndcg@5"] == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)))
    assert set(out[2].values()) == {2, 0.0}


def test_packing(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 20), (1, 3, 4)], "query_id int, rank int, chars long")
    assert [r["included"] for r in retrieval.pack_greedy(df, 10).orderBy("rank").collect()] == [True, False, False]
    assert [r["included"] for r in retrieval.pack_skipping(df, 10).orderBy("rank").collect()] == [True, False, True]


@pytest.mark.parametrize("target", [8, 32])
def test_chunks_never_pass_the_ceiling(target):
    rng = np.random.default_rng(0)
    for _ in range(30):
        t = "".join(rng.choice(list("abc .!\n\n\t")) for _ in range(int(rng.integers(0, 2000))))
        for chunks in (chunking.recursive(t, target, 2), chunking.semantic(t, target=target)):
            assert all(0 < len(c) <= 4 * target for c in chunks)
            assert "".join("".join(chunks).split()) .count("a") >= t.count("a")
        parts = chunking.section_aware([{"id": 1, "item": "7", "title": "Discussion", "body": t}], target, 2)
        assert all(len(p["body"]) <= 4 * target for p in parts)


def test_fixed_chunks(spark):
    df = spark.createDataFrame([(1, "x" * 100), (2, ""), (3, None), (4, " " * 50)], "id int, text string")
    out = [(r["id"], r["ordinal"], len(r["body"])) for r in chunking.fixed(df, "text", 10, 2).orderBy("id", "ordinal").collect()]
    assert out == [(1, 0, 40), (1, 1, 40), (1, 2, 36)]


def test_balanced_pieces():
    assert [len(p) for p in chunking.pieces("x" * 2100, 2048)] == [1050, 1050]


def test_hashing_vectors():
    v = chunking.hashing_vectors(["", "a b", "b a"])
    assert v[0][0] == 1 and np.allclose(v[1], v[2]) and np.allclose(np.linalg.norm(v, axis=1), 1)


def test_html():
    page = "<html><head><meta charset=u><title>x</title></head><body><p>One</p><table><tr><td>Net sales</td><td> 383,285 </td></tr></table><script>no</script>two<br>three</body></html>"
    assert html.to_text(page) == "One\nNet sales | 383,285\ntwo\nthree"


def test_parse_health(spark):
    heads = ["Item 1. Business", "Item 1A. Risk Factors", "Item 7. Management's Discussion", "Item 8. Financial Statements"]
    whole = "\n".join(h + "\n" + "words 1,234 " * 500 for h in heads)
    contents = "\n".join(heads) + "\n" + "words " * 5000
    rows = spark.createDataFrame([(1, whole), (2, contents), (3, "nothing"), (4, None)], "filing int, body string")
    got = {r["filing"]: (r["spread"], r["survived"], r["ordered"], r["long_enough"], r["has_items"]) for r in html.health(rows, ["filing"]).collect()}
    assert got == {1: (True, True, True, True, True), 2: (False, True, True, True, True), 3: (False, True, True, False, False), 4: (False, True, True, False, False)}


def test_sections_prefer_the_body_over_the_contents():
    toc = "Item 1. Business\nItem 1A. Risk Factors\n"
    body = "Item 1. Business\n" + "we sell things " * 30 + "\nItem 1A. Risk Factors\n" + "risks " * 50
    got = html.sections(toc + body)
    assert [s[0] for s in got] == ["1", "1A"] and got[0][2].startswith("Item 1. Business\nwe sell")
    assert html.sections("nothing") == [(None, "Full Document", "nothing")]


@pytest.mark.parametrize(
    "said, value",
    [
        ("$383.29 billion", 383.29e9), ("The R&D expense in FY2025 was $2,148 million", 2148e6), ("about 2,025", 2025.0), ("December 31, 2024", 31.0),
        ("nothing", None), ("12 %", 12.0), ("(in thousands) 5k", 5000.0),
    ],
)
def test_parse_number(said, value):
    assert grading.parse_number(said) == value


def test_graders():
    assert grading.grade_numeric(383285e6, "USD", "It was $383.285 billion")[0]
    assert grading.grade_numeric(383285e6, "USD", "383,285")[0]
    assert not grading.grade_numeric(5.0, "USD", "The filing does not state it")[0]
    assert grading.grade_numeric(-3.4, "percent", "a decrease of 3.4 percent, from 5 to 4")[0]
    assert not grading.grade_numeric(-3.4, "percent", "an increase of 3.4%")[0]
    notes = "FY2023=2,108,000,000, FY2024=2,107,000,000"
    told = "FY2024 was $2,107 million, a decrease from $2,108 million in FY2023"
    assert grading.grade_numeric(-0.05, "percent", told, notes)[0]
    assert not grading.grade_numeric(-0.05, "percent", told.replace("decrease", "increase"), notes)[0]


def test_grading_udf(spark):
    df = spark.createDataFrame([(5.0, "USD", "5", None), (None, None, None, None)], "expected_value double, unit string, answer string, notes string")
    assert [r["verdict"]["passed"] for r in grading.graded(df).collect()] == [True, False]


def test_kappa_and_vote(spark):
    df = spark.createDataFrame([(True, True)] * 3 + [(False, False)] * 3 + [(True, None)], "t boolean, s boolean")
    row = stats.confusion(df, [], F.col("t"), F.col("s")).first()
    assert row["kappa"] == 1.0 and row["errors"] == 1 and row["balanced_accuracy"] == 1.0
    runs = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("c", None)], "k string, verdict boolean")
    assert {r["k"]: (r["passed"], r["unstable"]) for r in evalruns.majority(runs, ["k"]).collect()} == {"a": (False, True), "b": (True, False)}


def test_extraction_score(spark):
    ddl = "case_id string, concept string, fiscal_year int, value double, ord int"
    p = spark.createDataFrame([("a", "x", 1, 5.0, 1), ("a", "x", 1, 9.0, 2), ("a", "y", 1, 1.0, 3)], ddl)
    e = spark.createDataFrame([("a", "x", 1, 5000.0, 1)], ddl)
    row = evalruns.score_extraction(p, e).first()
    assert (row["tp"], row["n_predicted"], row["precision"], row["recall"]) == (1, 2, 0.5, 1.0)


def test_text_functions(spark):
    df = spark.createDataFrame([("Revenue was 1,234,567 and 42 in 2023", "we had 1,234.567")], "a string, s string")
    row = df.select(text.ungrounded(F.col("a"), F.col("s")).alias("u"), text.or_query(F.col("a")).alias("q")).first()
    assert row["u"] == [] and row["q"] == "revenue | was | 234 | 567 | and | 42 | in | 2023"


def test_samples_are_nested(spark):
    df = spark.range(50)
    small, large = ({r["id"] for r in sampling.superset_stable(df, "id", n, "s").collect()} for n in (5, 20))
    assert small < large
    rows = [{"case_id": f"c{i}", "kind": "k" if i % 2 else "l", "ticker": f"t{i % 3}"} for i in range(6)]
    assert len({r["kind"] for r in sampling.diverse_order(rows, 2)}) == 2


def test_filing_index(spark):
    block = json.dumps({"accessionNumber": ["a", "b", "c"], "form": ["10-K", "8-K", "10-K"], "filingDate": ["2024-01-01", "", "2023-01-01"], "reportDate": ["", "", "2022-12-31"], "primaryDocument": ["x", "y", "z"]})
    raw = spark.createDataFrame([("1", 0, block)], "cik string, page int, json string")
    assert [(r["accession"], r["period_end"]) for r in tables.filing_rows(raw, ["10-K"], 1).collect()] == [("a", None)]


def test_publish_is_one_step(spark, tmp_path):
    root = f"file://{tmp_path}"
    first = sinks.publish(spark, root, {"a": spark.range(3), "b": spark.range(2)}, {})
    assert spark.read.parquet(first["a"]).count() == 3
    sinks.publish(spark, root, {"a": spark.range(5)}, first)
    now = sinks.live(spark, root)
    assert spark.read.parquet(now["a"]).count() == 5 and now["b"] == first["b"]
    with pytest.raises(RuntimeError):
        sinks.publish(spark, root, {"a": spark.range(1)}, first)


def test_upsert(spark):
    old = spark.createDataFrame([("1", "A", "s1"), ("2", "B", None)], "cik string, name string, sic string")
    new = spark.createDataFrame([("1", "A2", None), ("3", "C", "s3")], "cik string, name string, sic string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["cik"], keep_old=("sic",)).collect())) == [("1", "A2", "s1"), ("2", "B", None), ("3", "C", "s3")]


def test_refresh_takes_each_file_once(spark, tmp_path):
    seen = []
    spark.range(3).write.parquet(f"{tmp_path}/in/1")
    go = lambda: incremental.refresh(spark, f"{tmp_path}/in/*", "id long", f"{tmp_path}/check", lambda df, i: seen.append(df.count()))
    go()
    go()
    spark.range(5).write.parquet(f"{tmp_path}/in/2")
    go()
    assert sum(seen) == 8


def test_rate_limit(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 2.0), ("a", 61.0), ("b", 0.0)], "ip string, t double")
    out = {(r["ip"], r["t"]): r["allowed"] for r in incremental.rate_limited(df, "ip", "t", 2).collect()}
    assert out == {("a", 0.0): True, ("a", 1.0): True, ("a", 2.0): False, ("a", 61.0): True, ("b", 0.0): True}


# ---- searches


def test_dense_search_is_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vs = {f"v{i:03d}": [float(x) for x in rng.integers(-3, 4, 3 if i % 4 else 2)] for i in range(150)}
    vs |= {"nan": [float("nan"), 1.0, 1.0], "zero": [0.0, 0.0, 0.0], "none": None, "null": [None, 1.0, 2.0]}
    df = spark.createDataFrame(list(vs.items()), "vec_id string, embedding array<float>").repartition(3)
    asked = [(i, [float(x) for x in rng.integers(-3, 4, 2 + i % 2)]) for i in range(9)]
    want = {}
    for q, v in asked:
        rows = []
        for name, x in vs.items():
            if x is not None and len(x) == len(v) and None not in x and not any(np.isnan(x)):
                norm = np.linalg.norm(x) * np.linalg.norm(v)
                cos = float(np.dot(x, v)) / norm if norm else 0.0
                rows.append((-int(np.sign(cos) * np.floor(abs(cos) * 1e6 + 0.5)), name))
        want[q] = [n for _, n in sorted(rows)[:7]]
    for most in (4096, 4):  # in one pass, and in several
        monkeypatch.setattr(retrieval, "MOST_QUERIES", most)
        got = {}
        for r in retrieval.dense_search(spark.createDataFrame(asked, "query_id long, query_vector array<double>"), df, 7).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == want


def test_text_search_is_index_search(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, int(rng.integers(0, 40))))) for i in range(80)] + [(99, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choice(words, 4))) for i in range(6)] + [(9, "")], "query_id long, query_text string")
    index = retrieval.lexical_search(asked, retrieval.postings(docs), 5)
    texts = retrieval.search_texts(asked, docs, 5, overlap=True)
    key = ["query_id", "id", "score", "rank"]
    assert sorted(map(tuple, index.select(key).collect())) == sorted(map(tuple, texts.select(key).collect()))
    joined = texts.drop("overlap").join(docs.withColumnRenamed("doc_id", "id"), "id").join(asked, "query_id")
    slow = {(r["query_id"], r["id"]): r["overlap"] for r in retrieval.with_overlap(joined).collect()}
    assert slow == {(r["query_id"], r["id"]): r["overlap"] for r in retrieval.overlaps(texts.select("query_id", "id"), asked, docs).collect()}
    assert slow == {(r["query_id"], r["id"]): pytest.approx(r["overlap"]) for r in texts.collect()}


def test_english_search_is_cover_density(spark):
    from kelpie.functions import stem

    texts = {1: "Revenues rose. The revenue of operations was rising", 2: "operating revenue", 3: "the of and", 4: None, 5: "net " * 300}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "what was the operating revenue"), (2, "net")], "query_id long, query_text string")
    got = {(r["query_id"], r["id"]): r["score"] for r in retrieval.search_texts(asked, docs, 5, english=True).collect()}
    assert got == {(1, 1): 3, (1, 2): 2, (2, 5): 255}
    assert all(s == round(10 * stem.cover_density(texts[i], ["what", "was", "the", "operating", "revenue"] if q == 1 else ["net"])) for (q, i), s in got.items())


@pytest.mark.parametrize("word, root", [p.split(":") for p in "consistency:consist conspirators:conspir knives:knive generation:generat hopping:hop hoping:hope agreed:agre national:nation cries:cri ties:tie luxuriating:luxuri say:say proceeding:proceed possibly:possibl analogously:analog".split()])
def test_stems(word, root):
    from kelpie.functions.stem import stem

    assert stem(word) == root


def test_ranked_values_of_groups(spark):
    rows = [(g, int(v)) for g in ("a", None) for v in np.random.default_rng(3).integers(0, 9, 37)] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {r["g"]: (r["p95"], r["mid"]) for r in stats.ranked(df, ["g"], "v", p95=stats.capped(0.95), mid=stats.inner(0.5)).collect()}
    xs = sorted(v for g, v in rows if g == "a")
    assert got["a"] == got[None] == (xs[min(36, int(0.95 * 37))], xs[18]) and "b" not in got
    joined = stats.same_keys(df.groupBy("g").count(), stats.ranked(df, ["g"], "v", p=stats.capped(0.5)), ["g"]).collect()
    assert len(joined) == 3 and {r["g"] for r in joined if r["p"] is not None} == {"a", None}


def test_bootstrap_draws_equal_values_apart(spark):
    same = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "case_id long, a int, b int")
    row = stats.paired_bootstrap(same, "case_id", "a", "b", 400).first()
    assert row["n"] == 40 and row["delta"] == 0.5 and 0.3 < row["low"] < 0.45 and 0.55 < row["high"] < 0.7


def test_tables_within_cells_and_left_out_ends():
    page = "<table><tr><td>a<table><tr><td>b</td><td>c</td></tr></table>d</td><td>e</td></tr></table>f"
    assert html.to_text(page) == "a b | c d | e\nf"
    assert html.to_text("<table><tr><td>a<td>b<tr><th>c<td> </table>after<p>x<br/>y<td>z") == "a | b\nc\nafter\nx\ny\nz"
    assert html.to_text("<head><style>s</style></head><p>a&nbsp;b<script>x<p>y</script> c") == "a b c" and html.to_text("") == ""
