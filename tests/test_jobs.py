"""Jobs, training examples, context accounts, checks of a refresh, and the function surface, on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from kelpie import api, jobs, schemas
from kelpie.operators import context, golden, training
from kelpie.sources import fetching, sinks

PAGE = "<html><body><p>Item 1. Business</p><p>{a}</p><p>Item 1A. Risk Factors</p><p>{b}</p></body></html>"


def raw(spark):
    block = lambda *rows: json.dumps(dict(zip(("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument"), map(list, zip(*rows)))))
    companies = spark.createDataFrame([("1", "AA", "Alfa"), ("2", "BB", "Beta"), ("3", "CC", "Gamma")], "cik string, ticker string, title string")
    submissions = spark.createDataFrame(
        [("1", 0, block(("a1", "10-K", "2024-02-01", "2023-12-31", "d.htm"), ("a2", "8-K", "2024-01-01", "", "e.htm"))), ("2", 0, block(("b1", "10-K", "2024-03-01", "2024-01-03", "d.htm"))), ("3", 0, "no json")],
        "cik string, page int, json string",
    )
    pages = spark.createDataFrame([("a1", PAGE.format(a="We sell. " * 30, b="Risks. " * 30)), ("b1", " ")], "accession string, html string")
    entry = lambda fy, val, start, end, accn: {"fy": fy, "fp": "FY", "form": "10-K", "val": val, "start": start, "end": end, "accn": accn}
    some = {"us-gaap": {"Revenues": {"units": {"USD": [entry(2023, 10, "2023-01-01", "2023-12-31", "a1"), entry(2023, 8, "2022-01-01", "2022-12-31", "a1"), entry(2023, 9, "2023-01-01", "2023-12-31", "a9")]}}}}
    facts = spark.createDataFrame([("1", json.dumps({"facts": some})), ("2", json.dumps({"facts": {}}))], "cik string, json string")
    return companies, submissions, pages, facts


def empty(spark, name, like):
    return spark.createDataFrame([], schemas.schema(name)).select(*like.columns)


def test_ingest_goes_on_past_errors(spark):
    new = jobs.ingested(*raw(spark), ["10-K"], 5)
    assert sorted((r["cik"], r["accession"], r["fiscal_year"]) for r in new["filings"].collect()) == [("1", "a1", 2023), ("2", "b1", 2023)]
    assert [(r["item"], r["ordinal"]) for r in new["sections"].orderBy("ordinal").collect()] == [("1", 0), ("1A", 1)]
    facts = {r["fiscal_year"]: (int(r["value"]), r["accession"], r["prior_year_value"] and int(r["prior_year_value"])) for r in new["xbrl_facts"].collect()}
    assert facts == {2023: (10, "a1", 8), 2022: (8, "a1", None)}
    assert sorted(map(tuple, new["errors"].collect())) == [("2", "empty document"), ("2", "no facts"), ("3", "unreadable index")]
    again = jobs.ingested(*raw(spark), ["10-K"], 5)
    assert {r["id"] for r in again["filings"].collect()} == {r["id"] for r in new["filings"].collect()}
    held = {n: empty(spark, n, new[n]) for n in ("filings", "sections", "xbrl_facts")} | {"companies": spark.createDataFrame([("1", "OLD", "Old", "7372")], "cik string, ticker string, name string, sic string")}
    out = jobs.merged(held, new)
    assert {(r["cik"], r["ticker"], r["sic"]) for r in out["companies"].collect()} == {("1", "AA", "7372"), ("2", "BB", None), ("3", "CC", None)}
    twice = jobs.merged(out, new)
    assert all(twice[n].count() == new[n].count() for n in new if n != "errors")


def test_facts_are_derived_again_for_known_companies_only(spark):
    companies, _, _, facts = raw(spark)
    first = jobs.derived_facts(__import__("kelpie.operators.facts", fromlist=["x"]).exploded(facts), ["10-K"])
    stale = first.withColumn("value", F.lit(1).cast("decimal(38,6)")).unionByName(first.withColumn("cik", F.lit("9")))
    held = {"companies": companies.filter("cik = '1'"), "xbrl_facts": stale}
    got = jobs.refreshed_facts(held, facts, ["10-K"])
    assert sorted((r["cik"], r["fiscal_year"], int(r["value"])) for r in got.collect()) == [("1", 2022, 8), ("1", 2023, 10), ("9", 2022, 8), ("9", 2023, 10)]


def test_index_builds(spark, tmp_path):
    sections = spark.createDataFrame([(1, 10, 0, "1", "Business", "alpha " * 60), (1, 11, 1, None, None, "beta. " * 60), (2, 20, 0, "7", "MD&A", "gamma " * 10)], "filing_id long, id long, ordinal int, item string, title string, body string")
    built = {s: jobs.built_chunks(sections, s, 32, 4) for s in ("fixed", "recursive", "semantic", "section_aware")}
    for s, df in built.items():
        rows = df.orderBy("filing_id", "ordinal").collect()
        assert {r["strategy"] for r in rows} == {s} and {r["filing_id"] for r in rows} == {1, 2} and all(len(r["body"]) <= 128 for r in rows)
        assert all((r["section_id"] is not None) == (s == "section_aware") for r in rows) and len({r["id"] for r in rows}) == len(rows)
    assert jobs.built_chunks(sections, "fixed", 32, 4, "fixed-32").first()["strategy"] == "fixed-32"
    for label in ("recursive", " x"):
        with pytest.raises(ValueError):
            jobs.built_chunks(sections, "fixed", label=label)
    assert jobs.replacement_problem(["fixed"], "fixed", built["fixed"]) and not jobs.replacement_problem(["fixed"], "fixed", built["fixed"], replace=True)
    assert not jobs.replacement_problem(["fixed"], "fixed", built["recursive"])
    none = F.lit(None).cast("array<float>")
    whole = built["fixed"].withColumn("embedding", none).unionByName(built["recursive"].withColumn("embedding", none))
    half = jobs.embedded_pending(whole.filter("strategy = 'fixed'")).unionByName(whole.filter("strategy = 'recursive'"))
    done = jobs.embedded_pending(half)
    assert done.filter("embedding IS NULL").isEmpty() and done.count() == whole.count()
    path = f"file://{tmp_path}/index"
    jobs.write_index(done, path)
    jobs.write_index(done.filter("strategy = 'fixed'").limit(1), path)
    held = {r["strategy"]: r["count"] for r in spark.read.parquet(path).groupBy("strategy").count().collect()}
    assert held == {"fixed": 1, "recursive": built["recursive"].count()}
    fresh = built["fixed"].filter("ordinal = 0").withColumn("body", F.lit("new"))
    after = jobs.index_rows(built["fixed"].unionByName(built["semantic"]), fresh.unionByName(fresh))
    assert {r["strategy"]: r["count"] for r in after.groupBy("strategy").count().collect()} == {"fixed": 2, "semantic": built["semantic"].count()}


def test_staging_and_logs(spark, tmp_path):
    root = f"file://{tmp_path}"
    live = sinks.publish(spark, root, {"a": spark.range(3)})
    assert jobs.staged(spark, live, f"{root}/stage", ["a"]) == {"a": 3}
    with pytest.raises(RuntimeError):
        jobs.staged(spark, live, f"{root}/stage", ["a"])
    assert jobs.logged(spark, f"{root}/log", spark.range(2)) and jobs.logged(spark, f"{root}/log", spark.range(1))
    assert spark.read.parquet(f"{root}/log").count() == 3
    assert not jobs.logged(spark, "nowhere://x", spark.range(1), strict=False)
    with pytest.raises(Exception):  # noqa: B017
        jobs.logged(spark, "nowhere://x", spark.range(1))


def test_pace_and_retries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = fetching.Pace(4.0, lambda: now[0], sleep)
    for _ in range(3):
        pace.wait()
    assert slept == [0.25, 0.25]
    tries, waits = [], []

    def call(x):
        tries.append(x)
        if len(tries) < 3:
            raise ConnectionError
        return x

    assert fetching.retrying(call, (ConnectionError,), jitter=0, sleep=waits.append)(7) == 7 and waits == [1.0, 2.0]
    with pytest.raises(KeyError):
        fetching.retrying(lambda: {}[1], (KeyError,), attempts=2, jitter=0, sleep=waits.append)()
    with pytest.raises(ZeroDivisionError):
        fetching.retrying(lambda: 1 / 0, (KeyError,), sleep=waits.append)()


FACT = "struct<concept:string,fiscal_year:int,value:double>"


def test_examples_split_and_manifest(spark):
    ddl = "filing_id long, cik string, ticker string, sector string, accession string, fiscal_year int, ordinal int, id long, item string, title string, body string"
    rows = []
    for i in range(8):
        rows.append((i, f"c{i}", f"T{i}", "s" if i < 5 else "t", f"acc{i}", 2023, 0, 10 * i, "8", "Statements", f"Total assets | 352,58{i}\n" + "Other | 1,111 | 2,222 | 3,333"))
        rows.append((i, f"c{i}", f"T{i}", "s" if i < 5 else "t", f"acc{i}", 2023, 1, 10 * i + 1, "7", "Talk", "nothing but words here " * 3 + "1,111 2,222 3,333 "))
    facts = spark.createDataFrame([(f"c{i}", "Assets", 2023, (352580 + i) * 1e6, None) for i in range(8)], "cik string, tag string, fiscal_year int, value double, prior_year_value double")
    found = training.examples(spark.createDataFrame(rows, ddl), facts)
    assert {r["state"]: r["count"] for r in found.groupBy("state").count().collect()} == {"positive": 8, "candidate": 8}
    data = training.dataset(found, 1.0)
    sides = {r["held_out"]: r for r in training.manifest(data).collect()}
    assert sides[True]["companies"] == 2 and sides[False]["companies"] == 6
    assert sides[False]["positives"] == 6 and sides[False]["negatives"] == 6 and sides[False]["facts"] == 6
    digest = {r["held_out"]: r["digest"] for r in training.manifest(data.repartition(5)).collect()}
    assert digest == {k: r["digest"] for k, r in sides.items()} and len(set(digest.values())) == 2
    by_sector = {r["sector"]: r for r in training.sides_by_sector(data).collect()}
    assert all(len(r["held_out"]) == 1 and not set(r["train"]) & set(r["held_out"]) for r in by_sector.values())
    sample = training.audit_sample(data, 3, 2).collect()
    assert sorted((r["kind"], r["n"]) for r in sample) == [("label", 1), ("label", 2), ("label", 3), ("negative", 1), ("negative", 2)]
    made = training.prompts(data.filter("size(labels) > 0"), "Extract.").first()
    assert made["prompt"].startswith("Extract.\n\n[8 Statements]") and json.loads(made["completion"])[0]["concept"] == "total assets"


def test_shots_add_concepts_from_other_companies(spark):
    f = lambda c: (c, 2023, 1.0)
    rows = [("a", "T1", "x", [f("p"), f("q")]), ("b", "T1", "x", [f("r"), f("s")]), ("c", "T2", "x", [f("p"), f("q")]), ("d", "T3", "x", [f("q"), f("r")]), ("e", "T4", "1,000 2,000 3,000", []), ("g", "T1", "1,000 2,000 3,000", []), ("h", "T5", "x" * 2000, [f("z"), f("y")])]
    out = training.shots(spark.createDataFrame(rows, f"passage_id string, ticker string, body string, labels array<{FACT}>"))
    tickers = [r["ticker"] for r in out]
    assert len(set(tickers)) == len(tickers) and out[-1]["passage_id"] == "e" and "h" not in {r["passage_id"] for r in out}
    seen = set()
    for r in out[:-1]:
        concepts = {x["concept"] for x in r["labels"]}
        assert concepts - seen
        seen |= concepts


def test_label_samples_take_from_both_sides(spark):
    df = spark.createDataFrame([(f"c{i}", i % 5 == 0 if i < 40 else None) for i in range(44)], "case_id string, passed boolean")
    got = training.label_sample(df, 12).groupBy("passed").count().collect()
    assert {r["passed"]: r["count"] for r in got} == {True: 6, False: 6}


def test_context_account(spark):
    candidates = spark.createDataFrame([(1, f"c{i}", i, i <= 4) for i in range(1, 7)] + [(2, "c1", 1, True)], "query_id int, id string, rank int, included boolean")
    chars = spark.createDataFrame([("c1", 5), ("c2", 20), ("c3", 4), ("c4", 90)], "id string, chars long")
    relevant = spark.createDataFrame([(1, "c2"), (1, "c6"), (1, "zz"), (3, "c1")], "query_id int, id string")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {r["query_id"]: r.asDict() for r in context.stage_of_loss(context.probed(candidates, chars, relevant, queries, 10)).collect()}
    one = got[1]
    assert (one["n_relevant"], one["pre_ranks"], one["final_ranks"]) == (3, [2, 6], [2])
    assert (one["n_included"], one["n_dropped"], one["chars_before"], one["chars_after"], one["cap_binding"]) == (1, 3, 119, 5, True)
    assert (one["relevant_in_prompt"], one["lost_to_cap"], one["first_excluded_rank"], one["would_fit_with_skip"]) == (0, 1, 2, True)
    assert [got[i]["lost_at"] for i in (1, 2, 3)] == ["cap", "unlabelled", "search"]
    skipping = context.probed(candidates, chars, relevant, queries, 10, "skip").filter("query_id = 1").first()
    assert (skipping["n_included"], skipping["chars_after"], skipping["would_fit_with_skip"]) == (2, 9, False)


def test_stale_labels_are_linked_again(spark):
    labels = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "case_id string, id long")
    fresh = spark.createDataFrame([("a", 9)], "case_id string, id long")
    same, record = context.labels_for(labels, spark.range(5), lambda: fresh)
    assert same is labels and not record["relinked"] and record["labels"] == 3
    other, record = context.labels_for(labels, spark.range(3), lambda: fresh)
    assert other is fresh and record["stale_labels"] == 1 and record["cases_after"] == 1
    both = context.compared_strategies(lambda s: spark.range(2), ["x", "y"])
    assert {r["strategy"]: r["count"] for r in both.groupBy("strategy").count().collect()} == {"x": 2, "y": 2}


def test_truncation_audit(spark):
    pairs = spark.createDataFrame([(1, "a b", "w " * n) for n in (3, 10, 20)], "query_id int, query_text string, text string")
    row = context.truncation_audit(pairs, lambda texts: [len(t.split()) for t in texts], window=12).first()
    assert (row["query_tokens"], row["budget"], row["passages"], row["truncated"], row["most_tokens"], row["median_tokens"]) == (2, 7, 3, 2, 20, 10)
    assert row["median_seen"] == 0.7


def test_refresh_checks(spark):
    filings = spark.createDataFrame([(1, "A", 2022, False), (2, "A", 2023, True), (3, "B", 2023, True), (4, "C", None, True)], "filing_id int, cik string, fiscal_year int, is_new boolean")
    facts = spark.createDataFrame([("A", 2022, "x", 5000.0), ("A", 2022, "y", 6000.0), ("A", 2023, "x", 7_000_000.0), ("B", 2023, "x", 1234.0)], "cik string, fiscal_year int, tag string, value double")
    sections = spark.createDataFrame([(2, "it was 7,000 in thousands"), (3, "nothing"), (3, None)], "filing_id int, body string")
    chunks = spark.createDataFrame([(1, "a", True)] * 4 + [(2, "b", True)] * 3 + [(3, " ", False)], "filing_id int, body string, embedded boolean")
    got = {(r["filing_id"], r["name"]): (r["passed"], r["detail"]) for r in golden.filing_checks(filings, facts, sections, chunks).collect()}
    assert got == {
        (2, "same core facts as the year before"): (False, "y"), (2, "figures are in the text"): (True, "1 of 1 found, 1 facts"), (2, "chunks embedded"): (True, "3 chunks, 3 embedded, 0 blank"),
        (2, "chunk count in line with the year before"): (True, "3 and 4"), (3, "same core facts as the year before"): (True, ""), (3, "figures are in the text"): (False, "0 of 1 found, 1 facts"),
        (3, "chunks embedded"): (False, "1 chunks, 0 embedded, 1 blank"), (4, "fiscal year known"): (False, "no period end"),
    }


def test_retrieval_and_answer_checks(spark):
    ddl = "query_id int, id string, rank int"
    before = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], ddl)
    after = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "d", 1)], ddl)
    rel = spark.createDataFrame([(1, "a"), (2, "c")], "query_id int, id string")
    row = golden.retrieval_check(before, after, rel).first()
    assert (row["questions"], row["changed"], row["hit_before"], row["hit_after"], row["passed"]) == (2, 2, 1.0, 0.5, False)
    assert golden.retrieval_check(before, before, rel).first()["passed"]
    good = spark.createDataFrame([(i % 10 != 0,) for i in range(20)], "passed boolean")
    assert golden.answer_check(good, 0.95).first()["passed"] and not golden.answer_check(good.filter("NOT passed"), 0.95).first()["passed"]


def test_newest_filings_and_sources(spark):
    filings = spark.createDataFrame([(1, "A", "a1", "10-K", 2022, "2023-01-01"), (2, "A", "a2", "10-K", 2023, "2024-01-01"), (3, "A", "a3", "10-K", 2023, "2024-06-01"), (4, "A", "a4", "8-K", 2024, None), (5, "B", "b1", "10-K", None, None)], "id long, cik string, accession string, form string, fiscal_year int, filing_date string").withColumn("filing_date", F.to_date("filing_date"))
    assert [(r["cik"], r["accession"]) for r in golden.latest_filings(filings).collect()] == [("A", "a3")]
    sections = spark.createDataFrame([(3, "1A", 1, "Risk", 9), (3, " 1a", 0, "Risk", 5), (3, "7", 2, "MDA", 4)], "filing_id long, item string, ordinal int, title string, char_len int")
    plan = spark.createDataFrame([("p", "A", "1a "), ("q", "A", "9"), ("r", "B", "7")], "case_id string, cik string, item string")
    got = {r["case_id"]: (r["accession"], r["chars"], r["available"]) for r in golden.narrative_sources(plan, filings, sections).collect()}
    assert got == {"p": ("a3", 14, ["1A", "7"]), "q": ("a3", None, ["1A", "7"]), "r": (None, None, None)}


def test_sql_functions(spark):
    from kelpie.functions import figures, stats, text
    from kelpie.operators import retrieval

    assert "kelpie_or_query" in api.register(spark)
    df = spark.createDataFrame(
        [("Net net Sales a", "It is not available", 383285.0, 383285e6, 3, 0, 0, 3, [1.0, 2.0], [2.0, 1.0]), (None, None, 0.0, 0.0, 0, 0, 0, 0, [0.0, 0.0], [1.0, 1.0]), ("", "yes", -5.0, 4.0, 1, 2, 3, 4, [1.0], [1.0])],
        "body string, answer string, predicted double, expected double, tp long, fp long, fn long, tn long, a array<float>, b array<float>",
    )
    c = F.col
    pairs = [
        ("kelpie_or_query(body)", text.or_query(c("body"))), ("kelpie_is_abstention(answer)", text.is_abstention(c("answer"))), ("kelpie_token_estimate(body)", text.token_estimate(c("body"))),
        ("kelpie_answer_hash(answer)", text.answer_hash(c("answer"))), ("kelpie_values_match(predicted, expected)", figures.values_match(c("predicted"), c("expected"))),
        ("kelpie_percent_change(predicted, expected)", figures.percent_change(c("predicted"), c("expected"))), ("kelpie_cosine(a, b)", retrieval.cosine(c("a"), c("b"))),
        ("kelpie_kappa(tp, fp, fn, tn)", stats.kappa(c("tp"), c("fp"), c("fn"), c("tn"))),
    ]
    assert len(pairs) == len(api.SQL_FUNCTIONS)
    for sql, column in pairs:
        for r in df.select(F.expr(sql).alias("x"), column.alias("y")).collect():
            assert r["x"] == r["y"] or r["x"] == pytest.approx(r["y"]), sql


def test_search_and_ask(spark):
    ddl = "id long, ticker string, cik string, fiscal_year int, item string, body string, embedding array<float>"
    chunks = spark.createDataFrame([(1, "A", "1", 2023, "7", "revenue was 1,200", [1.0, 0.0]), (2, None, "2", None, None, "cats", [0.0, 1.0])], ddl)
    queries = spark.createDataFrame([(1, "what was the revenue", [1.0, 0.1]), (2, "?", [1.0, 0.0])], "query_id long, query_text string, query_vector array<float>")
    got = {r["query_id"]: (r["allowed"], r["answer"]) for r in api.ask(queries, chunks, k=1).collect()}
    assert got == {1: (True, "2023.0"), 2: (False, None)}
    text = api.contexts(api.search(queries.filter("query_id = 1"), chunks), chunks).first()["context"]
    assert text.startswith("[1] A FY2023 Item 7\nrevenue was 1,200\n\n[2] 2 FY?\ncats")


def test_prompts_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("q {x}", "r", None)], "q string, r string, c string")
    said = df.select(api.judge_prompt("v2", F.col("q"), F.col("r"), F.col("c"))).first()[0]
    assert said.startswith("Question: q {x}\nReference: r\nCandidate: \n") and set(api.CONTRACTS) == {"v1", "v2", "v3", "v3_1"}
    body = api.report("Run", {"All": spark.createDataFrame([("a|b", 1), (None, 2)], "k string, n int")})
    assert "| a\\|b | 1 |" in body and "|  | 2 |" in body
    api.save(spark, f"file://{tmp_path}/r.md", body)
    assert (tmp_path / "r.md").read_text() == body
    assert {r["name"]: r["n"] for r in api.status({"x": df, "y": df.limit(0)}).collect()} == {"x": 1, "y": 0}


def test_settings_and_diagnosis(spark):
    from kelpie.operators import probes

    assert [(s.name, s.k, s.top_n, s.rerank) for s in probes.settings(10, 3, True)][:2] == [("shipped", 10, 3, True), ("no-rerank", 10, 3, False)]
    say = lambda shipped, ceiling, wide, other: probes.diagnosis({"shipped": {"hit@5": shipped}, "ceiling": {"hit@10": ceiling}, "wide-k": {"hit@20": wide}, "rerank": {"hit@5": other}})
    assert say(0.5, 0.5, 0.7, 0.5) == ["search more"] and say(0.3, 0.5, 0.5, 0.2) == ["mend chunks or queries", "mend ranking or truncation", "reranking harms"]
    assert say(0.9, 0.95, 0.95, 0.92) == ["reranking helps"] and say(0.9, 0.95, 0.95, 0.9) == ["nothing is lost"] and probes.diagnosis({}) == ["incomplete"]


def test_agents_end(spark):
    from kelpie.operators import providers

    tools = providers.Tools()
    tools.add("rows", n=int)(lambda n: spark.range(n))
    moves = iter([{"tool": "rows", "arguments": {"n": 2}, "cost": 0.01}, {"tool": "rows", "arguments": {"n": "x"}}, {"answer": "2", "cost": 0.01}])
    trace = providers.agent("q", tools, lambda q, steps: next(moves))
    assert (trace.answer, trace.outcome, round(trace.cost, 2)) == ("2", "answered", 0.02)
    assert [s["ok"] for s in trace.steps] == [True, False] and trace.steps[0]["result"] == [{"id": 0}, {"id": 1}]
    same = {"tool": "rows", "arguments": {"n": 1}}
    assert providers.agent("q", tools, lambda q, s: same).outcome == "loop"
    assert providers.agent("q", tools, lambda q, s: {**same, "cost": 1.0}).outcome == "cost"
    assert providers.agent("q", tools, lambda q, s: {"tool": "rows", "arguments": {"n": len(s)}}, most_steps=3).outcome == "steps"
    hits = spark.createDataFrame([(1, "a", 1, "q", "xx"), (1, "b", 2, "q", "xxx"), (1, "c", 3, "q", None)], "query_id int, id string, rank int, query_text string, text string")
    assert [r["id"] for r in providers.reranked(hits, lambda q, p: [len(x) for x in p]).orderBy("new_rank").collect()] == ["b", "a", "c"]


def test_whole_filings_and_samples(spark):
    companies = spark.createDataFrame([("1", "A")], "cik string, ticker string")
    filings = spark.createDataFrame([(1, "1", "a1", "10-K", 2023), (2, "1", "a2", "10-K", 2022), (3, "1", "a3", "10-K", 2022)], "id long, cik string, accession string, form string, fiscal_year int")
    sections = spark.createDataFrame([(1, 1, "T", "two"), (1, 0, None, "one")], "filing_id long, ordinal int, title string, body string")
    assert context.whole_filing(companies, filings, sections, "A", 2023) == ("a1", "one\n\nT\ntwo")
    for year in (2022, 2021):
        with pytest.raises(ValueError):
            context.whole_filing(companies, filings, sections, "A", year)
    chunks = spark.createDataFrame([(i, "s" if i % 2 else "t", "w " * i) for i in range(20)], "id long, strategy string, body string")
    sample = context.window_sample(chunks, lambda texts: [len(t.split()) for t in texts], 4)
    assert {r["strategy"]: r["n"] for r in golden.window_audit(sample, ["strategy"], 9).collect()} == {"s": 4, "t": 4}


def test_keys_and_catalog(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, period int, v string")
    assert sorted(r["v"] for r in schemas.rekeyed(df, ["k", "period"], ["k"], ["period"]).collect()) == ["x", "z"]
    assert schemas.rekeyed(df, ["k"], ["k"], ["period"]) is df
    assert schemas.existing(spark, ["kelpie_no_such_table"]).isEmpty()


def test_records_are_read_back(spark, tmp_path):
    from kelpie.sources import tables

    rows = spark.createDataFrame([("p1", None, [("a", 2023, 1.0)]), ("p2", "t", [])], f"passage_id string, body string, labels array<{FACT}>")
    training.write_records(rows, f"file://{tmp_path}/train")
    got = tables.json_lines(spark, f"file://{tmp_path}/train", f"passage_id string, body string, labels array<{FACT}>").drop("line")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_fixed_chunks_of_parts_are_those_of_the_joined_text(spark, monkeypatch):
    from kelpie.operators import chunking

    monkeypatch.setattr(chunking, "BLOCK", 7)
    words = [None, "", "a", "  ", "bb c", "déjà vu 日本 " * 3, "\t\x0b x \n", "0123456789" * 9]
    parts = [(f, i % 5, words[(i * i + f) % len(words)]) for f in range(12) for i in range(f)] + [(None, 1, "no filing"), (50, 1, ""), (51, 1, None), (52, 1, "x" * 5000)]
    sections = spark.createDataFrame([(f, i, i, None, None, b) for i, (f, o, b) in enumerate(parts)], "filing_id int, id int, ordinal int, item string, title string, body string")
    sections = sections.withColumn("ordinal", sections.ordinal % 5)
    texts = {}
    for f, o, b in sorted(((f, i % 5, b) for i, (f, o, b) in enumerate(parts) if b is not None), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])):
        texts.setdefault(f, []).append(b)
    for target, overlap in ((3, 1), (2, 0), (5, 4), (1, -1)):
        size, step = target * 4, (target - overlap) * 4
        want = []
        for f, bodies in texts.items():
            text = "\n\n".join(bodies)
            starts = range(0, max(0, -(-(len(text) - size) // step)) * step + 1, step) if text else ()
            want += [(f, n, c) for n, at in enumerate(starts) if (c := text[at : at + size].strip(" \t\n\r\x0b\f"))]
        got = [(r["filing_id"], r["ordinal"], r["body"]) for r in jobs.built_chunks(sections, "fixed", target, overlap).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_filing_of_many_megabytes_is_cut_in_time(spark):
    import time

    one = spark.range(2).select(F.lit(1).alias("filing_id"), "id", F.col("id").alias("ordinal"), F.lit(None).cast("string").alias("item"), F.lit(None).cast("string").alias("title"), F.repeat(F.lit("0123456789abcdef"), 500_000).alias("body"))
    began = time.perf_counter()
    assert jobs.built_chunks(one, "fixed").agg(F.count("*"), F.max("ordinal")).first() == (8929, 8928)  # of 16,000,002 characters
    assert time.perf_counter() - began < 60
