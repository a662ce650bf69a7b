"""Extraction, providers and golden sets on small frames."""

from pyspark.sql import functions as F

from kelpie.operators import extraction as ex
from kelpie.operators import golden, probes, providers

FACT = "struct<concept:string,fiscal_year:int,value:double>"


def test_parse_takes_the_first_array_of_facts():
    assert ex.parse('<think>[1]</think> here: ```{"facts": [{"a": 1}]}```') == [{"a": 1}]
    assert ex.parse("[1, 2] then []") == [] and ex.parse("none") is None and ex.parse(None) is None
    assert ex.parse('{"x": [1], "y": [{"a": 1}]}') == [{"a": 1}]


def test_facts_are_normalised():
    assert ex.fact_of({"tag": "Assets", "fiscal_year": "FY2023", "value": "(1,234)"}) == ("total assets", 2023, -1234.0)
    assert ex.fact_of({"concept": "Net Income", "fiscal_year": 2023.0, "value": 5}) == ("net income", 2023, 5.0)
    assert ex.fact_of({"concept": "else", "fiscal_year": 2023, "value": 5}) is None and ex.fact_of({"concept": "net income", "fiscal_year": True, "value": 5}) is None


def test_predictions_and_diagnosis(spark):
    said = '[{"concept": "total assets", "fiscal_year": 2023, "value": 500}, {"concept": "net income", "fiscal_year": 2022, "value": 70}, {"concept": "gross profit", "fiscal_year": 2023, "value": 12345}, {"concept": "?"}]'
    df = ex.predictions(spark.createDataFrame([(1, said, "it was 12,345 in all")], "case_id int, answer string, passage string"))
    expected = F.expr(f"from_json('[{{\"concept\":\"total assets\",\"fiscal_year\":2023,\"value\":900}},{{\"concept\":\"net income\",\"fiscal_year\":2023,\"value\":70}}]', 'array<{FACT}>')")
    cases = df.select("case_id", "passage", F.col("parsed.facts").alias("predicted"), expected.alias("expected"), F.col("parsed.invalid").alias("invalid"))
    row = ex.diagnose(cases).first().asDict()
    assert row == {"case_id": 1, "invalid": 1, "missed": 2, "wrong_value": 1, "wrong_year": 1, "wrong_concept": 0, "unlabelled": 1, "not_in_passage": 0, "sign_flipped": 0}


def test_passages_are_labelled_where_the_concept_is_named(spark):
    body = "[7 Equity]\nTotal assets | 352,583 | 352,755\nSegment total revenue | 383,285\nWe earned $97.0 billion of net income."
    facts = [("1", "Assets", 2023, 352583e6, 352755e6), ("1", "Revenues", 2023, 383285e6, None), ("1", "NetIncomeLoss", 2023, 97e9, None), ("1", "StockholdersEquity", 2019, 1e9, None)]
    out = ex.labelled(spark.createDataFrame([(1, "1", 2023, body)], "passage_id int, cik string, fiscal_year int, body string"), spark.createDataFrame(facts, "cik string, tag string, fiscal_year int, value double, prior_year_value double")).first()
    assert [(x["concept"], x["fiscal_year"]) for x in out["labels"]] == [("total assets", 2023), ("total assets", 2022), ("net income", 2023)]
    assert [x["concept"] for x in out["dropped"]] == ["total revenue"] and not out["ambiguous"]


def test_tools_return_errors():
    tools = providers.Tools()

    @tools.add("fact", ticker=str, year=int)
    def fact(ticker, year):
        return (ticker, year)

    assert tools.call("fact", {"ticker": "A", "year": 1}) == (True, ("A", 1))
    assert not tools.call("fact", {"ticker": "A"})[0] and not tools.call("fact", {"ticker": "A", "year": "x"})[0] and not tools.call("no", {})[0]


def test_providers(spark):
    df = spark.createDataFrame([("revenue was 1,200 and 7",)], "prompt string")
    assert df.select(providers.largest_number(F.col("prompt"))).first()[0] == "1200.0"
    assert providers.completed(df, lambda texts: [t.upper() for t in texts]).first()["answer"] == "REVENUE WAS 1,200 AND 7"


def test_golden_cases(spark):
    facts = spark.createDataFrame([("1", "A", "Acme", t, "total assets", "USD", 2023, 1.5e9) for t in ("x", "y", "z")], "cik string, ticker string, name string, tag string, label string, unit string, fiscal_year int, value double")
    cases = golden.numeric_cases(facts, ["What was {label} of {name} in FY{year}?"], 2, "7").collect()
    assert len(cases) == 2 and cases[0]["question"] == "What was total assets of Acme in FY2023?" and cases[0]["expected"] == "$1.50 billion"
    chunks = spark.createDataFrame([(i, "A", 2023, b) for i, b in enumerate(["none", "at 1,500 in millions", "1,500,000,000", "1,500"])], "id long, ticker string, fiscal_year int, body string")
    linked = golden.linked_evidence(spark.createDataFrame(cases[:1]), chunks).collect()
    assert [r["id"] for r in linked] == [2]
    pairs = spark.createDataFrame([(1, "It was 1,000. Second. Third.", "c")], "pair_id int, reference string, candidate string")
    made = {r["control"]: r["answer"] for r in golden.controls(pairs).collect()}
    assert made["contradiction"].startswith("It was 3,000.") and made["omission"] == "It was 1,000. Second."


def test_probes_come_from_the_reference(spark):
    found = probes.derive("The European Commission fined it €500 million under Article 5(4); the US Department Of Justice (DOJ) sued.")
    assert set(found) == {"€500 million", "Article 5(4)", "Department Of Justice", "DOJ"} or "European Commission" not in found
    df = spark.createDataFrame([("a €500 million fine, DOJ",), ("doj",), ("none",), (None,)], "body string")
    assert [r["support"] for r in probes.classified(df, {"m": found["€500 million"], "d": r"\bDOJ\b"}).collect()] == ["primary", "supporting", "weak", "weak"]
    row = probes.probed(df, {"d": r"\bDOJ\b"}).first()["facts"][0]
    assert row["present"] and "DOJ" in row["excerpt"]
    assert probes.parse_spec("a=x+; b.c ;") == {"a": "x+", "b.c": r"b\.c"}


def test_printed_forms_and_their_guards():
    assert ex.find("grew 577% in all", 577e6, "net income") is None and not ex.printed("grew 577% in all", 577.0)
    assert ex.find("it was 577 in all", 577e6, "net income") == (7, 10)
    assert ex.word_forms(5.5e6, "net income") == [] and ex.word_forms(1e7, "net income") == [("10.0", "million")]
    assert ex.word_forms(1e10, "net income") == [("10.0", "billion"), ("10.00", "billion")] and ex.word_forms(5e9, ex.SHARES) == []
    assert ex.table_forms(606_200_000, "net income") == ["606,200,000", "606,200"] and ex.table_forms(99e6, "net income") == ["99,000,000", "99,000"]
    assert ex.table_forms(6.13, ex.PER_SHARE) == ["6.13"] and ex.table_forms(0.001, ex.PER_SHARE) == []
    assert ex.find("$1.2 billion above, 1,200,000,000 below", 1.2e9, "net income") == (20, 33)  # table forms come first
    assert ex.printed("8.28 and", 8.28e6) and not ex.printed("only 8 of", 8.28e6) and ex.printed("only 8 of", 8e6)


def test_scores_leave_out_what_cannot_be_checked(spark):
    ddl = f"case_id int, passage string, predicted array<{FACT}>, expected array<{FACT}>, invalid int, ignore array<{FACT}>, verifiable array<struct<concept:string,fiscal_year:int>>"
    f = lambda c, y, v: (c, y, float(v))
    rows = [
        (1, "p", [f("a", 1, 5), f("b", 1, 7), f("c", 1, 9)], [f("a", 1, 5), f("d", 1, 1)], 1, [f("b", 1, 7)], [("a", 1), ("b", 1), ("d", 1)]),
        (2, "p", [], [], 0, None, None),
        (3, "p", [f("a", 1, 5)], [], 0, [], None),
    ]
    got = {r["case_id"]: r for r in ex.scored(spark.createDataFrame(rows, ddl)).collect()}
    assert tuple(got[1])[1:7] == (1, 2, 2, 1, 1, 1) and (got[1]["precision"], got[1]["recall"], got[1]["f1"]) == (0.5, 0.5, 0.5)
    assert got[2]["precision"] == got[2]["recall"] == got[2]["f1"] == 1.0 and got[2]["exact"] and got[3]["precision"] == 0.0 and got[3]["recall"] == 0.0


def test_errors_have_causes(spark):
    passage = "Total assets | 352 | 700\nNet income was $6.9 billion in segment A.\nSales | 240"
    rows = [
        (1, passage, [("net income", 2023, 6_900_000_000.0), ("total revenue", 2023, 24e8), ("total assets", 2023, 700e6)], [("net income", 2023, 6_866_000_000.0), ("total assets", 2023, 352e6), ("gross profit", 2022, 700e6)], 0),
    ]
    cases = spark.createDataFrame(rows, f"case_id int, passage string, predicted array<{FACT}>, expected array<{FACT}>, invalid int")
    items = ex.caused(ex.error_items(cases))
    got = {(r["kind"], r["concept"]): (r["cause"], r["predicted"], r["label"]) for r in items.collect()}
    assert got == {
        ("wrong_value", "total assets"): ("segment", 700e6, 352e6), ("missed", "total assets"): ("label_no_year", 700e6, 352e6), ("not_in_passage", "total revenue"): ("scale", 24e8, None),
        ("missed", "gross profit"): ("label_no_year", None, 700e6),
    }
    totals = spark.createDataFrame([(1, 3, 3)], "tp int, n_predicted int, n_expected int")
    whole = ex.cause_summary(items, totals, []).first()
    assert (whole["items"], whole["cases"], whole["f1_if_fixed"]) == (4, 1, 1.0)


def test_large_figures_are_tripled_with_all_their_digits(spark):
    texts = ["Card 4111111111111111 was used. ", "Sum 11111111111111111111111,5.\x0bAnd more. End", "a. b.\x01c", "9" * 400]
    pairs = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "pair_id int, reference string, candidate string")
    got = {(r["pair_id"], r["control"]): r["answer"] for r in golden.controls(pairs).collect()}
    assert got[0, "contradiction"] == "Card 12,333,333,333,333,332 was used. "
    assert got[1, "contradiction"].startswith(f"Sum {float('1' * 23 + '5') * 3:,.0f}.") and (1, "omission") not in got  # a vertical tab is no blank
    assert got[2, "omission"] == "a. b." and got[3, "contradiction"] == "inf"


def test_corpus_checks_take_a_figure_from_its_own_row(spark, tmp_path):
    import duckdb

    from kelpie.plans.catalogue import ORACLES, QUERIES

    orders = "(1, 1, 'O', 12345.0::DOUBLE, '1-URGENT'), (2, 1, 'O', 212345.0, '2-HIGH'), (3, 2, 'O', 5000.0, '1-URGENT'), (4, 2, 'P', 5000.0, '3-MEDIUM'), (5, 3, 'F', 7000.0, NULL), (6, 3, 'F', 7000.0, '5-LOW'), (7, 4, 'F', 7001.0, '5-LOW')"
    con = duckdb.connect()
    con.execute(f"CREATE TABLE orders AS SELECT k::BIGINT AS o_orderkey, c::BIGINT AS o_custkey, s AS o_orderstatus, v AS o_totalprice, TIMESTAMP '1996-05-01' AS o_orderdate, p AS o_orderpriority FROM (VALUES {orders}) t(k, c, s, v, p)")
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet'")
    got = sorted(tuple(r) for r in QUERIES["corpus_checks"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLES["corpus_checks"]).fetchall())
    assert [(f, ok) for f, name, ok in got if name == "figures are in the text"] == [(11996, False), (21996, False), (31996, False), (41996, True)]


def test_printed_figures_stand_alone():
    assert ex.printed("net 1,234.5 million", 1234.5e6) and ex.printed("(70) or 1,000", 1000.0) and ex.printed("12,345 and 2,345", 2345.0)
    assert not any(ex.printed(t, 2345.0) for t in ("", "12,345", "2,345%", "2,345 %", "2,3456", "2,345.6", "2,345,000", "1.2,345"))


def test_python_is_asked_only_about_figures_in_doubt(spark, monkeypatch):
    fact = lambda v, y: f"array(named_struct('concept', 'net income', 'fiscal_year', {y}, 'value', {v}D))"
    cases = spark.range(4).select(F.col("id").alias("case_id"), F.lit("it was 777").alias("passage"), F.expr(f"if(id = 0, {fact(777, 2022)}, if(id = 1, {fact(778, 2022)}, {fact(500, 2023)}))").alias("predicted"), F.expr(fact(100, 2023)).alias("expected"), F.lit(0).alias("invalid"))
    asked = spark.sparkContext.accumulator(0)

    def printed(passage, value):
        asked.add(1)
        return "777" in passage and value == 777

    monkeypatch.setattr(ex, "_printed_anywhere", lambda: F.pandas_udf("boolean")(_asking(printed)))
    got = {r["case_id"]: r for r in ex.diagnose(cases).collect()}
    assert asked.value == 2 and got[0]["unlabelled"] == 1 and got[1]["not_in_passage"] == 1 and got[2]["wrong_value"] == got[3]["wrong_value"] == 1


def _asking(printed):
    import pandas as pd

    def run(passage: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([bool(t) and printed(t, v) for t, v in zip(passage, value)], dtype=bool)

    return run


def test_scores_of_a_large_case_take_one_pass(spark):
    import time

    n = 30_000
    fact = lambda i, v: F.struct(F.lit("net income").alias("concept"), i.cast("int").alias("fiscal_year"), v.alias("value"))
    every = F.sequence(F.lit(1), F.lit(n))
    predicted, expected = F.transform(every, lambda i: fact(i, F.when(i % 3 == 0, i * 1.0).otherwise(i * 1.5))), F.transform(every, lambda i: fact(i, i * 1.0))
    began = time.perf_counter()
    row = ex.scored(spark.range(1).select(F.lit(1).alias("case_id"), predicted.alias("predicted"), expected.alias("expected"), F.lit(2).alias("invalid"))).first()
    assert (row["tp"], row["n_predicted"], row["n_expected"]) == (n // 3, n + 2, n) and time.perf_counter() - began < 60


def test_scores_of_repeated_null_and_missing_facts(spark):
    rows = [
        (1, [("a", 1, 5.0), ("a", 1, 5.0), ("a", 1, 9.0), ("b", 1, 5.0)], [("a", 1, 9.0), ("a", 1, 5000.0), ("c", 1, 5.0)]),
        (2, [(None, 1, 5.0), ("a", None, 5.0), ("a", 1, None), ("a", 2, 0.0), None], [(None, 1, 5.0), ("a", None, 5.0), ("a", 1, 5.0), ("a", 2, 0.0)]),
        (2, [("a", 1, -5.0)], [("a", 1, 5.0)]),
        (None, [], []),
        (4, [("a", 1, 5.0)], []),
    ]
    cases = spark.createDataFrame(rows, f"case_id int, predicted {ex.FACTS}, expected {ex.FACTS}").withColumn("invalid", F.lit(0))
    got = sorted(((r["case_id"] or 0, r["tp"], r["n_predicted"], r["n_expected"]) for r in ex.scored(cases).collect()))
    assert got == [(0, 0, 0, 0), (1, 3, 4, 3), (2, 1, 1, 1), (2, 1, 5, 4), (4, 0, 1, 0)]
