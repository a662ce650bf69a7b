"""Facts that a model extracted from passages: parsing, diagnosis against the expected facts, and labelling of passages."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.functions.figures import values_match

#: Tags and the concepts they stand for.
CONCEPT_OF_TAG = {
    "Revenues": "total revenue",
    "RevenueFromContractWithCustomerExcludingAssessedTax": "total revenue",
    "NetIncomeLoss": "net income",
    "OperatingIncomeLoss": "operating income",
    "ResearchAndDevelopmentExpense": "research and development expense",
    "ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost": "research and development expense",
    "Assets": "total assets",
    "Liabilities": "total liabilities",
    "StockholdersEquity": "total stockholders' equity",
    "CashAndCashEquivalentsAtCarryingValue": "cash and cash equivalents",
    "GrossProfit": "gross profit",
    "EarningsPerShareDiluted": "diluted earnings per share",
    "CommonStockSharesOutstanding": "common shares outstanding",
}
PER_SHARE, SHARES = "diluted earnings per share", "common shares outstanding"
#: Words that name a concept near a figure, and words that make it another.
CONCEPT_WORDS = {
    "total revenue": r"revenue|net sales|\bsales\b",
    "net income": r"net\s+(?:\(loss\)\s+|\(losses\)\s+)?(?:income|earnings|loss)",
    "operating income": r"operating\s+(?:\(loss\)\s+)?(?:income|profit|loss)|(?:income|earnings|profit)\s+from\s+operations",
    "research and development expense": r"research,?\s+(?:and|&)\s+development|\br&d\b",
    "total assets": r"total\s+assets",
    "total liabilities": r"total\s+liabilities",
    "total stockholders' equity": r"equity",
    "cash and cash equivalents": r"cash\s+and\s+(?:cash\s+)?equivalents|cash\s+balances?|\bof\s+cash\b",
    "gross profit": r"gross\s+(?:profit|margin)",
    "diluted earnings per share": r"diluted|per\s+(?:common\s+)?share",
    "common shares outstanding": r"\bshares\b",
}
#: Words that make a figure one of another kind, ends of sentences, and how far a figure's name may stand.
VARIANTS = re.compile(r"noncontrolling|non-controlling|continuing\s+operations|discontinued|segment", re.I)
SENTENCE_END = re.compile(r"\.\s|;\s|\n|•")
LINES_ABOVE, PROSE_LINE, BEFORE, AFTER = 3, 300, 150, 40

_NAMES = {**{t.lower(): c for t, c in CONCEPT_OF_TAG.items()}, **{c: c for c in CONCEPT_OF_TAG.values()}}
FACTS = "array<struct<concept:string,fiscal_year:int,value:double>>"


def fact_of(raw) -> tuple[str, int, float] | None:
    """(concept, year, value) of an emitted fact, None where any of them can't be told."""
    if not isinstance(raw, dict):
        return None
    name, year, value = raw.get("concept", raw.get("tag")), raw.get("fiscal_year"), raw.get("value")
    concept = _NAMES.get(name.strip().replace("’", "'").lower()) if isinstance(name, str) else None
    if isinstance(year, str):
        found = re.search(r"(?:19|20)\d{2}", year)
        year = int(found[0]) if found else None
    if isinstance(value, str):
        bare = re.sub(r"[$,\s]", "", value)
        sign = -1 if re.fullmatch(r"\(.*\)", bare) else 1
        try:
            value = sign * float(bare.strip("()"))
        except ValueError:
            value = None
    usable = concept and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (year, value)) and float(year).is_integer()
    return (concept, int(year), float(value)) if usable else None


def parse(text: str | None) -> list[dict] | None:
    """The first JSON array of facts in an answer, bare or as the only list of an object; None where there is none."""
    said, read = re.sub(r"<think>.*?</think>", "", text or "", flags=re.S), json.JSONDecoder().raw_decode
    for at in (m.start() for m in re.finditer(r"[\[{]", said)):
        try:
            data = read(said, at)[0]
        except json.JSONDecodeError:
            continue
        if isinstance(data, dict):
            inside = [v for v in data.values() if isinstance(v, list)]
            data = inside[0] if len(inside) == 1 else None
        if data == [] or (isinstance(data, list) and any(isinstance(d, dict) for d in data)):
            return [d for d in data if isinstance(d, dict)]
    return None


def predictions(answers: DataFrame, text: str = "answer") -> DataFrame:
    """answers with parsed: whether an array was found, its facts (first value per concept and year) and how many were unusable."""

    def one(said):
        raw = parse(said)
        facts = [fact_of(r) for r in raw or ()]
        first: dict[tuple[str, int], float] = {}
        for f in filter(None, facts):
            first.setdefault(f[:2], f[2])
        return raw is not None, [{"concept": c, "fiscal_year": y, "value": v} for (c, y), v in first.items()], facts.count(None)

    @F.pandas_udf(f"struct<ok:boolean,facts:{FACTS},invalid:int>")
    def run(said: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(s) for s in said], columns=["ok", "facts", "invalid"])

    return answers.withColumn("parsed", run(text))


def _same_key(a, b):
    return (a["concept"] == b["concept"]) & (a["fiscal_year"] == b["fiscal_year"])


def to_score(cases: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """cases with predicted cut to what is scored, and how many predictions were set aside: ignored and unverifiable.

    cases: predicted, expected, and where there are any ignore (facts whose prediction counts neither way) and verifiable
    (array of (concept, fiscal_year) that can be checked at all; null: all can).
    """
    out = cases
    if "ignore" in cases.columns:
        left = F.filter("predicted", lambda p: ~F.exists(F.coalesce("ignore", F.array().cast(FACTS)), lambda x: _same_key(x, p) & values_match(p["value"], x["value"], tolerance)))
        out = out.withColumn("ignored", F.size("predicted") - F.size(left)).withColumn("predicted", left)
    else:
        out = out.withColumn("ignored", F.lit(0))
    if "verifiable" in cases.columns:
        left = F.when(F.col("verifiable").isNull(), F.col("predicted")).otherwise(F.filter("predicted", lambda p: F.exists("verifiable", lambda x: _same_key(x, p))))
        return out.withColumn("unverifiable", F.size("predicted") - F.size(left)).withColumn("predicted", left)
    return out.withColumn("unverifiable", F.lit(0))


def _hits(tolerance: float):
    """How many predictions match an expected fact of their concept and year.

    Both sides are sorted by concept and year, the expected facts of a key before its predictions, and gone through once with
    the expected values of the key at hand, so a prediction meets these and not every fact of its case.
    """
    whole = lambda x: x["concept"].isNotNull() & x["fiscal_year"].isNotNull()
    entry = lambda side: lambda x: F.struct(x["concept"].alias("concept"), x["fiscal_year"].cast("long").alias("fiscal_year"), F.lit(side).alias("side"), x["value"].cast("double").alias("value"))
    side = lambda c, n: F.transform(F.filter(F.coalesce(c, F.array().cast(FACTS)), whole), entry(n))
    none = F.array().cast("array<double>")

    def step(a, x):
        known = F.when(_same_key(a, x), a["values"]).otherwise(none)
        predicted = x["side"] == 1
        right = predicted & F.exists(known, lambda v: values_match(x["value"], v, tolerance))
        return F.struct(
            x["concept"].alias("concept"), x["fiscal_year"].alias("fiscal_year"), F.when(predicted, known).otherwise(F.concat(known, F.array(x["value"]))).alias("values"),
            (a["tp"] + F.coalesce(right, F.lit(False)).cast("int")).alias("tp"),
        )

    start = F.struct(F.lit(None).cast("string").alias("concept"), F.lit(None).cast("long").alias("fiscal_year"), none.alias("values"), F.lit(0).alias("tp"))
    entries = F.sort_array(F.concat(side("expected", 0), side("predicted", 1)))
    return F.when(F.col("predicted").isNotNull(), F.aggregate(entries, start, step, lambda a: a["tp"]))


def scored(cases: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Per case (case_id, predicted, expected, invalid, see to_score) its counts and rates; unusable predictions count against precision."""
    from .evalruns import with_rates

    rows = to_score(cases, tolerance)
    counts = rows.select(
        "case_id", _hits(tolerance).alias("tp"), (F.size("predicted") + F.col("invalid")).alias("n_predicted"), F.size("expected").alias("n_expected"), "invalid", "ignored", "unverifiable"
    )
    return with_rates(counts)


def _kind(p, expected, tolerance: float):
    """What a prediction is, null where only the passage can tell."""
    match = lambda x: values_match(p["value"], x["value"], tolerance)
    key = lambda x: _same_key(x, p)
    flipped = F.exists(expected, lambda x: key(x) & match(x) & (x["value"] * p["value"] < 0))
    return (
        F.when(F.exists(expected, lambda x: key(x) & match(x)), F.when(flipped, "sign_flipped").otherwise("right"))
        .when(F.exists(expected, key), "wrong_value")
        .when(F.exists(expected, lambda x: match(x) & (x["concept"] == p["concept"])), "wrong_year")
        .when(F.exists(expected, match), "wrong_concept")
    )


def _judged(cases: DataFrame, tolerance: float) -> DataFrame:
    rows = to_score(cases, tolerance).select("case_id", "passage", "expected", F.explode("predicted").alias("p"))
    rows = rows.withColumn("kind", _kind(F.col("p"), F.col("expected"), tolerance))
    # Python sees the passages and values that are in doubt, and nulls for the rest
    doubt = F.col("kind").isNull()
    there = _printed_anywhere()(F.when(doubt, F.col("passage")), F.when(doubt, F.col("p")["value"]))
    return rows.withColumn("kind", F.coalesce("kind", F.when(there, "unlabelled").otherwise("not_in_passage")))


def _missed(tolerance: float):
    return F.filter("expected", lambda x: ~F.exists("predicted", lambda q: _same_key(x, q) & values_match(q["value"], x["value"], tolerance)))


def diagnose(cases: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Per case the errors by kind. cases: case_id, passage, predicted, expected (arrays of facts), invalid, and see to_score.

    A prediction that is not right is of the first kind that holds: wrong_value (its concept and year are expected),
    wrong_year, wrong_concept (its number is expected elsewhere), unlabelled (the passage prints it), not_in_passage.
    """
    kinds = ("wrong_value", "wrong_year", "wrong_concept", "unlabelled", "not_in_passage", "sign_flipped")
    counts = _judged(cases, tolerance).groupBy("case_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    missed = to_score(cases, tolerance).select("case_id", "invalid", F.size(_missed(tolerance)).alias("missed"))
    return missed.join(counts, "case_id", "left").fillna(0)


def error_items(cases: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """A row for each error that diagnose counts: case_id, passage, kind, concept, fiscal_year, predicted and label (the expected value), null where there is none."""
    wrong = _judged(cases, tolerance).filter(~F.col("kind").isin("right", "sign_flipped"))
    label = F.get(F.filter("expected", lambda x: _same_key(x, F.col("p"))), F.lit(0))["value"]
    wrong = wrong.select("case_id", "passage", "kind", F.col("p.concept").alias("concept"), F.col("p.fiscal_year").alias("fiscal_year"), F.col("p.value").alias("predicted"), label.alias("label"))
    lost = to_score(cases, tolerance).select("case_id", "passage", "predicted", F.explode(_missed(tolerance)).alias("x"))
    said = F.get(F.filter("predicted", lambda q: _same_key(q, F.col("x"))), F.lit(0))["value"]
    return wrong.unionByName(lost.select("case_id", "passage", F.lit("missed").alias("kind"), "x.concept", "x.fiscal_year", said.alias("predicted"), F.col("x.value").alias("label")))


LEFT, RIGHT = r"(?<![\d,.])", r"(?!\d|[.,]\d|\s*%)"
BEFORE_FORM, AFTER_FORM = re.compile(LEFT), re.compile(RIGHT)
#: Scales of tables and of any printing.
TABLE_SCALES, ALL_SCALES = (1, 1_000, 1_000_000), (1, 1_000, 1_000_000, 1_000_000_000)


def table_forms(value: float, concept: str) -> list[str]:
    """How tables print a value: in units, thousands or millions that divide it, in three digits or more; to the cent per share."""
    size = abs(value)
    if concept == PER_SHARE:
        return [f"{size:.2f}"] if size >= 0.01 else []
    shown = [size / s for s in TABLE_SCALES]
    return [f"{round(x):,}" for x in shown if x >= 100 and abs(x - round(x)) < 1e-6]


def word_forms(value: float, concept: str) -> list[tuple[str, str]]:
    """How prose prints a value: (number, scale word); shares and values per share are not said so."""
    size = abs(value)
    if concept in (PER_SHARE, SHARES):
        return []
    billions = [(f"{size / 1e9:.{d}f}", "billion") for d in (1, 2) if size >= 1e9]
    return billions + ([(f"{size / 1e6:.1f}", "million")] if 1e7 <= size < 1e10 else [])


def find(passage: str, value: float, concept: str) -> tuple[int, int] | None:
    """Span of the first printing of a value: of the first table form that is printed at all, else of the first form in words."""
    wanted = [LEFT + re.escape(f) + RIGHT for f in table_forms(value, concept)]
    wanted += [LEFT + re.escape(n) + r"\s*" + word for n, word in word_forms(value, concept)]
    return next((m.span() for w in wanted if (m := re.search(w, passage))), None)


def printed(passage: str, value: float) -> bool:
    """Whether a passage prints a number at any scale, to one or two decimals, or whole where that is most of it."""
    shown = [x for x in (abs(value) / s for s in ALL_SCALES) if x >= 1]
    forms = {f"{x:,.{d}f}" for x in shown for d in (1, 2)} | {f"{x:,.0f}" for x in shown if x >= 100 or x.is_integer()}
    return any(_stands(passage, f) for f in forms)


def _stands(passage: str, form: str) -> bool:
    """Whether a form stands in a passage with LEFT before and RIGHT behind it; no pattern is compiled for a form."""
    at = passage.find(form)
    while at >= 0:
        if BEFORE_FORM.match(passage, at) and AFTER_FORM.match(passage, at + len(form)):
            return True
        at = passage.find(form, at + 1)
    return False


def _printed_anywhere():
    @F.pandas_udf("boolean")
    def run(passage: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([bool(t) and printed(t, v) for t, v in zip(passage, value)], dtype=bool)

    return run


# ---- what may have caused an error


ANY_YEAR, IN_WORDS = re.compile(r"\b(?:19|20)\d{2}\b"), re.compile(r"(\d[\d,]*(?:\.\d+)?)\s*(billion|million)", re.I)


def _row_of(passage: str, span: tuple[int, int] | None) -> str:
    if span is None:
        return ""
    end = passage.find("\n", span[1])
    return passage[passage.rfind("\n", 0, span[0]) + 1 : len(passage) if end < 0 else end]


def _near(a: float, b: float, tolerance: float = 0.005) -> bool:
    return abs(abs(a) - abs(b)) <= tolerance * abs(b) if b else a == 0


def evidence_of(passage: str, concept: str, predicted: float | None, label: float | None) -> dict[str, bool | None]:
    """What a passage shows about an error: where both figures stand, and how they are related to what is printed."""
    exact = lambda v: any(re.search(LEFT + re.escape(f) + RIGHT, passage) for f in table_forms(v, concept))
    said, meant = (None if v is None else find(passage, v, concept) for v in (predicted, label))
    words = [(float(n.replace(",", "")), 1e9 if w.lower() == "billion" else 1e6, len(n.partition(".")[2])) for n, w in IN_WORDS.findall(passage)]
    shown = predicted is not None and (said is not None or printed(passage, predicted))
    rounded = label is not None and meant is not None and not exact(label)
    before = lambda span: None if span is None else bool(ANY_YEAR.search(passage, 0, passage.rfind("\n", 0, span[0]) + 1))
    return {
        "predicted_printed": shown,
        "label_printed": meant is not None,
        "label_in_prose": None if meant is None else "|" not in _row_of(passage, meant),
        "label_among_many": _row_of(passage, meant).count("|") >= 2,
        "year_before_predicted": before(said),
        "year_before_label": before(meant),
        "has_year": bool(ANY_YEAR.search(passage)),
        "names_segment": bool(re.search("segment", passage, re.I)),
        "names_others": bool(re.search("non-?controlling", passage, re.I)),
        "rounds_to_prose": predicted is not None and not exact(predicted) and any(round(abs(predicted) / s, d) == n for n, s, d in words),
        "label_out_of_reach": rounded and not any(_near(n * s, label) for n, s, _ in words),
        "tenfold": predicted is not None and not shown and any(exact(predicted / f) for f in (10, 100, 0.1, 0.01)),
    }


#: Causes in the order they are asked for: name, and whether the evidence of an error of a kind bears it out.
CAUSES = (
    ("label_rounding", lambda kind, e: e["label_out_of_reach"]),
    ("label_no_year", lambda kind, e: kind == "missed" and e["year_before_label"] is False),
    ("scale", lambda kind, e: e["tenfold"]),
    ("extra_digits", lambda kind, e: e["rounds_to_prose"]),
    ("guessed_year", lambda kind, e: kind == "wrong_year" and e["year_before_predicted"] is False),
    ("year_header", lambda kind, e: kind == "wrong_year" and e["has_year"]),
    ("other_interests", lambda kind, e: kind == "wrong_value" and e["names_others"]),
    ("segment", lambda kind, e: kind in ("wrong_value", "wrong_concept", "unlabelled") and e["names_segment"]),
    ("wrong_cell", lambda kind, e: kind != "missed" and e["predicted_printed"]),
    ("computed", lambda kind, e: kind != "missed" and not e["predicted_printed"]),
    ("multicolumn", lambda kind, e: kind == "missed" and e["label_among_many"]),
    ("omitted_prose", lambda kind, e: kind == "missed" and e["label_in_prose"]),
    ("omitted_table", lambda kind, e: kind == "missed" and e["label_printed"]),
)


def caused(items: DataFrame) -> DataFrame:
    """error_items with cause, the first of CAUSES that the passage bears out, else ``unknown``, and in_prose, where the label stands."""

    @F.pandas_udf("struct<cause:string,in_prose:boolean>")
    def run(passage: pd.Series, kind: pd.Series, concept: pd.Series, predicted: pd.Series, label: pd.Series) -> pd.DataFrame:
        rows = []
        for t, k, c, p, x in zip(passage, kind, concept, predicted, label):
            e = evidence_of(t or "", c, None if pd.isna(p) else float(p), None if pd.isna(x) else float(x))
            rows.append((next((name for name, holds in CAUSES if holds(k, e)), "unknown"), e["label_in_prose"]))
        return pd.DataFrame(rows, columns=["cause", "in_prose"])

    return items.withColumn("_c", run("passage", "kind", "concept", "predicted", "label")).select("*", "_c.cause", "_c.in_prose").drop("_c")


def cause_summary(items: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Errors and cases by the given keys, and f1_if_fixed, the pooled F1 if they were all mended. totals: one row of tp, n_predicted, n_expected.

    Mending a prediction that no label has takes it out; mending a label that was missed adds it.
    """
    key = F.concat_ws("|", "case_id", "concept", F.col("fiscal_year").cast("string"))
    sums = items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct("case_id").alias("cases"),
        F.count_distinct(F.when(F.col("label").isNotNull(), key)).alias("gained"),
        F.count_distinct(F.when(F.col("label").isNull(), key)).alias("removed"),
        F.count_distinct(F.when(F.col("label").isNotNull() & F.col("predicted").isNull(), key)).alias("added"),
    )
    rows = sums.crossJoin(totals.select("tp", "n_predicted", "n_expected"))  # totals are a row
    predicted = F.col("n_predicted") - F.col("removed") + F.col("added")
    f1 = 2 * (F.col("tp") + F.col("gained")) / F.nullif(predicted + F.col("n_expected"), F.lit(0))
    return rows.withColumn("f1_if_fixed", f1).drop("tp", "n_predicted", "n_expected", "gained", "removed", "added")


def surroundings(passage: str, start: int, past: int) -> tuple[int, int, int]:
    """(from, to, own row's from) of the text that may name the figure at [start, past): its sentence in prose, its row and the rows above in a table."""
    title = passage.find("]") + 1 if passage.startswith("[") else 0
    row, row_end = passage.rfind("\n", 0, start) + 1, passage.find("\n", past)
    row_end = len(passage) if row_end < 0 else row_end
    if "illion" in passage[start:past].lower() or row_end - row > PROSE_LINE:
        low, high = max(row, start - BEFORE, title), min(row_end, past + AFTER)
        low = max([m.end() for m in SENTENCE_END.finditer(passage, low, start)], default=low)
        stop = SENTENCE_END.search(passage, past, high)
        return low, stop.start() if stop else high, low
    above = row
    for _ in range(LINES_ABOVE):
        above = passage.rfind("\n", 0, max(0, above - 1)) + 1 if above else 0
    return max(above, title), row_end, max(row, title)


def anchored(passage: str, span: tuple[int, int], concept: str) -> bool:
    """Whether the text around a figure names the concept, and its own row or sentence no variant of it."""
    low, high, own = surroundings(passage, *span)
    return bool(re.search(CONCEPT_WORDS[concept], passage[low:high], re.I)) and not VARIANTS.search(passage, own, high)


def label(passage: str, candidates: list[tuple[str, int, float]]) -> tuple[list[dict], list[dict], bool]:
    """(labels, dropped, ambiguous) of a passage, from the facts its filing may print; the first value found of a concept and year counts."""
    seen, hits = set(), []
    for concept, year, value in candidates:
        if (concept, year) not in seen and (span := find(passage, value, concept)):
            seen.add((concept, year))
            hits.append((span[0], -year, concept, value, anchored(passage, span, concept)))
    starts = [h[0] for h in hits if h[4]]
    row = lambda h: {"concept": h[2], "fiscal_year": -h[1], "value": h[3]}
    hits.sort(key=lambda h: h[:2])
    return [row(h) for h in hits if h[4]], [row(h) for h in hits if not h[4]], len(starts) > len(set(starts))


def labelled(passages: DataFrame, facts: DataFrame, years: int = 3) -> DataFrame:
    """passages (passage_id, cik, fiscal_year, body) with their labels; facts: cik, tag, fiscal_year, value, prior_year_value."""
    names = F.create_map(*[F.lit(x) for pair in CONCEPT_OF_TAG.items() for x in pair])
    known = facts.withColumn("concept", F.try_element_at(names, F.col("tag"))).filter("concept IS NOT NULL")
    own = known.select("cik", F.col("fiscal_year").alias("at"), F.col("fiscal_year").alias("upto"), "concept", F.col("value").cast("double").alias("value"))
    prior = known.filter("prior_year_value IS NOT NULL").select("cik", (F.col("fiscal_year") - 1).alias("at"), F.col("fiscal_year").alias("upto"), "concept", F.col("prior_year_value").cast("double").alias("value"))
    every = own.unionByName(prior)
    filings = passages.select("cik", "fiscal_year").distinct()
    near = filings.join(every, "cik").filter((F.col("at") > F.col("fiscal_year") - years) & (F.col("upto") <= F.col("fiscal_year")))
    lists = near.groupBy("cik", "fiscal_year").agg(F.array_sort(F.collect_set(F.struct("concept", "at", "upto", "value"))).alias("candidates"))

    @F.pandas_udf(f"struct<labels:{FACTS},dropped:{FACTS},ambiguous:boolean>")
    def run(body: pd.Series, candidates: pd.Series) -> pd.DataFrame:
        rows = [label(b or "", [(c["concept"], int(c["at"]), float(c["value"])) for c in (cs if cs is not None else ())]) for b, cs in zip(body, candidates)]
        return pd.DataFrame(rows, columns=["labels", "dropped", "ambiguous"])

    return passages.join(lists, ["cik", "fiscal_year"], "left").withColumn("found", run("body", "candidates")).drop("candidates").select("*", "found.*").drop("found")
