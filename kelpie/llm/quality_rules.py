"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a column that is true where a document fails. One pass over a sample, drawn evenly from all rows, estimates
for every rule how many documents it rejects and what it costs: the steps that its measures take, counted from the
documents' sizes, so that equal tables give equal orders. The rules are ordered by rejections per cost, and the cascade is
one CASE expression, so later rules of a rejected document, and measures that only they need, are never evaluated. A
document is kept if it fails no rule, so the order changes the work and the reported ``rejected_by``, never the verdict.

Defined results: a null or empty text has no words and fails; rules use whole texts; a null in another column is
carried; ties and repeated rows are judged alike; clashing columns of the input are replaced by the operator's own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: Above this many distinct repeated windows, positions are found by sorting and not by scanning the repeated ones.
SCANNED = 48


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, however often and deep in lambdas the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, an empty array where it has none."""

    def trimmed(xs: Column) -> Column:
        lead = F.when(F.element_at(xs, 1) == "", 1).otherwise(0)
        trail = F.when(F.element_at(xs, -1) == "", 1).otherwise(0)
        return F.when(lead + trail == 0, xs).otherwise(F.slice(xs, lead + 1, F.greatest(F.lit(0), F.size(xs) - lead - trail)))

    return let(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), trimmed)


def word_chars(ws: Column) -> Column:
    return F.length(F.array_join(ws, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))


def n_dup_lines(text: Column) -> Column:
    return let(lines_with_words(text), lambda xs: F.size(xs) - F.size(F.array_distinct(xs))).cast("long")


def n_repeat_words(ws: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Windows are compared by 64-bit hashes."""

    def covered(places: Column) -> Column:
        # places: ascending starts of repeated windows; each covers 3 words, less what the next one covers too
        gaps = F.zip_with(places, F.slice(places, F.lit(2), F.size(places)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    def few(hs: Column, again: Column) -> Column:
        return F.filter(F.transform(hs, lambda h, i: F.when(F.array_contains(again, h), i)), lambda i: i.isNotNull())

    def many(hs: Column) -> Column:
        ordered = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(xs: Column) -> Column:
            twice = F.transform(xs, lambda x, k: F.when((F.get(xs, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(xs, k + 1)["h"].eqNullSafe(x["h"])), x["i"]))
            return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))

        return let(ordered, starts)

    def repeated(hs: Column) -> Column:
        return let(F.sort_array(hs), lambda s: F.array_distinct(F.filter(F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a == b, a)), lambda h: h.isNotNull())))

    def count(hs: Column) -> Column:
        spread = let(repeated(hs), lambda again: let(F.when(F.size(again) <= SCANNED, few(hs, again)).otherwise(many(hs)), covered))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(spread)

    def windows(xs: Column) -> Column:
        return F.transform(F.slice(xs, F.lit(1), F.size(xs) - 2), lambda w, i: F.xxhash64(w, F.get(xs, i + 1), F.get(xs, i + 2)))

    return let(ws, lambda xs: F.when(F.size(xs) < 3, F.lit(0)).otherwise(let(windows(xs), count))).cast("long")


@dataclass(frozen=True)
class Rule:
    """fails: from the columns of measured() to a boolean that is true where the document goes."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: What a rule may ask for, by name, from the text and its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, ws: F.size(ws).cast("long"),
    "word_chars": lambda text, ws: word_chars(ws),
    "n_symbols": lambda text, ws: n_symbols(text),
    "n_dup_lines": lambda text, ws: n_dup_lines(text),
    "n_repeat_words": lambda text, ws: n_repeat_words(ws),
    "n_lines": lambda text, ws: F.size(lines_with_words(text)).cast("long"),
}

#: Steps that a measure takes for a document, in characters read once; a word that is hashed, sorted or looked up is STEP of them.
STEP = 8
STEPS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, ws: F.length(text),
    "word_chars": lambda text, ws: F.length(text) + F.size(ws),
    "n_symbols": lambda text, ws: 2 * F.length(text),
    "n_dup_lines": lambda text, ws: 2 * F.length(text) + STEP * F.size(F.split(text, "\n")),
    "n_repeat_words": lambda text, ws: F.length(text) + STEP * F.size(ws) * F.log2(F.size(ws) + 2),
    "n_lines": lambda text, ws: 2 * F.length(text),
}

#: Few words, and repetition: the base rules. The others: word length, symbols, and repeated lines.
BASE = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
)
RULES = (
    *BASE,
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 14 * m("n_words"))),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: (m("n_dup_lines") >= 3) & (10 * m("n_dup_lines") > 3 * m("n_lines"))),
)
#: What op 6 returns of every document, whatever rejects it.
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures_of(rule: Rule) -> list[str]:
    """Names of the measures that a rule asks for."""
    asked: dict[str, None] = {}

    def measure(name: str) -> Column:
        asked[name] = None
        return F.col(name)

    rule.fails(measure)
    return list(asked)


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = 2000) -> list[Rule]:
    """The rules by rejections per step, both estimated in one job over a sample of about sample_rows rows."""
    total = docs.count()
    some = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    some = some.sample(sample_rows / total, seed=7) if total > sample_rows else some
    some = some.withColumn("ws", words(F.col("text")))
    text, ws = F.col("text"), F.col("ws")
    rejected = [F.count_if(F.coalesce(r.fails(lambda name: MEASURES[name](text, ws)), F.lit(False))) for r in rules]
    steps = [F.sum(sum((STEPS[name](text, ws).cast("double") for name in measures_of(r)), F.lit(0.0))) for r in rules]
    found = some.agg(*rejected, *steps).first()
    worth = [(found[i] or 0) / max(1.0, found[len(rules) + i] or 0.0) for i in range(len(rules))]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-worth[i], i))]


def verdict(order: list[Rule], measure: Callable[[str], Column]) -> Column:
    """Name of the first rule that rejects, null where none does."""
    case = None
    for rule in order:
        case = F.when(rule.fails(measure), F.lit(rule.name)) if case is None else case.when(rule.fails(measure), F.lit(rule.name))
    return case


def judge(docs: DataFrame, order: list[Rule], text_col: str = "text") -> DataFrame:
    """docs with the RETURNED measures, base_failed, rejected_by and kept; other measures are worked out only for rows that their rule sees."""
    text = F.col(text_col)
    df = docs.withColumn("_words", words(text)).withColumns({k: MEASURES[k](text, F.col("_words")) for k in RETURNED})
    base = F.lit(False)
    for rule in BASE:
        base = base | rule.fails(F.col)
    first = verdict(order, lambda name: F.col(name) if name in RETURNED else MEASURES[name](text, F.col("_words")))
    df = df.withColumn("base_failed", base).withColumn("rejected_by", first).drop("_words")
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def keep(docs: DataFrame, order: list[Rule], text_col: str = "text") -> DataFrame:
    """The documents that pass; a measure is worked out only for rows that its rule sees."""
    text = F.col(text_col)
    return docs.filter(let(words(text), lambda ws: verdict(order, lambda name: MEASURES[name](text, ws))).isNull())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, cascade_order(docs))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), w AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM w) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words
    OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)) AS kept
FROM m
"""
