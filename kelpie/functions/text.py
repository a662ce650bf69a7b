"""Text functions as columns: terms, needles, cues, screens. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Narrative stopwords.
STOPWORDS = (
    "about after also because been being company could does during fiscal from have into more other report reports reported says states "
    "that their these they this through under uses using were which while with year"
).split()

#: Words of a question that point to an Item, in priority order.
ITEM_CUES = [
    ("3", ("legal proceeding", "lawsuit", "litigation", "court", "antitrust", "regulatory proceeding", "sued", "settlement")),
    ("1A", ("risk factor", "risks", "risk", "supplier concentration", "dependence on", "could adversely", "vulnerab", "competitive pressure", "competition")),
    ("7A", ("market risk", "foreign currency", "exchange rate", "interest rate", "hedg", "derivative", "commodity price")),
    ("7", ("md&a", "management's discussion", "drivers of", "results of operations", "revenue change", "gross margin", "liquidity", "cash flow")),
    ("8", ("financial statement", "balance sheet", "income statement", "footnote", "accounting polic")),
    ("1", ("business", "products", "segments", "customers", "employees", "supply chain", "manufactur", "distribution")),
    ("2", ("propert", "facilities", "headquarters", "real estate")),
    ("9A", ("internal control", "disclosure controls", "material weakness")),
]

#: Fixed value: refusals to answer.
ABSTENTION = (
    r"(?i)\b(?:does not (?:provide|contain|include|specify|mention|state)|do not (?:provide|contain|include|specify|mention|state)"
    r"|is not (?:provided|available|specified|mentioned|included)|are not (?:provided|available|specified|mentioned)"
    r"|no (?:information|data|figure|mention)|not (?:stated|disclosed|available|specified) in the (?:context|passages?|filing)"
    r"|(?:has|have) not (?:yet )?(?:been )?(?:reported|filed)|not yet (?:been )?(?:reported|filed|available)"
    r"|cannot (?:be )?(?:determine|determined|answer|be answered)|unable to (?:determine|answer))\b"
)


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def or_terms(text: Column, most: int = 24) -> Column:
    """Distinct tokens of two characters or more, first met first, at most ``most``."""
    return F.slice(F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= 2)), 1, most)


def or_query(text: Column, most: int = 24) -> Column:
    return F.array_join(or_terms(text, most), " | ")


def reference_terms(text: Column, most: int = 24) -> Column:
    """Distinct telling terms of a reference answer."""
    telling = F.filter(tokens(text), lambda t: (F.length(t) >= 4) & ~t.rlike("^[0-9]+$"))
    return F.slice(F.array_except(telling, F.array(*map(F.lit, STOPWORDS))), 1, most)


def ilike_all(text: Column, needles: list[str]) -> Column:
    """Whether every needle is in the text, whatever the case; % and _ in a needle stay wildcards."""
    return reduce(lambda a, b: a & b, [text.ilike(f"%{n}%") for n in needles], F.lit(True))


def item_hits(text: Column) -> Column:
    """array<struct<minus_hits, priority, item>> of the Items that the text's words point to, best first."""
    low = F.lower(text)
    found = [
        F.struct((-sum((low.contains(cue).cast("int") for cue in cues), F.lit(0))).alias("minus_hits"), F.lit(i).alias("priority"), F.lit(item).alias("item"))
        for i, (item, cues) in enumerate(ITEM_CUES)
    ]
    return F.array_sort(F.filter(F.array(*found), lambda x: x["minus_hits"] < 0))


def inferred_items(text: Column) -> Column:
    return F.transform(item_hits(text), lambda x: x["item"])


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def is_abstention(answer: Column) -> Column:
    return answer.rlike(ABSTENTION)


def screen(question: Column, out_of_scope: list[str] = ()) -> Column:
    """struct(allowed, reason): too short, too long, or the first out-of-scope pattern that matches."""
    n = F.length(F.trim(F.coalesce(question, F.lit(""))))
    reason = F.when(n < 3, F.lit("too short")).when(n > 2000, F.lit("too long"))
    for pattern in out_of_scope:
        reason = reason.when(question.rlike(pattern), F.lit("out of scope"))
    return F.struct(reason.isNull().alias("allowed"), F.coalesce(reason, F.lit("")).alias("reason"))


def neutralise(text: Column, markers: list[str], most: int) -> Column:
    """struct(text, flagged): quoted marker phrases, cut to ``most`` characters with a suffix."""
    out, flagged = text, F.lit(False)
    for m in markers:
        flagged = flagged | text.rlike(m)
        out = F.regexp_replace(out, m, "[quoted document text: $0]")
    cut = F.when(F.length(out) > most, F.concat(F.substring(out, 1, most), F.lit(" …[truncated]"))).otherwise(out)
    return F.struct(cut.alias("text"), flagged.alias("flagged"))


def citations_ok(cited: Column, available: Column) -> Column:
    return F.size(F.array_except(cited, available)) == 0


def numbers(text: Column) -> Column:
    """The figures of a text as doubles, separators dropped."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double"))


def ungrounded(answer: Column, sources: Column) -> Column:
    """Figures of the answer of 1000 or more, no years, that no source figure matches as printed, in thousands or in millions."""
    mine = F.array_distinct(F.filter(numbers(answer), lambda x: (x >= 1000) & ~((x >= 1900) & (x <= 2100) & (x == F.floor(x)))))
    theirs = numbers(sources)

    def met(x: Column) -> Column:
        near = lambda s: F.exists(theirs, lambda y: F.abs(y * s - x) <= F.greatest(F.lit(1.0), F.abs(x) * 1e-6))
        return near(1.0) | near(1e3) | near(1e6)

    return F.filter(mine, lambda x: ~met(x))


def answer_hash(answer: Column) -> Column:
    """Twelve hex digits of the answer's hash; null is hashed as an empty text."""
    return F.substring(F.sha2(F.coalesce(answer, F.lit("")), 256), 1, 12)
