"""Training examples: passages with labels, negatives, the split by company, its manifest, worked examples and audit samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunking, extraction
from .golden import with_negatives
from .sampling import held_out_split, shuffled

#: An example's sizes, and what figures a table prints.
MOST_CHARS, FEW_FACTS, MANY_FACTS, LEAST_FIGURES = 1400, 2, 6, 3
FIGURE = r"\d{1,3}(?:,\d{3})+|\d+\.\d+"
COUNTS = ("passages", "labelled", "dropped_labels", "ambiguous", "too_long")


def examples(sections: DataFrame, facts: DataFrame, target: int = 512, overlap: int = 64, most_chars: int = 3000) -> DataFrame:
    """Passages with their labels, state and id. sections: filing_id, cik, ticker, sector, accession, fiscal_year, ordinal, id, item, title, body.

    state: positive (labelled), candidate (nothing found, a negative to choose from), or why it is left out: too_long,
    ambiguous (one figure under two names), dropped (figures found, none of them named).
    """
    filings = sections.select("filing_id", "cik", "ticker", "sector", "accession", "fiscal_year").distinct()
    chunks = chunking.chunked_sections(sections, "filing_id", target, overlap)
    passages = chunks.join(filings, "filing_id").withColumn("passage_id", F.concat_ws("-", "accession", F.col("ordinal").cast("string")))
    found = extraction.labelled(passages, facts)
    state = (
        F.when(F.length("body") > most_chars, "too_long")
        .when(F.col("ambiguous"), "ambiguous")
        .when(F.size("labels") > 0, "positive")
        .when(F.size("dropped") > 0, "dropped")
        .otherwise("candidate")
    )
    figures = F.size(F.regexp_extract_all("body", F.lit(FIGURE), F.lit(0)))
    return found.withColumn("state", state).withColumn("has_figures", figures >= LEAST_FIGURES)


def dataset(found: DataFrame, ratio: float = 0.25, per_sector: int = 1, seed: str = "13") -> DataFrame:
    """Positives and chosen negatives of examples, with held_out by company: no company is on both sides."""
    positives, rest = found.filter("state = 'positive'"), found.filter("state = 'candidate'")
    chosen = positives.unionByName(with_negatives(positives.select("ticker"), rest, "ticker", "passage_id", "has_figures", ratio).select(*found.columns))
    return held_out_split(chosen, "sector", "ticker", per_sector, seed)


def manifest(rows: DataFrame) -> DataFrame:
    """What freezes a dataset, by side: examples, positives, negatives, facts, companies and accessions, and a digest of its records."""
    line = F.md5(F.to_json(F.struct("passage_id", "body", "labels"), {"ignoreNullFields": "false"}))
    part = lambda at: F.sum(F.conv(F.substring(line, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = rows.groupBy("held_out").agg(
        F.count(F.lit(1)).alias("examples"), F.count_if(F.size("labels") > 0).alias("positives"), F.count_if(F.size("labels") == 0).alias("negatives"),
        F.sum(F.size("labels")).alias("facts"), F.count_distinct("ticker").alias("companies"), F.count_distinct("accession").alias("accessions"), part(1).alias("_a"), part(17).alias("_b"),
    )
    return sums.withColumn("digest", F.sha2(F.concat_ws("/", "_a", "_b"), 256)).drop("_a", "_b")


def sides_by_sector(rows: DataFrame) -> DataFrame:
    """The companies of each sector on either side."""
    return rows.groupBy("sector").agg(
        F.sort_array(F.collect_set(F.when(~F.col("held_out"), F.col("ticker")))).alias("train"), F.sort_array(F.collect_set(F.when(F.col("held_out"), F.col("ticker")))).alias("held_out")
    )


def write_records(rows: DataFrame, path: str) -> None:
    """Examples as JSON lines, nulls written out."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def shots(rows: DataFrame, positives: int = 3, most_chars: int = MOST_CHARS, seed: str = "7") -> list[dict]:
    """Worked examples for a prompt: positives of different companies that each add concepts, and a table that states no fact.

    The choice is greedy, one round a shot: a round takes the first row, in seeded order, of a company not met that adds a
    concept; a row at a time comes to the driver. rows: passage_id, ticker, body, labels.
    """
    short = rows.filter(F.length("body") <= most_chars)
    some = short.filter(F.size("labels").between(FEW_FACTS, MANY_FACTS))
    order = [shuffled("passage_id", seed), "passage_id"]
    out: list[dict] = []

    def first(found: DataFrame, met: list[str], known: list[str]) -> dict | None:
        left = found.filter(~F.col("ticker").isin(met)) if met else found
        if known:
            left = left.filter(F.exists("labels", lambda x: ~x["concept"].isin(known)))
        row = left.orderBy(*order).limit(1).collect()
        return row[0].asDict(recursive=True) if row else None

    while len(out) < positives and (row := first(some, [r["ticker"] for r in out], sorted({x["concept"] for r in out for x in r["labels"]}))):
        out.append(row)
    figures = F.size(F.regexp_extract_all("body", F.lit(FIGURE), F.lit(0)))
    tables = short.filter((F.size("labels") == 0) & (figures >= LEAST_FIGURES))
    return out + [r for r in [first(tables, [r["ticker"] for r in out], [])] if r]


def audit_sample(rows: DataFrame, n_labels: int = 50, n_negatives: int = 10, seed: str = "29") -> DataFrame:
    """Labels, drawn evenly over facts and not over passages, and negatives to check by hand: kind, n, passage_id, concept, fiscal_year, value."""
    facts = rows.select("passage_id", "ticker", F.explode("labels").alias("x")).select("passage_id", "ticker", "x.concept", "x.fiscal_year", "x.value")
    facts = facts.withColumn("key", F.concat_ws("|", "passage_id", "concept", F.col("fiscal_year").cast("string"), F.col("value").cast("string")))
    none = lambda t: F.lit(None).cast(t)
    bare = rows.filter(F.size("labels") == 0).select("passage_id", "ticker", none("string").alias("concept"), none("int").alias("fiscal_year"), none("double").alias("value"), F.col("passage_id").alias("key"))

    def drawn(df: DataFrame, kind: str, n: int) -> DataFrame:
        some = df.orderBy(shuffled("key", seed), "key").limit(n)  # a few rows, numbered in one task
        return some.withColumn("n", F.row_number().over(Window.orderBy(shuffled("key", seed), "key"))).withColumn("kind", F.lit(kind))

    return drawn(facts, "label", n_labels).unionByName(drawn(bare, "negative", n_negatives)).drop("key")


def label_sample(results: DataFrame, n: int = 40, seed: str = "5") -> DataFrame:
    """Results for human labelling: half of n drawn from the passes and half from the fails (case_id, passed)."""
    w = Window.partitionBy("passed").orderBy(shuffled("case_id", seed), "case_id")
    return results.filter(F.col("passed").isNotNull()).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n // 2).drop("_n")


def prompts(rows: DataFrame, instruction: str) -> DataFrame:
    """prompt and completion of each example, as a trainer takes them: the completion is the labels as JSON."""
    return rows.select("passage_id", F.concat(F.lit(instruction + "\n\n"), "body").alias("prompt"), F.to_json("labels").alias("completion"))
