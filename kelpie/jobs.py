"""Batch jobs over staged raw files: ingestion, re-derivation of facts, index builds, staging, and the logs of runs.

A job makes DataFrames and publishes new versions of tables together (sources.sinks); nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpie.functions.figures import fiscal_year_of
from kelpie.operators import chunking, facts, html
from kelpie.sources import sinks, tables

#: Columns that name a chunk within its table, and the separator of sections in one text.
BETWEEN = "\n\n"


def stable_id(*keys: str):
    """An id worked out from a row's natural key before it is written: 62 bits of its md5, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 15), 16, 10).cast("long")


def with_ids(df: DataFrame, keys: list[str], out: str = "id") -> DataFrame:
    """df with ids of its rows' natural keys, known without asking a sequence."""
    return df.withColumn(out, stable_id(*keys))


def fetched_filings(listed: DataFrame, pages: DataFrame) -> DataFrame:
    """Listed filings with their page (accession, html) and error: what kept a filing from being parsed, null where nothing did."""
    both = listed.join(pages.select("accession", "html"), "accession", "left")
    error = F.when(F.col("html").isNull(), "no document").when(F.trim("html") == "", "empty document")
    return both.withColumn("error", error)


def ingested(companies: DataFrame, submissions: DataFrame, pages: DataFrame, company_facts: DataFrame, forms: list[str], newest: int) -> dict[str, DataFrame]:
    """New companies, filings, sections and facts of staged raw files, and the errors by company; one company's error stops no other.

    companies: cik, ticker, title. submissions: cik, page, json. pages: accession, html. company_facts: cik, json.
    """
    listed = tables.filing_rows(submissions, forms, newest)
    listed = with_ids(listed.withColumn("fiscal_year", fiscal_year_of(F.col("period_end"), F.lit(None).cast("int"))), ["accession"])
    listed = listed.withColumn("source_url", tables.filing_url(F.col("cik"), F.col("accession"), F.col("primary_doc")))
    found = fetched_filings(listed, pages)
    split = html.with_sections(html.with_text(found.filter("error IS NULL").select(F.col("id").alias("filing_id"), "html"), "html").select("filing_id", "body"))
    bad_index = submissions.select("cik", F.from_json("json", tables.SUBMISSIONS).alias("b")).filter(F.col("b.accessionNumber").isNull()).select("cik", F.lit("unreadable index").alias("error"))
    entries = facts.exploded(company_facts)
    no_facts = company_facts.select("cik").join(entries.select("cik").distinct(), "cik", "left_anti").select("cik", F.lit("no facts").alias("error"))
    return {
        "companies": companies.select("cik", "ticker", F.col("title").alias("name")),
        "filings": listed.select("id", "cik", "accession", "form", "filing_date", "period_end", "fiscal_year", "primary_doc", "source_url"),
        "sections": with_ids(split, ["filing_id", "ordinal"]).select("id", "filing_id", "item", "title", "ordinal", "char_len", "body"),
        "xbrl_facts": derived_facts(entries, forms),
        "errors": found.filter("error IS NOT NULL").select("cik", "error").unionByName(bad_index).unionByName(no_facts),
    }


FACT_KEY = ["cik", "taxonomy", "tag", "unit", "fiscal_year", "fiscal_period"]


def derived_facts(entries: DataFrame, forms: list[str]) -> DataFrame:
    """Annual facts of raw entries, one per key, with the year before as the same filing printed it."""
    annual = facts.annual(entries, forms).withColumn("fiscal_period", F.lit("FY")).withColumnRenamed("val", "value")
    kept = facts.prior_as_printed(facts.earliest(annual, FACT_KEY), annual)
    return with_ids(kept, FACT_KEY).select("id", *FACT_KEY, "period_start", "period_end", "value", "accession", "form", "prior_year_value")


def merged(held: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after a full ingest: companies and filings updated, sections of new filings replaced, facts added where their key is new."""
    return {
        "companies": sinks.upsert(held["companies"], new["companies"], ["cik"], keep_old=("sic",)),
        "filings": sinks.upsert(held["filings"], new["filings"], ["accession"], only=("period_end", "fiscal_year", "source_url")),
        "sections": sinks.replace_groups(held["sections"], new["sections"], "filing_id"),
        "xbrl_facts": sinks.insert_missing(held["xbrl_facts"], new["xbrl_facts"], FACT_KEY),
    }


def refreshed_facts(held: dict[str, DataFrame], company_facts: DataFrame, forms: list[str]) -> DataFrame:
    """The facts table re-derived for companies that are held, and only for those that have raw facts; other tables stay as they are."""
    known = company_facts.join(held["companies"].select("cik"), "cik", "left_semi")
    fresh = derived_facts(facts.exploded(known), forms)
    return sinks.replace_groups(held["xbrl_facts"], fresh, "cik")


def label_problem(strategy: str, label: str | None) -> str | None:
    """Why a label can't name an index of a strategy, or None."""
    if not label:
        return None
    if label != label.strip():
        return "a label has no blanks around it"
    others = {"fixed", "recursive", "semantic", "section_aware"} - {strategy}
    return f"{label!r} is the index of another strategy" if label in others else None


def replacement_problem(strategies: list[str], served: str, chunks: DataFrame, suffix: str = "", replace: bool = False) -> str | None:
    """Why a build must not replace the served index in place, or None."""
    if suffix or replace or served not in strategies or chunks.filter(F.col("strategy") == served).isEmpty():
        return None
    return f"{served!r} is served and labelled; build it under a suffix, or ask for its replacement"


def built_chunks(sections: DataFrame, strategy: str, target: int = 512, overlap: int = 64, label: str | None = None) -> DataFrame:
    """Chunks of every filing under a strategy. sections: filing_id, id, ordinal, item, title, body.

    Only section_aware sees the sections; the others cut the whole text, sections joined by a blank line.
    """
    if (problem := label_problem(strategy, label)) is not None:
        raise ValueError(problem)
    if strategy == "section_aware":
        rows = chunking.chunked_sections(sections, "filing_id", target, overlap)
        rows = rows.withColumn("token_est", chunking.token_est())
    elif strategy == "fixed":
        rows = chunking.fixed_of_parts(sections, "filing_id", BETWEEN, target, overlap)
        rows = rows.withColumns({"token_est": chunking.token_est(), "section_id": F.lit(None).cast("long")})
    else:
        parts = F.array_sort(F.collect_list(F.struct("ordinal", "body")))
        whole = sections.groupBy("filing_id").agg(F.array_join(F.transform(parts, lambda p: p["body"]), BETWEEN).alias("text"))
        more = {} if strategy == "semantic" else {"overlap": overlap}
        rows = chunking.chunked(whole, strategy, "text", target, **more).withColumn("section_id", F.lit(None).cast("long"))
    rows = rows.withColumn("strategy", F.lit(label or strategy))
    return with_ids(rows, ["filing_id", "strategy", "ordinal"]).select("id", "filing_id", "section_id", "strategy", F.col("ordinal").cast("int").alias("ordinal"), "token_est", "body")


def embedded_pending(chunks: DataFrame, embed: Callable[[list[str]], np.ndarray] = chunking.hashing_vectors) -> DataFrame:
    """chunks with an embedding in every row; rows that have one are passed by, so a stopped build goes on where it was."""
    left = chunking.embedded(chunks.filter("embedding IS NULL").drop("embedding"), "body", embed)
    return chunks.filter("embedding IS NOT NULL").unionByName(left.select(*chunks.columns))


def write_index(chunks: DataFrame, path: str) -> None:
    """Puts the chunks' strategies in place of what the index holds of them; other strategies stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy").parquet(path)


def index_rows(held: DataFrame, new: DataFrame) -> DataFrame:
    """The index after a build: of the strategies built only the new rows, one for each (filing_id, strategy, ordinal)."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy("filing_id", "strategy", "ordinal").orderBy(F.desc("id")))).filter("_n = 1").drop("_n")
    return sinks.replace_groups(held, last, "strategy")


def staged(spark: SparkSession, live: dict[str, str], root: str, names: list[str]) -> dict[str, int]:
    """Copies live tables (name: path) into an empty staging folder; refuses one that holds rows. Returns the rows of each."""
    counts = {}
    for name in names:
        target = f"{root}/{name}"
        fs, at = sinks._fs(spark, target)
        if fs.exists(at) and not spark.read.parquet(target).isEmpty():
            raise RuntimeError(f"staging holds rows of {name}")
        spark.read.parquet(live[name]).write.mode("overwrite").parquet(target)
        counts[name] = spark.read.parquet(target).count()
    return counts


def logged(spark: SparkSession, path: str, rows: DataFrame, strict: bool = True) -> bool:
    """Appends rows to a log with the time they were written; a log that is not strict (traces) never fails its caller."""
    try:
        rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
        return True
    except Exception:  # noqa: BLE001 - a trace that can't be written must not stop an answer
        if strict:
            raise
        return False
