"""Table schemas. Nothing is inferred: readers take these, and writers are checked against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


#: Columns per table, as Spark DDL. Money is decimal, ratios are worked out in double.
DDL = {
    "companies": "cik string, ticker string, name string, sic string, created_at timestamp",
    "filings": "id long, cik string, accession string, form string, filing_date date, period_end date, fiscal_year int, primary_doc string, source_url string, created_at timestamp",
    "sections": "id long, filing_id long, item string, title string, ordinal int, char_len int, body string",
    "chunks": "id long, filing_id long, section_id long, strategy string, ordinal int, token_est int, body string, embedding array<float>, created_at timestamp",
    "xbrl_facts": "id long, cik string, taxonomy string, tag string, unit string, fiscal_year int, fiscal_period string, period_start date, period_end date, value decimal(38,6), accession string, form string, prior_year_value decimal(38,6)",
    "eval_runs": "id long, run_key string, git_sha string, label string, config string, started_at timestamp, finished_at timestamp, n_cases int, summary string",
    "eval_results": "id long, run_id long, case_id string, kind string, passed boolean, score double, retrieval string, latency_ms int, prompt_tokens int, completion_tokens int, cost_usd double, answer string, expected string, question string, context_text string, judge_rationale string, agent string",
    "judge_calibration": "id long, case_id string, answer_hash string, human_label boolean, labeller string, notes string, created_at timestamp",
    "agent_traces": "id long, trace_id string, question string, steps string, outcome string, total_latency_ms int, total_cost_usd double, created_at timestamp",
    "refresh_runs": "id long, started_at timestamp, finished_at timestamp, status string, filings_added int, trigger string, git_sha string, new_filings string, report string",
    "golden_cases": "case_id string, ordinal int, body string, refresh_run_id long, added_at timestamp",
    "eval_case": "case_id string, kind string, question string, expected string, expected_value double, unit string, relevant_chunk_ids array<string>, ticker string, fiscal_year int, tag string, difficulty string, notes string",
}

#: Columns that are unique together; writers dedupe on them (Spark has no constraint of its own).
KEYS = {
    "companies": ["cik"],
    "filings": ["accession"],
    "chunks": ["filing_id", "strategy", "ordinal"],
    "xbrl_facts": ["cik", "taxonomy", "tag", "unit", "fiscal_year", "fiscal_period"],
    "eval_runs": ["run_key"],
    "eval_results": ["run_id", "case_id"],
    "judge_calibration": ["case_id", "answer_hash"],
    "golden_cases": ["case_id"],
}


def schema(name: str) -> T.StructType:
    return _schema(DDL[name])


def create_tables(spark, location: str) -> list[str]:
    """Creates every missing table as Parquet under the location; re-runnable."""
    for name, ddl in sorted(DDL.items()):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet LOCATION '{location}/{name}'")
    return sorted(DDL)


def duplicates(df: DataFrame, name: str) -> DataFrame:
    """Keys of the table that are there more than once; empty where the constraint holds."""
    return df.groupBy(*KEYS[name]).count().filter("count > 1")


def existing(spark, names: list[str] | None = None) -> DataFrame:
    """table, column and type of the tables that the catalog has."""
    rows = [(n, c.name, c.dataType) for n in (names or sorted(DDL)) if spark.catalog.tableExists(n) for c in spark.catalog.listColumns(n)]
    return spark.createDataFrame(rows, "table string, column string, type string")


def rekeyed(df: DataFrame, old: list[str], new: list[str], order: list[str]) -> DataFrame:
    """df under a narrower key: one row of each new key, the first in order. A table that holds to the new key already stays as it is."""
    if set(old) == set(new):
        return df
    w = Window.partitionBy(*new).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
