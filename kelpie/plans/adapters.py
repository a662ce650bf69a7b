"""The engine's relations, taken from the star schema: nations are companies, customers file, their orders are entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

#: The same relations for DuckDB.
RAW = """
raw AS (
  SELECT c.c_nationkey::VARCHAR AS cik, 'us-gaap' AS taxonomy, t.tag, t.unit, year(o.o_orderdate)::INT AS fiscal_year, o.o_orderkey AS ord,
    lpad(c.c_custkey::VARCHAR, 10, '0') AS accession, o.o_orderdate::DATE AS period_end, t.value
  FROM (
    SELECT l_orderkey, 'Revenues' AS tag, 'USD' AS unit, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS value FROM lineitem GROUP BY 1
    UNION ALL SELECT l_orderkey, 'Units', 'items', sum(l_quantity::BIGINT)::BIGINT FROM lineitem GROUP BY 1
    UNION ALL SELECT l_orderkey, 'Discount', 'points', sum(round(l_discount * 100)::BIGINT)::BIGINT FROM lineitem GROUP BY 1
  ) t JOIN orders o ON t.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
), won AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, taxonomy, tag, unit, fiscal_year ORDER BY accession, ord) AS r FROM raw) WHERE r = 1
), filed AS (
  SELECT c_nationkey::VARCHAR AS cik, year(o_orderdate)::INT AS fiscal_year, lpad(max(o_orderkey)::VARCHAR, 10, '0') AS accession, max(o_orderdate)::DATE AS period_end
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
)
"""


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per order and tag, in whole units."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("a"),
        F.sum(F.col("l_quantity").cast("long")).alias("b"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("c"),
    )
    each = F.array(*[F.struct(F.lit(tag).alias("tag"), F.lit(unit).alias("unit"), F.col(v).alias("value")) for tag, unit, v in (("Revenues", "USD", "a"), ("Units", "items", "b"), ("Discount", "points", "c"))])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = sums.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("c_nationkey").cast("string").alias("cik"), F.lit("us-gaap").alias("taxonomy"), F.year("o_orderdate").alias("fiscal_year"), F.col("o_orderkey").alias("ord"),
        F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("accession"), F.col("o_orderdate").cast("date").alias("period_end"), F.inline(each),
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = rows.groupBy(F.col("c_nationkey").cast("string").alias("cik"), F.year("o_orderdate").alias("fiscal_year"))
    return out.agg(F.lpad(F.max("o_orderkey").cast("string"), 10, "0").alias("accession"), F.max("o_orderdate").cast("date").alias("period_end"))
