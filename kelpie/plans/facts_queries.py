"""Queries over annual facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions.figures import ratio
from kelpie.operators import facts as op

from .adapters import RAW, filings, raw_facts
from .registry import query, table

WITH = "WITH " + RAW


def _won(spark, sf):
    return op.earliest(raw_facts(spark, sf), [*op.SERIES, "fiscal_year"])


@query(WITH + "SELECT cik, tag, fiscal_year, accession, value FROM won")
def fact_dedup_earliest(spark, sf):
    return _won(spark, sf).select("cik", "tag", "fiscal_year", "accession", "value")


_PRIOR = """, printed AS (
  SELECT cik, taxonomy, tag, unit, accession, fiscal_year + 1 AS fiscal_year, arg_min(value, ord) AS prior_year_value FROM raw GROUP BY 1, 2, 3, 4, 5, 6
), prior AS (SELECT won.*, p.prior_year_value FROM won LEFT JOIN printed p USING (cik, taxonomy, tag, unit, accession, fiscal_year))
"""


@query(WITH + _PRIOR + "SELECT cik, tag, fiscal_year, value, prior_year_value FROM prior")
def fact_prior_as_printed(spark, sf):
    raw = raw_facts(spark, sf)
    return op.prior_as_printed(op.earliest(raw, [*op.SERIES, "fiscal_year"]), raw).select("cik", "tag", "fiscal_year", "value", "prior_year_value")


@query(
    WITH + _PRIOR + """, y AS (
  SELECT *, lag(fiscal_year) OVER w AS before, lag(value) OVER w AS own FROM prior WINDOW w AS (PARTITION BY cik, taxonomy, tag, unit ORDER BY fiscal_year)
), b AS (SELECT *, coalesce(prior_year_value, own) AS base FROM y WHERE before = fiscal_year - 1)
SELECT cik, tag, fiscal_year, base, floor((value - base)::DOUBLE / abs(base)::DOUBLE * 100 * 100)::BIGINT AS change_bp FROM b WHERE base <> 0"""
)
def yoy_change(spark, sf):
    raw = raw_facts(spark, sf)
    out = op.year_over_year(op.prior_as_printed(op.earliest(raw, [*op.SERIES, "fiscal_year"]), raw))
    return out.select("cik", "tag", "fiscal_year", "base", F.floor(F.col("change_pct") * 100).alias("change_bp"))


@query(
    WITH + """SELECT a.cik, a.fiscal_year, floor(a.value::DOUBLE / nullif(b.value, 0)::DOUBLE * 1000000)::BIGINT AS ratio_ppm
FROM won a JOIN won b ON a.cik = b.cik AND a.fiscal_year = b.fiscal_year AND a.tag = 'Discount' AND b.tag = 'Units'"""
)
def fact_ratio(spark, sf):
    won = _won(spark, sf)
    top = won.filter("tag = 'Discount'").select("cik", "fiscal_year", F.col("value").alias("top"))
    bottom = won.filter("tag = 'Units'").select("cik", "fiscal_year", F.col("value").alias("bottom"))
    both = top.join(bottom, ["cik", "fiscal_year"])
    return both.select("cik", "fiscal_year", F.floor(ratio(F.col("top").cast("double"), F.col("bottom").cast("double")) * 1_000_000).alias("ratio_ppm"))


@query(
    WITH + """, n AS (
  SELECT *, lead(fiscal_year) OVER w AS next_year, lead(period_end) OVER w AS next_end FROM won WINDOW w AS (PARTITION BY cik, taxonomy, tag, unit ORDER BY fiscal_year)
)
SELECT cik, tag, fiscal_year, next_year, (next_end - period_end)::INT AS days FROM n
WHERE next_year IS NOT NULL AND NOT ((next_end - period_end) BETWEEN (next_year - fiscal_year) * 340 AND (next_year - fiscal_year) * 380)"""
)
def misdated_pairs(spark, sf):
    return op.misdated(_won(spark, sf)).select("cik", "tag", "fiscal_year", "next_year", "days")


@query(
    """WITH f AS (SELECT DISTINCT o_custkey::VARCHAR AS cik, year(o_orderdate)::INT AS fiscal_year FROM orders),
s AS (SELECT cik, unnest(range(min(fiscal_year), max(fiscal_year) + 1))::INT AS fiscal_year FROM f GROUP BY cik)
SELECT cik, fiscal_year FROM s ANTI JOIN f USING (cik, fiscal_year)"""
)
def missing_years(spark, sf):
    return op.missing_years(table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("cik"), F.year("o_orderdate").alias("fiscal_year")))


@query(WITH + "SELECT accession, tag, fiscal_year, count(DISTINCT value) AS n_values, min(value) AS least FROM raw GROUP BY 1, 2, 3 HAVING count(DISTINCT value) > 1")
def conflicts(spark, sf):
    out = op.conflicts(raw_facts(spark, sf), ["accession", "tag", "fiscal_year"])
    return out.select("accession", "tag", "fiscal_year", "n_values", F.element_at("values", 1).alias("least"))


@query(
    WITH + """, fam AS (SELECT * FROM (VALUES ('Units', 'size', 0), ('Revenues', 'size', 1)) v(tag, family, preference)),
m AS (SELECT raw.*, fam.family, fam.preference FROM raw LEFT JOIN fam USING (tag)),
r AS (SELECT *, row_number() OVER (PARTITION BY cik, family, fiscal_year ORDER BY preference, ord) AS k FROM m)
SELECT cik, tag, fiscal_year, accession, value FROM r WHERE family IS NULL OR k = 1"""
)
def canonical_tag(spark, sf):
    families = spark.createDataFrame([("Units", "size", 0), ("Revenues", "size", 1)], "tag string, family string, preference int")
    return op.canonical(raw_facts(spark, sf), families, "ord").select("cik", "tag", "fiscal_year", "accession", "value")


@query(WITH + "SELECT cik, tag, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year, count(*) AS n_facts FROM won GROUP BY 1, 2")
def coverage(spark, sf):
    return op.coverage(_won(spark, sf), ["cik", "tag"])


@query(
    WITH + """SELECT w.cik, w.tag, w.fiscal_year, (w.period_end - f.period_end)::INT AS days FROM won w
JOIN filed f USING (cik, fiscal_year) WHERE abs(w.period_end - f.period_end) > 7"""
)
def period_drift(spark, sf):
    return op.period_drift(_won(spark, sf), filings(spark, sf)).select("cik", "tag", "fiscal_year", F.datediff("period_end", "filing_end").alias("days"))


@query(WITH + "SELECT cik, tag, fiscal_year, value FROM won SEMI JOIN (SELECT * FROM filed WHERE period_end < DATE '1998-01-01') f USING (cik, fiscal_year)")
def covered_semi(spark, sf):
    return op.covered(_won(spark, sf), filings(spark, sf).filter("period_end < DATE '1998-01-01'")).select("cik", "tag", "fiscal_year", "value")


@query(
    """WITH l AS (SELECT o_custkey AS cik, o_orderkey AS accession, o_orderdate::DATE AS filing_date FROM orders), k AS (SELECT * FROM l WHERE filing_date < DATE '1998-01-01')
SELECT l.accession, l.cik FROM l ANTI JOIN k ON l.accession = k.accession LEFT JOIN (SELECT cik, max(filing_date) AS newest FROM k GROUP BY 1) n ON l.cik = n.cik
WHERE n.newest IS NULL OR l.filing_date > n.newest"""
)
def new_anti(spark, sf):
    listed = table(spark, sf, "orders").select(F.col("o_custkey").alias("cik"), F.col("o_orderkey").alias("accession"), F.col("o_orderdate").cast("date").alias("filing_date"))
    return op.new_filings(listed.filter("filing_date < DATE '1998-01-01'"), listed).select("accession", "cik")


@query(
    """SELECT c_custkey, max(o_orderdate)::DATE AS newest, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
  coalesce(list_sort(list(o_orderkey) FILTER (WHERE o_orderstatus = 'F'))[1], -1) AS first_finished
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"""
)
def left_agg_filter(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    done = F.sort_array(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))))
    return rows.groupBy("c_custkey").agg(
        F.max("o_orderdate").cast("date").alias("newest"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.coalesce(F.get(done, F.lit(0)), F.lit(-1)).alias("first_finished")
    )


@query(
    """WITH f AS (SELECT DISTINCT o_custkey AS cik, o_orderpriority AS tag, year(o_orderdate)::INT AS y FROM orders)
SELECT cik, tag FROM f WHERE y = 1996 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.cik = f.cik AND g.tag = f.tag AND g.y = 1997)"""
)
def lost_tags(spark, sf):
    facts = table(spark, sf, "orders").select(F.col("o_custkey").alias("cik"), F.col("o_orderpriority").alias("tag"), F.year("o_orderdate").alias("fiscal_year"))
    return op.lost_tags(facts, 1997)


@query(
    """WITH a AS (SELECT * FROM (VALUES ('urgent', '1-URGENT', 0), ('urgent', '2-HIGH', 1), ('slow', '5-LOW', 0)) v(alias, tag, preference)),
f AS (SELECT o_custkey AS cik, o_orderpriority AS tag, year(o_orderdate)::INT AS fiscal_year, min(o_orderkey) AS accession FROM orders GROUP BY 1, 2, 3)
SELECT alias, cik, fiscal_year, tag, accession FROM (SELECT *, row_number() OVER (PARTITION BY alias, cik, fiscal_year ORDER BY preference) AS r FROM f JOIN a USING (tag)) WHERE r = 1"""
)
def fact_lookup(spark, sf):
    facts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cik"), F.col("o_orderpriority").alias("tag"), F.year("o_orderdate").alias("fiscal_year")).agg(F.min("o_orderkey").alias("accession"))
    aliases = spark.createDataFrame([("urgent", "1-URGENT", 0), ("urgent", "2-HIGH", 1), ("slow", "5-LOW", 0)], "alias string, tag string, preference int")
    return op.first_reported(facts, aliases).select("alias", "cik", "fiscal_year", "tag", "accession")


@query(
    """SELECT n_name, r_name, c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS negative
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3"""
)
def star_join(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.groupBy("n_name", "r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("negative"))
