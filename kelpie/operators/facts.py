"""Annual facts as reported: extraction, deduplication, prior years, integrity checks. One Catalyst plan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.figures import covers_full_year, fiscal_year_of

SERIES = ["cik", "taxonomy", "tag", "unit"]

#: The tags that are kept.
CORE_TAGS = (
    "Revenues RevenueFromContractWithCustomerExcludingAssessedTax NetIncomeLoss OperatingIncomeLoss ResearchAndDevelopmentExpense "
    "ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost Assets Liabilities StockholdersEquity CashAndCashEquivalentsAtCarryingValue "
    "GrossProfit EarningsPerShareDiluted CommonStockSharesOutstanding"
).split()

COMPANY_FACTS = "facts map<string, map<string, struct<units: map<string, array<struct<fy:int, fp:string, form:string, val:decimal(38,6), start:string, end:string, accn:string>>>>>>"


def exploded(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """One row per entry of companyfacts JSON (cik, json), with ord, its place of arrival: us-gaap before dei."""
    facts = raw.select("cik", F.from_json(json_col, COMPANY_FACTS).alias("j"))
    by_taxonomy = facts.select("cik", F.posexplode(F.array(F.lit("us-gaap"), F.lit("dei"))).alias("o1", "taxonomy"), "j")
    by_tag = by_taxonomy.select("cik", "o1", "taxonomy", F.posexplode(F.map_entries(F.element_at("j.facts", F.col("taxonomy")))).alias("o2", "t"))
    by_unit = by_tag.select("cik", "o1", "o2", "taxonomy", F.col("t.key").alias("tag"), F.posexplode(F.map_entries("t.value.units")).alias("o3", "u"))
    rows = by_unit.select("cik", "o1", "o2", "o3", "taxonomy", "tag", F.col("u.key").alias("unit"), F.posexplode("u.value").alias("o4", "e"))
    return rows.select(
        "cik", "taxonomy", "tag", "unit", "e.fy", "e.form", "e.val",
        F.col("e.start").try_cast("date").alias("period_start"), F.col("e.end").try_cast("date").alias("period_end"),
        F.col("e.accn").alias("accession"), F.struct("o1", "o2", "o3", "o4").alias("ord"),
    )


def annual(entries: DataFrame, forms: list[str], tags: list[str] = CORE_TAGS) -> DataFrame:
    """Entries of full years and of year ends, with their fiscal year; durations of other lengths and entries without an end go."""
    kept = entries.filter(F.col("tag").isin(*tags) & F.col("form").isin(*forms) & F.col("val").isNotNull() & F.col("fy").isNotNull() & F.col("period_end").isNotNull())
    kept = kept.withColumn("lasting", F.col("period_start").isNotNull()).filter(~F.col("lasting") | covers_full_year(F.col("period_start"), F.col("period_end")))
    ends = kept.filter("lasting").select("cik", "period_end").distinct().withColumn("is_end", F.lit(True))
    any_end = ends.select("cik").distinct().withColumn("has_ends", F.lit(True))
    marked = kept.join(ends, ["cik", "period_end"], "left").join(any_end, "cik", "left")
    marked = marked.filter(F.col("lasting") | F.col("has_ends").isNull() | F.col("is_end"))
    return marked.withColumn("fiscal_year", fiscal_year_of(F.col("period_end"), F.col("fy"))).drop("lasting", "is_end", "has_ends")


def earliest(facts: DataFrame, keys: list[str], accession: str = "accession", order: str = "ord") -> DataFrame:
    """One row per key: the smallest accession's, its first arrival; a first arrival without an accession is never replaced."""
    whole = F.struct(*facts.columns)
    found = facts.groupBy(*keys).agg(
        F.min_by(whole, F.col(order)).alias("first"),
        F.min_by(F.when(F.col(accession).isNotNull(), whole), F.when(F.col(accession).isNotNull(), F.struct(accession, order))).alias("least"),
    )
    return found.select(F.when(F.col("first")[accession].isNull(), F.col("first")).otherwise(F.col("least")).alias("w")).select("w.*")


def prior_as_printed(winners: DataFrame, facts: DataFrame, value: str = "value", order: str = "ord") -> DataFrame:
    """winners with prior_year_value: what the same accession printed first for the year before."""
    printed = facts.groupBy(*SERIES, "accession", "fiscal_year").agg(F.min_by(value, order).alias("prior_year_value"))
    printed = printed.withColumn("fiscal_year", F.col("fiscal_year") + 1)
    return winners.join(printed, [*SERIES, "accession", "fiscal_year"], "left")


def year_over_year(facts: DataFrame, value: str = "value", prior: str | None = "prior_year_value") -> DataFrame:
    """Adjacent years of a series with base (the printed prior value, else the year before's own) and change in per cent; base 0 is left out."""
    w = Window.partitionBy(*SERIES).orderBy("fiscal_year")
    out = facts.withColumn("year_before", F.lag("fiscal_year").over(w)).withColumn("own_prior", F.lag(value).over(w))
    out = out.filter(F.col("year_before") == F.col("fiscal_year") - 1)
    base = F.coalesce(F.col(prior), F.col("own_prior")) if prior else F.col("own_prior")
    out = out.withColumn("base", base).filter(F.col("base") != 0)
    return out.withColumn("change_pct", (F.col(value) - F.col("base")).cast("double") / F.abs("base").cast("double") * 100)


def misdated(facts: DataFrame) -> DataFrame:
    """Neighbouring years of a series whose ends lie further apart or closer than their labels say."""
    w = Window.partitionBy(*SERIES).orderBy("fiscal_year")
    out = facts.withColumn("next_year", F.lead("fiscal_year").over(w)).withColumn("next_end", F.lead("period_end").over(w))
    years = F.col("next_year") - F.col("fiscal_year")
    days = F.datediff("next_end", "period_end")
    return out.filter(F.col("next_year").isNotNull() & ~days.between(years * 340, years * 380)).withColumn("days", days)


def missing_years(facts: DataFrame) -> DataFrame:
    """(cik, fiscal_year) between a company's first and last year without any fact."""
    span = facts.groupBy("cik").agg(F.min("fiscal_year").alias("a"), F.max("fiscal_year").alias("b"))
    every = span.select("cik", F.explode(F.sequence("a", "b")).alias("fiscal_year"))
    return every.join(facts.select("cik", "fiscal_year").distinct(), ["cik", "fiscal_year"], "left_anti")


def conflicts(facts: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Keys with more than one value."""
    out = facts.groupBy(*keys).agg(F.count_distinct(value).alias("n_values"), F.sort_array(F.collect_set(value)).alias("values"))
    return out.filter("n_values > 1")


def canonical(facts: DataFrame, families: DataFrame, order: str) -> DataFrame:
    """Per company, family and year only the preferred tag's row; tags of no family stay. families: tag, family, preference."""
    marked = facts.join(families, "tag", "left")
    best = Window.partitionBy("cik", "family", "fiscal_year").orderBy("preference", order)
    ranked = marked.filter(F.col("family").isNotNull()).withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")
    return ranked.unionByName(marked.filter(F.col("family").isNull())).select(*facts.columns)


def coverage(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.groupBy(*keys).agg(F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"), F.count(F.lit(1)).alias("n_facts"))


def covered(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Facts of years that have a filing."""
    return facts.join(filings.select("cik", "fiscal_year").distinct(), ["cik", "fiscal_year"], "left_semi")


def period_drift(facts: DataFrame, filings: DataFrame, days: int = 7) -> DataFrame:
    """Facts whose period ends more than ``days`` off their year's filing."""
    f = filings.select("cik", "fiscal_year", F.col("period_end").alias("filing_end"))
    return facts.join(f, ["cik", "fiscal_year"]).filter(F.abs(F.datediff("period_end", "filing_end")) > days)


def lost_tags(facts: DataFrame, year: int) -> DataFrame:
    """(cik, tag) reported in the year before and not in the year."""
    before = facts.filter(F.col("fiscal_year") == year - 1).select("cik", "tag").distinct()
    return before.join(facts.filter(F.col("fiscal_year") == year).select("cik", "tag"), ["cik", "tag"], "left_anti")


def first_reported(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Fact lookup by alias: per (alias, cik, fiscal_year) the first of the alias's tags that has a row. aliases: alias, tag, preference."""
    w = Window.partitionBy("alias", "cik", "fiscal_year").orderBy("preference")
    return facts.join(aliases, "tag").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def new_filings(known: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed filings that are not held and were filed after the newest held one of their company, if any."""
    newest = known.groupBy("cik").agg(F.max("filing_date").alias("newest"))
    fresh = listed.join(known.select("accession"), "accession", "left_anti").join(newest, "cik", "left")
    return fresh.filter(F.col("newest").isNull() | (F.col("filing_date") > F.col("newest"))).drop("newest")


def optional(column: str, value) -> Column:
    """Equality that holds for every row where no value is given; 0 and '' count as none."""
    return F.col(column) == value if value else F.lit(True)
