"""Readers: the engine's tables, filing indexes, fixtures, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpie.schemas import schema

SUBMISSIONS = "struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>>"


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table under its fixed schema."""
    return spark.read.schema(schema(name)).parquet(path)


def sql(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """A parameterised statement."""
    return spark.sql(text, args=args or {})


def tickers(raw: DataFrame) -> DataFrame:
    """ticker, cik (ten digits) and title from the ticker map's records (json map<string, struct>)."""
    rows = raw.select(F.explode(F.map_values(F.from_json("json", "map<string, struct<cik_str:long,ticker:string,title:string>>"))).alias("r"))
    return rows.select(F.upper("r.ticker").alias("ticker"), F.lpad(F.col("r.cik_str").cast("string"), 10, "0").alias("cik"), F.col("r.title").alias("title"))


def filing_rows(raw: DataFrame, forms: list[str], newest: int | None = None) -> DataFrame:
    """Rows of columnar filing indexes (cik, page, json of the block), in source order; page 0 is the recent block."""
    block = F.from_json("json", SUBMISSIONS)
    zipped = F.arrays_zip(*[F.col(f"b.{c}").alias(c) for c in ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")])
    rows = raw.select("cik", "page", block.alias("b")).select("cik", "page", F.posexplode(zipped).alias("pos", "r"))
    rows = rows.filter(F.col("r.form").isin(*forms)).select(
        "cik", "page", "pos", F.col("r.accessionNumber").alias("accession"), F.col("r.form").alias("form"),
        F.col("r.filingDate").try_cast("date").alias("filing_date"), F.col("r.reportDate").try_cast("date").alias("period_end"),
        F.col("r.primaryDocument").alias("primary_doc"),
    )
    if newest is None:
        return rows
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("cik").orderBy("page", "pos"))).filter(F.col("n") <= newest)


def filing_url(cik, accession, primary_doc):
    """Address of a filing's document."""
    return F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), cik.cast("long").cast("string"), F.replace(accession, F.lit("-"), F.lit("")), primary_doc)


FIXTURE = (
    "companies array<struct<cik:string,ticker:string,name:string>>,"
    "filings array<struct<cik:string,accession:string,form:string,filing_date:string,period_end:string,primary_doc:string,source_url:string,sections:array<struct<item:string,title:string,body:string>>>>,"
    "facts array<struct<cik:string,taxonomy:string,tag:string,unit:string,fiscal_year:int,fiscal_period:string,period_start:string,period_end:string,value:decimal(38,6),accession:string,form:string>>"
)


def fixture(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """companies, filings, sections and facts of a JSON fixture; missing fields get their defaults."""
    whole = spark.read.schema(FIXTURE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    filings = whole.select(F.inline("filings"))
    sections = filings.select("accession", F.posexplode("sections").alias("ordinal", "s"))
    default = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    facts = whole.select(F.inline("facts")).select(
        "cik", default("taxonomy", "us-gaap"), "tag", default("unit", "USD"), "fiscal_year", default("fiscal_period", "FY"),
        F.col("period_start").try_cast("date").alias("period_start"), F.col("period_end").try_cast("date").alias("period_end"), "value", "accession", default("form", "10-K"),
    )
    return {
        "companies": whole.select(F.inline("companies")),
        "filings": filings.drop("sections").withColumns({c: F.col(c).try_cast("date") for c in ("filing_date", "period_end")}),
        "sections": sections.select("accession", "ordinal", "s.item", "s.title", "s.body", F.length("s.body").alias("char_len")),
        "facts": facts,
    }


def json_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Records of a JSON-lines log with ``line``, the order they were written in within a file."""
    rows = spark.read.schema(ddl).json(path)
    return rows.withColumn("line", F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))


def jsonb(*columns):
    """A JSON text of the columns."""
    return F.to_json(F.struct(*columns))
