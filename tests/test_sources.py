"""Readers, schemas and streams on small files."""

import json

from pyspark.sql import functions as F

from kelpie import schemas
from kelpie.operators import evalruns
from kelpie.sources import sinks, tables
from kelpie.streaming import incremental


def test_fixture(spark, tmp_path):
    whole = {
        "companies": [{"cik": "1", "ticker": "ALFA", "name": "Alfa"}],
        "filings": [{"cik": "1", "accession": "a", "form": "10-K", "filing_date": "2024-02-01", "period_end": "2023-12-31", "primary_doc": "d", "source_url": "u", "sections": [{"item": "1A", "title": "t", "body": "abc"}, {"item": "7", "title": "u", "body": ""}]}],
        "facts": [{"cik": "1", "tag": "Assets", "fiscal_year": 2023, "period_end": "2023-12-31", "value": 352583000000, "accession": "a"}],
    }
    (tmp_path / "f.json").write_text(json.dumps(whole))
    got = tables.fixture(spark, str(tmp_path / "f.json"))
    assert [(r["ordinal"], r["item"], r["char_len"]) for r in got["sections"].orderBy("ordinal").collect()] == [(0, "1A", 3), (1, "7", 0)]
    fact = got["facts"].first()
    assert (fact["taxonomy"], fact["unit"], fact["fiscal_period"], fact["form"], int(fact["value"])) == ("us-gaap", "USD", "FY", "10-K", 352583000000)
    assert got["filings"].first()["filing_date"].year == 2024 and got["companies"].count() == 1


def test_ticker_map_and_urls(spark):
    raw = spark.createDataFrame([('{"0": {"cik_str": 320193, "ticker": "aapl", "title": "Apple"}}',)], "json string")
    assert tuple(tables.tickers(raw).first()) == ("AAPL", "0000320193", "Apple")
    row = spark.createDataFrame([("0000320193", "0000-23-1", "d.htm")], "c string, a string, p string")
    assert row.select(tables.filing_url(F.col("c"), F.col("a"), F.col("p"))).first()[0].endswith("/320193/0000231/d.htm")


def test_last_record_wins(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id": "a", "v": 1}\n{"id": "b", "v": 2}\n{"id": "a", "v": 3}\n')
    rows = tables.json_lines(spark, str(tmp_path / "log.jsonl"), "id string, v int")
    assert {r["id"]: r["v"] for r in evalruns.last_wins(rows, "id", "line").collect()} == {"a": 3, "b": 2}


def test_schemas(spark, tmp_path):
    for name in schemas.DDL:
        assert schemas.schema(name).fieldNames()
    df = spark.createDataFrame([("c1", 1, "{}", None, None)] * 2, schemas.schema("golden_cases"))
    assert schemas.duplicates(df, "golden_cases").count() == 1
    assert schemas.create_tables(spark, str(tmp_path)) == schemas.create_tables(spark, str(tmp_path)) == sorted(schemas.DDL)
    assert tables.sql(spark, "SELECT count(*) AS n FROM companies WHERE ticker = :t", {"t": "A"}).first()["n"] == 0
    for name in schemas.DDL:
        spark.sql(f"DROP TABLE {name}")


def test_copies_and_marks(spark):
    df = spark.range(5).withColumn("extra", F.lit(1))
    assert sinks.shared_columns(df, ["id"], F.col("id") > 2).columns == ["id"]
    assert sinks.high_water(df).first()[0] == 4 and sinks.high_water(df.limit(0)).first()[0] == 0
    done = spark.createDataFrame([(1, ""), (2, "timeout"), (3, None)], "id long, error string")
    assert {r["id"] for r in incremental.pending(spark.range(5), done, "id").collect()} == {0, 2, 4}


def test_newest_window_streams(spark, tmp_path):
    rows = [("/a", float(i), 200 if i % 2 else 500) for i in range(10)]
    spark.createDataFrame(rows, "path string, ms double, status int").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, ms double, status int").parquet(f"{tmp_path}/in")
    query = incremental.newest_window(stream, "path", "ms", "status", newest=4).writeStream.format("memory").queryName("newest").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert tuple(spark.table("newest").first()) == ("/a", 4, 2, 9.0)


def test_event_windows_stream_as_they_batch(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(f"{tmp_path}/in")
    batch = incremental.event_counts(spark.read.parquet(f"{tmp_path}/in"), "ts", "event_type", "value").count()
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    query = incremental.event_counts(stream, "ts", "event_type", "value").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").count() == batch


def test_malformed_dates_are_null(spark):
    block = json.dumps({"accessionNumber": ["a", "b"], "form": ["10-K", "10-K"], "filingDate": ["n/a", "2024-02-01"], "reportDate": ["2023-13-40", ""], "primaryDocument": ["x", "y"]})
    got = tables.filing_rows(spark.createDataFrame([("1", 0, block)], "cik string, page int, json string"), ["10-K"]).orderBy("pos").collect()
    assert [(r["filing_date"] and r["filing_date"].year, r["period_end"]) for r in got] == [(None, None), (2024, None)]
