"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a hash in (0, 1); the shard with the least -ln(hash) / weight takes the record. A
record's place depends on its key and the shards only, so a new shard takes rows into itself and moves no other row,
and a shard of twice the weight takes twice the rows.

Defined results: a null key is hashed as the text ``null``; a null text has size 1 and the checksum of an empty text;
equal keys land in one shard, and repeated rows get one slot each; an empty table gives an empty result; columns of
the input that clash with the output's names are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Hash digits of base 16 that are used: 52 bits, exact in a double.
DIGITS = 13
#: Rows of a shard are ranked in chunks of about this many, so no task ever ranks a whole shard.
CHUNK_ROWS = 50_000
LEAST_CHUNKS = 256


def _cost(key: Column, shard: int, weight: float) -> Column:
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"#{shard}"))), 1, DIGITS), 16, 10).cast("double")
    return -F.log((h + F.lit(0.5)) / F.lit(float(16**DIGITS))) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """struct(cost, shard) of the winning shard; ties go to the smaller shard."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    if len(weights) == 1:
        return F.struct(_cost(key, 0, weights[0]).alias("cost"), F.lit(0).alias("shard"))
    return F.least(*[F.struct(_cost(key, i, w).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)])


def assign(df: DataFrame, key: str, weights: list[float], grown: float | None = 1.0) -> DataFrame:
    """df with shard and, where one more shard of weight ``grown`` is given, grown_shard."""
    out = df.withColumn("_won", rendezvous(F.col(key), weights)).withColumn("shard", F.col("_won.shard"))
    if grown is None:
        return out.withColumn("grown_shard", F.lit(None).cast("int")).drop("_won")
    extra = _cost(F.coalesce(F.col(key).cast("string"), F.lit("null")), len(weights), grown)
    return out.withColumn("grown_shard", F.when(extra < F.col("_won.cost"), F.lit(len(weights))).otherwise(F.col("shard"))).drop("_won")


def number_slots(df: DataFrame, order: list[str], chunks: int) -> DataFrame:
    """df with slot, gapless from 0 in each shard: ranks in chunks of hashed rows, plus the rows of the chunks before.

    Chunks are dealt by all columns of the order, so many rows of one key are many chunks.
    """
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy(*order)))
    sizes = df.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = ranked.join(starts, ["shard", "_chunk"])
    return joined.withColumn("slot", F.col("_start") + F.col("_rank") - 1).drop("_start", "_rank", "_chunk")


def shard_documents(docs: DataFrame, weights: list[float], grown: float | None = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Placement of every document: its size, checksum, shard, slot and its shard once one more is added."""
    rows = docs.count()
    chunks = max(LEAST_CHUNKS, -(-rows // (CHUNK_ROWS * len(weights))))
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = number_slots(assign(slim, "doc_id", weights, grown), ["doc_id", "text_crc32", "size"], chunks)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: list[float], id_col: str = "doc_id") -> None:
    """The documents themselves, in one folder per shard; files of a shard are cut by Spark's writer."""
    assign(docs.drop("shard", "grown_shard"), id_col, weights, None).drop("grown_shard").write.partitionBy("shard").parquet(path)


SHARDS = 8


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS)
