"""What the operators of this folder share: reading tables, the shared folder, the label split."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Java and RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session in one process (tests) gets a folder of its own; on a cluster no folder of this machine
    will do, and the caller is told.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kelpie-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Folders that written() made in this process and that are still there.
_MADE: set[str] = set()


def written(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """df, written once to the shared folder and read from there: cuts lineage, survives lost executors.

    A small table of costly rows is cut into files of rows_a_file, so that many tasks read it. A result may read such
    tables until it is consumed; clear() then deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    _MADE.add(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _MADE.discard(folder)


def clear(spark: SparkSession) -> None:
    """Deletes every table that written() made, once no result is read any more."""
    for folder in sorted(_MADE):
        _delete(spark, folder)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by written() that no later plan reads."""
    names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    for folder in [m for m in _MADE if m.rsplit("/", 1)[-1] in names]:
        _delete(spark, folder)


def fold(key: str, parts: int):
    """crc32 of the key as text, modulo parts: the split into learning and held-out rows."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(parts))


def held_out(key: str, parts: int, out: int):
    """Whether a row is held out of learning; rows without a key always are."""
    return F.coalesce(fold(key, parts) == out, F.lit(True))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows, the ones whose hashed key is smallest as a share; all rows if there are no more."""
    total = df.count()
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * rows / total))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, value: str = "text", id_col: str = "doc_id", parts: int = 5, out: int = 0) -> DataFrame:
    """id, label and value of a sample of at most about ``rows`` labelled ids of the learning folds.

    The sample's ids are drawn first, few by construction, and travel to the documents, so no other text is shuffled.
    One row an id, with its larger label and its least non-null value, so a repeated id does not widen the sample.
    """
    known = labels.filter(F.col(label).isNotNull() & ~held_out(id_col, parts, out))
    known = known.groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    met = docs.select(id_col, value).join(F.broadcast(bounded_sample(known, id_col, rows)), id_col)
    return met.groupBy(id_col, "label").agg(F.min(value).alias(value))
