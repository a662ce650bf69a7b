"""Writers: upserts as new versions of a table, append above a high-water mark, atomic publication by a pointer file.

Parquet has no transactions. A change is written as a new version beside the old one, and one small pointer file, put in
place by a rename, says which version of every table is live; readers follow the pointer, so several tables change at once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """old with the rows of new: same keys are replaced. Columns of keep_old fall back to the old value where the new is null;
    with ``only``, just these columns of an existing row change."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    is_new, is_old = F.col(f"n.{keys[0]}").isNotNull(), F.col(f"o.{keys[0]}").isNotNull()
    out = []
    for c in old.columns:
        if c in keys:
            v = F.coalesce(f"n.{c}", f"o.{c}")
        elif c not in new.columns or (only is not None and c not in only):
            v = F.when(is_old, F.col(f"o.{c}"))
            v = v.otherwise(F.col(f"n.{c}")) if c in new.columns else v
        elif c in keep_old:
            v = F.coalesce(f"n.{c}", f"o.{c}")
        else:
            v = F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        out.append(v.alias(c))
    return joined.select(*out)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose keys it lacks, one each."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """old with every group that new touches replaced by new's rows."""
    return old.join(new.select(group).distinct(), group, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def high_water(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("high_water"))


def above(df: DataFrame, mark: int, id_col: str = "id") -> DataFrame:
    return df.filter(F.col(id_col) > mark)


def shared_columns(source: DataFrame, target: list[str], where=None) -> DataFrame:
    """The columns that both sides have, of the rows that hold."""
    rows = source if where is None else source.filter(where)
    return rows.select(*[c for c in source.columns if c in target])


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def live(spark: SparkSession, root: str) -> dict[str, str]:
    """Live path of each published table; empty before the first publication."""
    fs, at = _fs(spark, f"{root}/LIVE.json")
    if not fs.exists(at):
        return {}
    return json.loads(spark.read.text(f"{root}/LIVE.json", wholetext=True).first()[0])


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], expected: dict[str, str] | None = None) -> dict[str, str]:
    """Writes new versions of the tables and puts them live together. Refuses if what is live is not what the change was made from."""
    if expected is not None and live(spark, root) != expected:
        raise RuntimeError("another publication came between")
    version = uuid.uuid4().hex
    now = live(spark, root)
    for name, df in tables.items():
        df.write.parquet(path := f"{root}/{name}/{version}")
        now[name] = path
    fs, draft = _fs(spark, f"{root}/.LIVE-{version}.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(now, sort_keys=True).encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(draft, _fs(spark, f"{root}/LIVE.json")[1], options)
    return now
