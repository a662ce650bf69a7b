"""Deterministic samples and splits: rows are ordered by md5 of a seed and a key, the same in every engine and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))


def per_group(df: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each group."""
    w = Window.partitionBy(group).orderBy(shuffled(key, seed), key)
    return df.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= n)


def superset_stable(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The n rows that come first in a fixed order: a larger n keeps all of a smaller."""
    return df.orderBy(shuffled(key, seed), key).limit(n)


def proportional(df: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    """About n rows, shared out by the strata's sizes, one at least of each."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    quota = sizes.join(total).withColumn("quota", F.greatest(F.lit(1), F.bround(F.col("size") * n / F.col("total")).cast("int"))).drop("size", "total")
    w = Window.partitionBy(*strata).orderBy(shuffled(key, seed), key)
    return df.withColumn("pick", F.row_number().over(w)).join(quota, strata).filter(F.col("pick") <= F.col("quota")).drop("pick", "quota")


def round_robin(df: DataFrame, kind: str, subject: str, key: str, quota: int) -> DataFrame:
    """quota rows of each kind, one of each subject in turn, subjects and rows in order."""
    depth = F.row_number().over(Window.partitionBy(kind, subject).orderBy(key))
    turn = F.row_number().over(Window.partitionBy(kind).orderBy("depth", subject))
    deep = df.withColumn("depth", depth).filter(F.col("depth") <= quota)  # deeper rows never get a turn
    return deep.withColumn("turn", turn).filter(F.col("turn") <= quota)


def held_out_split(df: DataFrame, sector: str, company: str, per_sector: int, seed: str) -> DataFrame:
    """df with held_out: per_sector companies of every sector that has two or more."""
    companies = df.select(sector, company).distinct()
    w = Window.partitionBy(sector)
    ranked = companies.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("place", F.row_number().over(w.orderBy(shuffled(company, seed), company)))
    return df.join(ranked.select(sector, company, ((F.col("n") >= 2) & (F.col("place") <= per_sector)).alias("held_out")), [sector, company])


def diverse_order(rows: list[dict], want: int) -> list[dict]:
    """Greedy order of a few rows (case_id, kind, ticker) for labelling: least used kind, then least used ticker, then id."""
    from collections import Counter

    kinds, tickers, left, out = Counter(), Counter(), sorted(rows, key=lambda r: r["case_id"]), []
    while left and len(out) < want:
        best = min(left, key=lambda r: (kinds[r["kind"]], tickers[r["ticker"]], r["case_id"]))
        left.remove(best)
        kinds[best["kind"]] += 1
        tickers[best["ticker"]] += 1
        out.append(best)
    return out
