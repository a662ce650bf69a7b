"""Incremental and stateful forms. The batch forms of the windows are in operators.evalruns; event-time windows are an extension."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType


def refresh(spark: SparkSession, folder: str, schema, checkpoint: str, stage: Callable[[DataFrame, int], None], fmt: str = "parquet"):
    """Files that are new in the folder since the last run go through ``stage(batch, batch_id)`` once; returns when they are done."""
    query = (
        spark.readStream.format(fmt).schema(schema).load(folder)
        .writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def rate_limited(requests: DataFrame, client: str, at: str, limit: int, seconds: float = 60.0) -> DataFrame:
    """Requests with allowed: at most ``limit`` allowed ones of a client in any ``seconds``; rejected ones are not remembered.

    Requests come sorted by client and time, a batch at a time, and what is held is the current client's newest ``limit``
    allowed ones, so a client of any size needs that much memory; requests without a client are one client's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: deque[float] = deque()
        now = object()
        for rows in batches:
            allowed = []
            for who, t in zip(rows[client], rows[at].astype("float64")):
                who = None if pd.isna(who) else who
                if who != now:
                    now, held = who, deque(maxlen=limit)
                allowed.append(len(held) < limit or t - held[0] >= seconds)
                if allowed[-1]:
                    held.append(t)
            yield rows.assign(allowed=allowed)

    out = StructType([*requests.schema.fields, StructField("allowed", BooleanType())])
    return requests.repartition(client).sortWithinPartitions(client, at).mapInPandas(run, out)


def newest_window(requests: DataFrame, path: str, ms: str, status: str, newest: int = 1000) -> DataFrame:
    """Streaming: per path the count and share of successes over its newest requests, kept in state of that many entries."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get)) if state.exists else []
        for b in batches:
            kept = [*kept, *zip(b[ms].astype(float), b[status].astype(int))][-newest:]
        state.update(([float(m) for m, _ in kept], [int(s) for _, s in kept]))
        good = sorted(m for m, s in kept if 200 <= s < 400)
        yield pd.DataFrame({path: [key[0]], "requests": [len(kept)], "ok": [len(good)], "p95": [good[min(len(good) - 1, int(0.95 * len(good)))] if good else None]})

    return requests.groupBy(path).applyInPandasWithState(step, f"{path} string, requests long, ok long, p95 double", "ms array<double>, status array<int>", "update", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, ts: str, kind: str, value: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: counts and sums per kind and tumbling window, with a watermark when it streams."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def pending(all_ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that are not done without error yet: what a resumed run has to do."""
    good = done.filter(F.coalesce(F.col("error"), F.lit("")) == "").select(key)
    return all_ids.join(good, key, "left_anti")
