"""Exact top-k inner products by no-random-access aggregation (NRA).

Every vector is a row of whole numbers, floor(scale * x). For a query q, dimension d is a list of the candidates sorted
by q_d * v_d, best first. The lists are read in step, a run of entries at a time from each, for a batch of queries at
once: a run is a matrix of the entries met in it, and its product with the queries' weights is added to the rows' sums.
For lists a row was not met in yet it gets at least the list's last entry and at most the entry the reading has come to,
which bound it below and above. A query stops reading when neither rows not met at all nor all but a few of those met can
still reach its best k; these few are resolved to their final scores.

A task holds a block of queries and a block of candidates, and reads the candidates a segment at a time: the k-th best
score of the segments before is a lower bound that the next one starts with, so reading stops earlier from segment to
segment. Nothing is broadcast; every query row meets every candidate row once, and a candidate is sent once for each
QUERIES queries. The best k of each pair of blocks are merged per query. Equal vectors of a segment are read once: of one
vector's copies only the k + 1 smallest ids can matter (one may be the query itself).

Defined results: vectors that are null, or hold a null or a value that is not finite, take no part; a
query meets the candidates of its own length, and those of length zero have a null score; ties go to the smaller id;
a query never meets rows of its own id; rows of a repeated id each count, and share one ranking as queries; fewer candidates than k give fewer ranks; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Rows of a block of either kind: 32 MB and 8 MB of 64 whole numbers.
CANDIDATES, QUERIES = 65_536, 16_384
#: Blocks are not cut smaller than this for the sake of idle cores.
LEAST = 4096
#: Rows of a block's first segment, which gives the first bound, and of the others.
FIRST, SEGMENT = 1024, 4096
#: Queries that read together.
BATCH = 512
#: How far the lists have been read when bounds are compared, as shares of the segment.
DEPTHS = (1 / 16, 1 / 4, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1)
#: Reading stops when no more rows than this share of the segment, or FEW, may qualify.
SETTLED, FEW = 1 / 4, 64


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id and v, the components as longs; rows that take no part are left out."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).filter(fine)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


class Lists:
    """The candidates of a segment, one row a distinct vector. Every dimension has two lists: greatest entry first, for
    queries whose weight is positive, and least first. Lists 0 to dims - 1 are of the first kind, the rest of the second."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, keep: int):
        by_id = np.argsort(ids, kind="stable")
        ids, v = ids[by_id], v[by_id]
        self.v, group = np.unique(v, axis=0, return_inverse=True)
        order = np.argsort(group.reshape(-1), kind="stable")  # of one vector, ids ascend
        cuts = np.concatenate(([0], np.cumsum(np.bincount(group.reshape(-1), minlength=len(self.v)))))
        self.ids = [ids[order[a : min(b, a + keep)]] for a, b in zip(cuts[:-1], cuts[1:])]
        n, dims = self.v.shape
        up = np.argsort(self.v, axis=0, kind="stable")
        place = np.empty((n, dims), np.int32)
        np.put_along_axis(place, up, np.arange(n, dtype=np.int32)[:, None], axis=0)
        values = np.take_along_axis(self.v, up, axis=0)
        self.entries = np.concatenate([values[::-1], values], axis=1).astype(np.float64)  # (entry, list)
        self.met_at = np.concatenate([n - 1 - place, place], axis=1)  # (row, list): the row's entry

    def run(self, done: int, depth: int, kind) -> np.ndarray:
        """(row, list): the entries from done up to depth, 0 for rows that are met before or after."""
        return np.where((self.met_at >= done) & (self.met_at < depth), np.concatenate([self.v, self.v], axis=1), 0).astype(kind)


def kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """A number that k or more entries of each row of x reach; the k-th largest of the largest of its parts."""
    parts = min(x.shape[1], 16 * k)
    cut = x.shape[1] // parts
    tops = x[:, : cut * parts].reshape(len(x), parts, cut).max(axis=2)
    return np.partition(tops, parts - k, axis=1)[:, parts - k]


def contenders(lists: Lists, queries: np.ndarray, k: int, bars: np.ndarray) -> tuple[list[np.ndarray], int]:
    """For each query the rows that may be among the k best of those that score its bar or more, and the entries read to tell.

    Sums are of whole numbers and exact; where they could pass 2^52 every row is left to be resolved.
    """
    n, dims = lists.v.shape
    few = max(FEW, int(n * SETTLED))
    rows_of = [np.arange(n)] * len(queries)
    largest = np.abs(lists.entries[[0, -1]]).max(initial=0) * float(np.abs(queries).max(initial=0)) * max(1, dims)
    if n <= max(few, k) or largest >= 2.0**52:
        return rows_of, 0
    kind = np.float32 if largest < 2.0**23 else np.float64
    weights = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1).astype(kind)
    lengths = (queries != 0).sum(axis=1)  # lists a query reads
    last = lists.entries[-1].astype(kind)
    open_, sums, bars = np.arange(len(queries)), np.zeros((len(queries), n), kind), bars.astype(np.float64)
    done = read = 0
    for share in DEPTHS:
        depth = max(done + 1, int(n * share))
        sums += weights @ lists.run(done, depth, kind).T
        read += int(lengths.sum()) * (depth - done)
        done = depth
        unmet = (lists.met_at >= depth).astype(kind).T
        come_to = lists.entries[depth - 1].astype(kind)
        outside = weights @ come_to  # no row that was not met scores more
        if (outside > bars).any():  # rows are distinct vectors, and one of their ids may be the query's own: k + 1 must be safe
            bars = np.maximum(bars, kth_largest(sums + (weights * last) @ unmet, k + 1))
        closed = np.flatnonzero((outside <= bars) | (depth == n))
        if len(closed):
            may = sums[closed] + (weights[closed] * come_to) @ unmet >= bars[closed, None]
            stop = (may.sum(axis=1) <= few) | (depth == n)
            for j, row in zip(closed[stop], may[stop]):
                rows_of[open_[j]] = np.flatnonzero(row)
            still = np.ones(len(open_), bool)
            still[closed[stop]] = False
            open_, sums, bars, weights, lengths = open_[still], sums[still], bars[still], weights[still], lengths[still]
        if not len(open_):
            break
    return rows_of, read


def nra(ids: np.ndarray, v: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[list[list[tuple[int, int]]], int]:
    """For each query the k best (score, id) of a block, ties to smaller ids, its own row left out; and the entries read."""
    best: list[list[tuple[int, int]]] = [[] for _ in queries]  # (-score, id), ascending
    read = 0
    cuts = [0, *range(min(FIRST, len(v)), len(v), SEGMENT), len(v)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        lists = Lists(ids[a:b], v[a:b], k + 1)
        for at in range(0, len(queries), BATCH):
            some = queries[at : at + BATCH]
            bars = np.array([-found[-1][0] if len(found) == k else -np.inf for found in best[at : at + BATCH]])
            left, entries = contenders(lists, some, k, bars)
            read += entries
            for j, (q, rows, bar) in enumerate(zip(some, left, bars), at):
                scores = lists.v[rows] @ q  # resolved
                if len(rows) > k + 1:
                    bar = max(bar, np.partition(scores, len(rows) - (k + 1))[len(rows) - (k + 1)])
                found = [(-int(s), int(i)) for s, r in zip(scores[scores >= bar], rows[scores >= bar]) for i in lists.ids[r] if i != own[j]]
                best[j] = sorted(best[j] + found)[:k]
    return [[(-s, i) for s, i in found] for found in best], read


def _block_pair(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int | None]] = []
        lengths, wanted = right["v"].map(len), left["v"].map(len)
        for width in sorted({*lengths} & {*wanted}):
            rows, asked = right[lengths == width], left[wanted == width]
            if not width:  # nothing to sum: no score, and ids decide
                ids = sorted(rows["vec_id"].tolist())
                out += [(q, i, None) for q in asked["vec_id"].tolist() for i in islice((i for i in ids if i != q), k)]
                continue
            own = asked["vec_id"].to_numpy(np.int64)
            whole = lambda side: np.stack(side["v"].to_list()).astype(np.int64)
            found, _ = nra(rows["vec_id"].to_numpy(np.int64), whole(rows), whole(asked), own, k)
            out += [(int(q), i, s) for q, best in zip(own, found) for s, i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "Int64"})

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score: the k best candidates (vec_id, v) of every query (vec_id, v)."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n_cand, n_query = candidates.count(), queries.count()
    c_blocks = max(1, min(cores, -(-n_cand // LEAST)), -(-n_cand // CANDIDATES))
    q_blocks = max(1, -(-n_query // QUERIES))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = queries.withColumn("qb", block(q_blocks)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    right = candidates.withColumn("cb", block(c_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(_block_pair(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return top_k(rows.filter(F.col("vec_id") % 50 == 0), rows, 5)


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
