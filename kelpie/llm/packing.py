"""Packing of documents into sequences by cutting-stock column generation.

A document is its token ids and a closing id 0, cut every ``size`` tokens; all pieces but the last are whole sequences,
and the last pieces ("rests") are packed. Their lengths go into a histogram of STEP-wide bins, rounded up, so its size
is bounded whatever the corpus. A linear program over patterns (how many rests of each bin share a sequence) starts with
one pattern per bin; a knapsack dynamic program prices new patterns from the duals until none improves. The solution is
rounded down, and the pieces left over, less than one sequence a pattern, are filled in a sequence at a time, the
largest first and then the subset that leaves least room. Rests of a bin
are ranked, and rank k takes the k-th place that the patterns have for the bin.

Texts are read and tokenized once; a written table of lengths and checksums carries the rest. Ranks are counted in
chunks of hashed rows of each bin, so a length or an id that a third of all documents share is dealt over many tasks.

Defined results: a null or empty text is the closing id alone; very long texts are cut into many pieces; rows of equal
length, repeated rows and equal ids each get a place of their own; an empty table gives no pieces; other columns are
not read. Sequence numbers are unique, not gapless.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SIZE = 1024
STEP = 8
CHUNK_ROWS = 50_000
LEAST_CHUNKS = 64


@lru_cache(2)
def _encoder(json_path: str, ranks_path: str):
    """Encoder of the vocabulary: the ranks' fast library, and the library of the file for texts that spell one of its added tokens.

    The two give the same ids, which the tests hold them to; the first takes half the time.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(json_path)
    added = [t.content for t in exact.get_added_tokens_decoder().values()]
    return lambda text: exact.encode(text, add_special_tokens=False).ids if any(a in text for a in added) else fast.encode_ordinary(text)


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def measured(docs: DataFrame, files: tuple[str, str], size: int = SIZE) -> DataFrame:
    """doc_id, doc_tokens and the checksum of every piece of size tokens, the last one shorter or not."""

    def run(batches):
        encode = _encoder(*files)
        for batch in batches:
            counts, sums = [], []
            for text in batch.column(1).to_pylist():
                ids = np.array([*encode(text or ""), 0], "<u4")
                counts.append(len(ids))
                sums.append([zlib.crc32(ids[a : a + size].tobytes()) for a in range(0, len(ids), size)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "sums"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, doc_tokens long, sums array<long>")


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: how many of each size, together at most capacity, by dynamic programming."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = np.searchsorted(sizes, c, side="right")
        best[c] = best[c - 1]
        if fits:
            gains = best[c - sizes[:fits]] + values[:fits]
            k = int(gains.argmax())
            if gains[k] > best[c] + 1e-12:
                best[c], took[c] = gains[k], k
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(best[capacity]), counts


def patterns(demand: dict[int, int], capacity: int, gap: float = 0.001, rounds: int = 20_000) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) that together hold every piece of the demand (size: number) exactly once."""
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    basis = np.diag(capacity // sizes)
    inverse = np.diag(1.0 / (capacity // sizes))
    use = inverse @ need
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        worth, column = price(duals, sizes, capacity)
        if worth <= 1 + gap:  # the program is within this share of its optimum (the bound of Farley)
            break
        move = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(move > 1e-9, use / move, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        pivot = inverse[out] / move[out]
        inverse -= np.outer(move, pivot)
        inverse[out] = pivot
        use = np.maximum(use - ratio[out] * move, 0)
        use[out] = ratio[out]
        basis[:, out] = column
    times = np.floor(use + 1e-6).astype(np.int64)
    left = need.astype(np.int64) - basis @ times
    while (left < 0).any():  # rounding noise in the solution
        times[int(np.argmax((basis[left < 0] > 0).any(axis=0) & (times > 0)))] -= 1
        left = need.astype(np.int64) - basis @ times
    plan = [({int(sizes[i]): int(a) for i, a in enumerate(basis[:, p]) if a}, int(n)) for p, n in enumerate(times) if n]
    return plan + [(held, 1) for held in filled({int(s): int(n) for s, n in zip(sizes, left) if n}, capacity)]


def filled(left: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """The pieces left, a sequence at a time: the largest, then those that fill the room best, large ones before small."""
    left, out = dict(left), []
    while left:
        top = max(left)
        held = {top: 1}
        left[top] -= 1
        room = capacity - top
        sizes = sorted((s for s, n in left.items() if n and s <= room), reverse=True)
        reach, mask = [1], (1 << (room + 1)) - 1  # bit c: the sizes so far can fill c
        for s in sizes:
            now = reach[-1]
            for _ in range(min(left[s], room // s)):
                now |= (now << s) & mask
            reach.append(now)
        c = reach[-1].bit_length() - 1
        for i in range(len(sizes) - 1, -1, -1):
            while not reach[i] >> c & 1:
                held[sizes[i]] = held.get(sizes[i], 0) + 1
                left[sizes[i]] -= 1
                c -= sizes[i]
        left = {s: n for s, n in left.items() if n}
        out.append(held)
    return out


def places(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(bin, first rank, past rank, first sequence, number in a sequence, place of the first of them in the sequence)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for held, times in plan:
        position = 0
        for size, number in sorted(held.items(), reverse=True):
            first = taken.get(size, 0)
            taken[size] = first + number * times
            rows.append((size, first, taken[size], sequence, number, position))
            position += number
        sequence += times
    return rows


def pack(lengths: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """Pieces of documents given as doc_id, doc_tokens and sums (a checksum per piece): where each piece lies."""
    spark = lengths.sparkSession
    rest = F.col("doc_tokens") % size
    rows = lengths.withColumn("rest", rest).withColumn("bin", F.ceil(F.col("rest") / step).cast("int"))
    # at most size / step + 1 rows come to the driver, whatever the corpus
    histogram = {r["bin"]: r for r in rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("sums")).alias("most")).collect()}
    if not histogram:
        return lengths.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    total = sum(r["n"] for r in histogram.values())
    most = max(r["most"] for r in histogram.values())
    plan = patterns({b: r["n"] for b, r in histogram.items() if b > 0}, size // step)
    packed = sum(times for _, times in plan)
    before, number = 0, []
    for b, r in sorted(histogram.items()):
        number.append((b, before))
        before += r["n"]

    chunks = max(LEAST_CHUNKS, -(-total // CHUNK_ROWS))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "doc_tokens", F.element_at("sums", 1)), F.lit(chunks)).cast("int"))
    counts = rows.groupBy("bin", "chunk").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("bin").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bin", "chunk", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("ahead"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bin", "chunk").orderBy("doc_id", "doc_tokens", "sums")))
    ranked = ranked.join(starts, ["bin", "chunk"]).withColumn("rank", F.col("rank") - 1 + F.col("ahead"))

    # both tables have at most a few rows for each bin of the histogram, a bound that no corpus moves
    numbers = F.broadcast(spark.createDataFrame(number, "bin int, before long"))
    seats = F.broadcast(spark.createDataFrame(places(plan) or [(-1, 0, 0, 0, 1, 0)], "b int, first long, past long, sequence long, each int, position int"))
    seated = ranked.join(numbers, "bin").join(seats, (F.col("bin") == F.col("b")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")), "left")
    seat = F.col("rank") - F.col("first")
    seated = seated.select(
        "doc_id",
        "doc_tokens",
        "sums",
        "rest",
        (F.col("before") + F.col("rank")).alias("doc_number"),
        (F.col("sequence") + F.expr("(rank - first) div each")).alias("sequence"),
        (F.col("position") + seat % F.col("each")).alias("position"),
    )
    pieces = seated.select("doc_id", "doc_tokens", "rest", "doc_number", "sequence", "position", F.posexplode("sums").alias("k", "ids_crc32"))
    is_rest = (F.col("k") == F.floor(F.col("doc_tokens") / size)) & (F.col("rest") > 0)
    pieces = pieces.select(
        "doc_id",
        (F.col("k") * F.lit(size)).cast("long").alias("start"),
        F.when(is_rest, F.col("rest")).otherwise(size).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        F.when(is_rest, F.col("sequence")).otherwise(packed + F.col("doc_number") * most + F.col("k")).cast("long").alias("sequence_id"),
        F.when(is_rest, F.col("position")).otherwise(0).alias("position"),
    )
    inside = Window.partitionBy("sequence_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop("position")


def pack_documents(docs: DataFrame, files: tuple[str, str] | None = None, size: int = SIZE, step: int = STEP) -> DataFrame:
    return pack(written(measured(docs, files or paths(), size), "token-counts"), size, step)


def sequences(docs: DataFrame, pieces: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """The sequences themselves: sequence_id, ids of at most the pack's size. doc_id must be unique."""
    files = files or paths()
    wanted = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    joined = docs.select("doc_id", "text").join(wanted, "doc_id")

    def run(batches):
        encode = _encoder(*files)
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                ids = [*encode(text or ""), 0]
                out += [(c["sequence_id"], c["offset"], ids[c["start"] : c["start"] + c["length"]]) for c in cuts]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])

    cut = joined.mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    whole = cut.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return whole.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
