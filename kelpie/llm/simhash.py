"""SimHash near-duplicate groups, compared on bit planes.

A fingerprint has a bit where more than half of the text's 3-word shingles (XXH64, seed 42, repeats counted) have it.
Fingerprints within RADIUS bits are linked, and the groups are the connected components of the links.

Which fingerprints meet: 64 bits are cut into some blocks, and two fingerprints within 3 bits agree on all blocks but 3
at least (pigeonhole), so they meet in a table keyed by those blocks. The number of blocks grows with the number of
distinct fingerprints, so that a key stays rare; every choice is exact. Keys that more than BLOCK fingerprints share
are dealt into pairs of parts, so no task holds more than two parts.

How they are compared: a part's fingerprints are stored as 64 vertical bit planes, one bit per fingerprint. A query's
distances to all of them are counted at once in carry-save counters (ones, twos, and a sticky bit for four and over),
plane by plane, and queries whose whole block is over the radius are abandoned.

Copies collapse to one fingerprint first, a block gives a spanning forest and not its pairs, and components are found
with alternating large-star and small-star steps over written tables; nothing of the corpus comes to the driver.

Defined results: a null or empty text has fingerprint zero and is linked like any other; texts of one or two words are
one shingle; repeated rows share a group; null doc_ids are carried and never name a group unless it has no other;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, written

RADIUS = 3
SEED = 42
#: Fingerprints of one part of a key's group.
BLOCK = 1024
#: Groups up to this size are compared by offsets in one batch, over all groups of a partition at once.
SMALL = 48
#: Fingerprints of more rows than one in HOT_KEYS, and than LEAST_HOT, are joined by broadcast: never more than HOT_KEYS of them.
HOT_KEYS, LEAST_HOT = 10_000, 1000
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 text."""
    import xxhash

    ws = (text or b"").lower().split()
    if not ws:
        return 0
    whole = b" ".join(ws)
    if len(ws) <= 3:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-3] + 1))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(whole[a:b], SEED) for a, b in zip(starts.tolist(), ends[2:].tolist())])
    grid = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grid), 255):  # sums of bits in bytes, before they could overflow
        ones += np.add.reduce(np.unpackbits(grid[at : at + 255], axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(grid)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, and the string columns ``also``."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], ["doc_id", "fp", *also])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *also)
    return slim.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{c} string" for c in also)]))


def key_tables(distinct: int) -> list[list[tuple[int, int]]]:
    """Per table the (shift, width) of the blocks that make up its key: 64 bits in m blocks, m - RADIUS of them equal."""
    for m in range(RADIUS + 1, RADIUS + 5):
        cuts = [64 * i // m for i in range(m + 1)]
        kept = m - RADIUS
        if distinct <= 64 << (64 * kept // m) or m == RADIUS + 4:
            blocks = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
            return [list(c) for c in combinations(blocks, kept)]
    raise AssertionError


def _key(fp: Column, blocks: list[tuple[int, int]]) -> Column:
    key, used = F.lit(0).cast("long"), 0
    for shift, width in blocks:
        key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)), used))
        used += width
    return key


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 bit planes; plane p holds bit p of every fingerprint, 64 fingerprints a word."""
    n = len(fps)
    padded = np.zeros(-(-n // 64) * 64, np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _within(diffs, shape, radius: int = RADIUS, rows: np.ndarray | None = None):
    """Mask of lanes with at most ``radius`` (0 to 3) set planes. diffs(p, rows): plane p of the differences of the given rows."""
    rows = np.arange(shape[0]) if rows is None else rows
    ones, twos, over = (np.zeros((len(rows), shape[1]), np.uint64) for _ in range(3))
    for p in range(64):
        d = diffs(p, rows)
        carry = ones & d
        ones ^= d
        over |= twos & carry
        twos ^= carry
        if p % 8 == 7:
            live = ~(over == FULL).all(axis=1)
            if not live.all():  # abandoned: every lane of these rows is over the radius
                rows, ones, twos, over = rows[live], ones[live], twos[live], over[live]
                if not len(rows):
                    break
    near = ~over
    if radius < 3:
        near &= ~(twos & ones) if radius == 2 else (~twos if radius == 1 else ~(twos | ones))
    return rows, near


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with a[i] and b[j] at most radius bits apart."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    planes = planes_of(b)
    flips = [np.where((a >> np.uint64(p)) & np.uint64(1), FULL, np.uint64(0)) for p in range(64)]
    rows, near = _within(lambda p, rows: planes[p][None, :] ^ flips[p][rows][:, None], (len(a), planes.shape[1]), radius)
    bits = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, : len(b)]
    i, j = np.nonzero(bits)
    return rows[i], j


def near_lanes(x: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of the differences x have at most radius bits, counted on their vertical planes."""
    planes = planes_of(x)
    words = planes.shape[1]
    pad = -words % 16
    planes = np.concatenate([planes, np.full((64, pad), FULL)], axis=1).reshape(64, -1, 16)
    rows, near = _within(lambda p, rows: planes[p][rows], planes.shape[1:], radius)
    out = np.zeros(planes.shape[1:], np.uint64)
    out[rows] = near
    return np.unpackbits(out.reshape(-1).view(np.uint8), bitorder="little")[: len(x)].astype(bool)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links reach."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        np.minimum.at(low, label, low)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _links(batches):
    """Rows sorted by (tab, key, a, b, side): per group the links from each fingerprint to the least one it reaches."""
    held: list[pa.RecordBatch] = []

    def emit(group, side, fps):
        n = len(fps)
        cuts = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]).any(axis=1), [True])))
        sizes = np.diff(cuts)
        ii, jj = [], []
        small = np.repeat(sizes <= SMALL, sizes)
        number = np.repeat(np.arange(len(sizes)), sizes)
        for d in range(1, min(SMALL, int(sizes.max()))):
            i = np.flatnonzero(small[:-d] & (number[:-d] == number[d:]))
            if not len(i):
                break
            i = i[near_lanes(fps[i] ^ fps[i + d])]
            ii.append(i)
            jj.append(i + d)
        for at, size in zip(cuts[:-1][sizes > SMALL], sizes[sizes > SMALL]):
            mine = np.arange(at, at + size)
            left, right = mine[side[mine] == 0], mine[side[mine] == 1]
            for a, b in ((left, right),) if len(right) else ((left, left),):
                for lo in range(0, len(a), 512):
                    i, j = near_pairs(fps[a[lo : lo + 512]], fps[b])
                    ii.append(a[lo : lo + 512][i])
                    jj.append(b[j])
        if not ii:
            return None
        root = forest(n, np.concatenate(ii), np.concatenate(jj))
        linked = np.flatnonzero(root != np.arange(n))
        out = fps.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[linked]), pa.array(out[root[linked]])], ["u", "v"]) if len(linked) else None

    def flush(last: bool):
        rows = pa.Table.from_batches(held)
        group = np.stack([rows.column(c).to_numpy() for c in ("tab", "key", "a", "b")], axis=1)
        n = len(group)
        if not last:  # the group at the end may go on in the next batch
            same = (group == group[-1]).all(axis=1)
            n = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held[:] = rows.slice(n).combine_chunks().to_batches() if n < len(group) else []
        if n:
            side = rows.column("side").to_numpy()[:n]
            return emit(group[:n], side, np.ascontiguousarray(rows.column("fp").to_numpy()[:n]).view(np.uint64))
        return None

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if (out := flush(False)) is not None:
                yield out
    if held and (out := flush(True)) is not None:
        yield out


def links(distinct: DataFrame, count: int) -> DataFrame:
    """(u, v) links over distinct fingerprints (column fp) that join exactly the fingerprints within RADIUS bits."""
    tables = key_tables(count)
    keyed = distinct.select("fp", F.posexplode(F.array(*[_key(F.col("fp"), t) for t in tables])).alias("tab", "key"))
    hot = keyed.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    hot = hot.select("tab", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    dealt = keyed.join(hot, ["tab", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(
        "tab",
        "key",
        F.least("mine", "other").alias("a"),
        F.greatest("mine", "other").alias("b"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"),
        "fp",
    )
    cols = ["tab", "key", "a", "b"]
    return dealt.repartition(*cols).sortWithinPartitions(*cols, "side").mapInArrow(_links, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of the edges (u, v): root is the least node that it reaches."""
    now = written(edges.distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large-star")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").filter("u <> v").distinct()
        after = written(small, "small-star")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(now.sparkSession, large)
        dropped(now.sparkSession, now)
        now = after
        if mark == seen:
            return now.select("u", F.col("v").alias("root"))
        seen = mark


def rooted(firsts: DataFrame) -> DataFrame:
    """Rows of distinct fingerprints (column fp) with root, the fingerprint that names their group."""
    roots = components(links(firsts.select("fp"), firsts.count()))
    linked = firsts.join(roots.withColumnRenamed("u", "fp"), "fp", "left")
    return linked.withColumn("root", F.coalesce("root", "fp"))


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id of every document."""
    spark = docs.sparkSession
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    firsts = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    linked = rooted(firsts)
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(linked.join(lowest, "root").select("fp", "component_id", "n"), "named")
    dropped(spark, firsts)
    # fingerprints of many copies are few, at most HOT_KEYS of them, and go to the rows; no task gets more than bar rows of one
    rows = named.agg(F.sum("n")).first()[0] or 0
    bar = max(LEAST_HOT, rows // HOT_KEYS)
    hot = F.broadcast(named.filter(F.col("n") > bar).drop("n"))
    often = marked.join(hot, "fp")
    rest = marked.join(hot.select("fp"), "fp", "left_anti").join(named.filter(F.col("n") <= bar).drop("n"), "fp")
    return often.unionByName(rest).select("doc_id", "fp", "component_id")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, whatever ids its rows have: of the smallest id, or of none where no row has one.

    Rows are told apart by id and text, so null ids and ids met in several groups stay once in each of these.
    """
    keys = {"_id": F.coalesce(F.col(id_col).cast("string"), F.lit("null")), "_digest": F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))}
    keyed = docs.withColumns(keys)
    marked = fingerprints(keyed, id_col, text_col, tuple(keys))
    least = F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "_digest", "_id")).alias("first")
    firsts = written(marked.groupBy("fp").agg(least), "distinct")
    stay = written(rooted(firsts).groupBy("root").agg(F.min("first").alias("first")).select("first._id", "first._digest"), "stay")
    dropped(docs.sparkSession, firsts)
    # copies of a row go before rows are dealt by key; an inner join, as a semi-join would be pushed below that
    return keyed.dropDuplicates([*keys]).join(stay, [*keys]).select(*docs.columns)
