"""Toxicity: a linear-chain conditional random field that tags toxic spans.

Tokens are runs of letters, digits and marks; each is one of two states, toxic or not. Emissions come from the lower-cased word and
its prefixes, transitions from the state before. Token labels for training come from labelled documents: a token of a
toxic document is labelled toxic if its word or one of its prefixes is found in toxic documents far more often than
chance allows, and never or hardly elsewhere; all tokens of other documents are labelled not toxic. The field is trained on
the likelihood of pieces of these, with forward-backward marginals: of toxic documents the marked tokens with AROUND
tokens on either side (none where no token is marked), of others CHAINS random windows of CHAIN_TOKENS tokens; the rest of
their tokens takes part in the evidence and the logistic only. For every document the marginals of all its tokens are worked out
exactly; their largest and their sum give the score through a logistic fitted on documents, and runs of tokens with
marginals of a half or more are the offending spans.

Training takes a bounded sample: at most about TRAIN_ROWS labelled documents, of these the KEYS strongest words and prefixes as
evidence, and CHAINS chains a document of at most CHAIN_TOKENS tokens. Words are counted, chains are cut and documents are
summed up where the texts are; only keys, chains and two numbers a document come to the driver. Everything else covers all
rows and whole texts.

Defined results: null and empty texts, and texts without tokens, score what no evidence scores; without toxic labelled
rows every score is next to 0 (below 1e-12); repeated rows score alike; null doc_ids are held out of learning; clashing
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, held_out, labelled_sample, table, written

TRAIN_ROWS = 6_000
PREFIXES = (4, 5, 6)
SLOTS = 1 << 18
#: A word or prefix is toxic evidence above this likelihood ratio statistic and rate ratio, found this often at least.
EVIDENCE, RATIO, MET = 40.0, 8.0, 6
KEYS = 20_000
#: Occurrences that a worker holds to leave out repeated ones before it sends them.
HELD = 100_000
AROUND, CHAINS, CHAIN_TOKENS = 6, 2, 24
PASSES, RATE = 20, 0.3
#: Tokens whose chains are worked out together, and words whose emissions a worker remembers.
TOKENS, REMEMBERED = 400_000, 400_000
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def keys_of(word: str) -> list[str]:
    return [word, *[f"{n}^{word[:n]}" for n in PREFIXES if len(word) >= n]]


def slots_of(word: str) -> list[int]:
    return [zlib.crc32(k.encode()) % SLOTS for k in keys_of(word)]


@dataclass
class Field:
    weights: np.ndarray  # per slot, evidence for toxic
    bias: float
    move: np.ndarray  # (2, 2) log weights from state to state
    link: tuple[float, float, float]  # logistic: constant, largest marginal's log-odds, log of 1 + their sum

    def emission(self, word: str) -> float:
        return float(self.weights[slots_of(word)].sum()) + self.bias


def marginals(e: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(toxic) of every token: e are the tokens' emissions, chain after chain of the given lengths."""
    return messages(e, lengths, move)[0]


def messages(e: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic), forward and backward message of every token.

    Forward and backward messages are ratios of the two states, carried on through all chains at once, longest first.
    """
    if not len(e):
        return np.zeros(0), np.zeros(0), np.zeros(0)
    x = np.exp(np.clip(e, -30, 30))
    a = np.exp(move)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    order = np.argsort(-lengths, kind="stable")
    first, left = starts[order], lengths[order]
    fore, back = np.empty(len(e)), np.ones(len(e))
    live = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), side="right")  # chains that have a t-th token
    r = x[first[: live[0]]]
    fore[first[: live[0]]] = r
    for t in range(1, int(left[0])):
        n = live[t]
        r = r[:n]
        r = x[first[:n] + t] * ((a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0]))
        fore[first[:n] + t] = r
    # backward runs from the chains' ends, so that all end together
    last = first + left - 1
    b = np.ones(int(live[0]))
    for t in range(1, int(left[0])):
        n = live[t]
        at = last[:n] - t
        s = x[at + 1] * b[:n]
        b = (a[1, 0] + s * a[1, 1]) / (a[0, 0] + s * a[0, 1])
        back[at] = b
    odds = fore * back
    return odds / (1 + odds), fore, back


def evidence(sample: DataFrame) -> set[str]:
    """Keys that mark toxic documents of the sample (text, label), by the likelihood ratio test of their rates in the two kinds, and the ratio.

    Occurrences between the same two neighbours count once, so copies of a document are no evidence of their own.
    """

    def met(batches):
        seen: set[tuple[bool, str, str]] = set()

        def out():
            columns = [pa.array([s[i] for s in seen], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.string()))]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, ["toxic", "word", "place"])

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                ws = ["", *TOKEN.findall((text or "").lower()), ""]
                seen.update((label > 0, w, f"{a} {b}") for a, w, b in zip(ws, ws[1:], ws[2:]))
                if len(seen) > HELD:
                    yield out()
        yield out()

    places = sample.mapInArrow(met, "toxic boolean, word string, place string").select("toxic", "word", F.xxhash64("place").alias("place")).distinct()
    words = places.groupBy("word").agg(F.count_if(F.col("toxic")).alias("k1"), F.count_if(~F.col("toxic")).alias("k0"))
    prefixes = [F.when(F.length("word") >= n, F.concat(F.lit(f"{n}^"), F.substring("word", 1, n))) for n in PREFIXES]
    keys = words.select(F.explode(F.array_compact(F.array(F.col("word"), *prefixes))).alias("key"), "k1", "k0")
    keys = keys.groupBy("key").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0")).filter(F.col("k1") >= MET)
    totals = F.broadcast(words.agg((F.sum("k1") + 1).alias("n1"), (F.sum("k0") + 1).alias("n0")))  # one row
    share = (F.col("k1") + F.col("k0")) / (F.col("n1") + F.col("n0"))
    gain = F.col("k1") * F.log(F.col("k1") / F.col("n1") / share) + F.when(F.col("k0") > 0, F.col("k0") * F.log(F.col("k0") / F.col("n0") / share)).otherwise(0)
    strong = keys.crossJoin(totals).filter(F.col("k1") / F.col("n1") >= RATIO * (F.col("k0") + 0.5) / F.col("n0")).withColumn("gain", 2 * gain)
    return {r["key"] for r in strong.filter(F.col("gain") > EVIDENCE).orderBy(F.desc("gain"), "key").limit(KEYS).collect()}


def cut_chains(words: list[str], toxic: bool, marked: Callable[[str], bool], rng) -> list[tuple[list[str], list[int]]]:
    """Training chains of a document with their labels: the surroundings of marked tokens, or pieces of a clean document."""
    if not toxic:
        starts = [int(rng.integers(0, max(1, len(words) - 2 * AROUND))) for _ in range(CHAINS)]
        pieces = [words[a : a + CHAIN_TOKENS] for a in starts]
        return [(p, [0] * len(p)) for p in pieces if p]
    y = [int(marked(w)) for w in words]
    hits = np.flatnonzero(y)
    out = []
    for group in np.split(hits, np.flatnonzero(np.diff(hits) > 2 * AROUND) + 1) if len(hits) else []:
        a, b = max(0, int(group[0]) - AROUND), int(group[-1]) + AROUND + 1
        out += [(words[i : min(b, i + CHAIN_TOKENS)], y[i : min(b, i + CHAIN_TOKENS)]) for i in range(a, min(b, len(words)), CHAIN_TOKENS)]
    return out[:CHAINS]


def chains_of(sample: DataFrame, keys: set[str]) -> DataFrame:
    """Chains of the sample (text, label): words, and labels as text of 0 and 1."""

    def cut(batches):
        known: dict[str, bool] = {}

        def marked(word: str) -> bool:
            if word not in known:
                known[word] = any(k in keys for k in keys_of(word))
            return known[word]

        for batch in batches:
            got = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                ws = TOKEN.findall((text or "").lower())
                got += cut_chains(ws, label > 0, marked, np.random.default_rng(zlib.crc32((text or "").encode())))
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(ws) for ws, _ in got], pa.string()), pa.array(["".join(map(str, y)) for _, y in got], pa.string())], ["words", "y"])

    return sample.mapInArrow(cut, "words string, y string")


def learn(chains: list[list[str]], labels: list[np.ndarray]) -> Field:
    """Weights, bias and moves of a field from labelled chains of words; its link is still to be fitted."""
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for c in chains for w in c], np.int64)
    met, y = list(number), np.concatenate(labels).astype(float)
    slots = [slots_of(w) for w in met]
    flat = np.array([s for ss in slots for s in ss], np.int64)
    owner = np.repeat(np.arange(len(met)), [len(ss) for ss in slots])
    lengths = np.array([len(c) for c in chains])
    inner = np.ones(len(y), bool)
    inner[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = False  # tokens with one before
    inner = np.flatnonzero(inner)
    weights, bias, move = np.zeros(SLOTS), -2.0, np.zeros((2, 2))
    seen_w, seen_b, seen_m = np.full(SLOTS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    n = len(y)
    was, now = y[inner - 1], y[inner]
    real = np.array([[((1 - was) * (1 - now)).sum(), ((1 - was) * now).sum()], [(was * (1 - now)).sum(), (was * now).sum()]])
    for _ in range(PASSES):
        e = (np.bincount(owner, weights[flat], len(met)) + bias)[ids]
        p, fore, back = messages(e, lengths, move)
        g = np.bincount(flat, np.bincount(ids, y - p, len(met))[owner], SLOTS) - 1e-3 * weights
        seen_w += g * g
        weights += RATE * g / np.sqrt(seen_w)
        gb = float((y - p).sum()) / n
        seen_b += gb * gb
        bias += RATE * gb / seen_b**0.5
        gm = (real - _pairs(e, fore, back, move, inner)) / n - 1e-3 * move
        seen_m += gm * gm
        move += 0.1 * gm / np.sqrt(seen_m)
    return Field(weights.astype(np.float32), bias, move, (0.0, 1.0, 0.0))


def _pairs(e: np.ndarray, fore: np.ndarray, back: np.ndarray, move: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Expected counts of the four moves between neighbours, summed over all chains."""
    a = np.exp(move)
    f, s = fore[inner - 1], np.exp(np.clip(e[inner], -30, 30)) * back[inner]
    cells = np.stack([a[0, 0] * np.ones_like(f), a[0, 1] * s, f * a[1, 0], f * a[1, 1] * s])
    return (cells / cells.sum(axis=0)).sum(axis=1).reshape(2, 2)


def summary(p: np.ndarray) -> tuple[float, float]:
    if not len(p):
        return -12.0, 0.0
    top = float(np.clip(p.max(), 6e-6, 1 - 6e-6))
    return float(np.log(top / (1 - top))), float(np.log1p(p[p >= 0.05].sum()))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(3), np.diag([1e-3, 0.3, 0.3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return tuple(float(v) for v in w)


class Emissions(dict):
    """Emissions by word, worked out once and forgotten when there are too many."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[word] = self.field.emission(word)
        return got


def field_marginals(field: Field, tokens: list[list[str]], known: Emissions | None = None):
    """Marginals of each document's tokens, in the documents' order, for about TOKENS tokens at a time."""
    known = Emissions(field) if known is None else known
    held: list[np.ndarray] = []

    def done():
        lengths = np.array([len(h) for h in held])
        p = marginals(np.concatenate(held), lengths, field.move) if lengths.sum() else np.zeros(0)
        return np.split(p, np.cumsum(lengths)[:-1])

    size = 0
    for ws in tokens:
        held.append(np.fromiter(map(known.__getitem__, ws), float, len(ws)))
        size += len(ws)
        if size >= TOKENS:
            yield from done()
            held, size = [], 0
    if held:
        yield from done()


def spans(text: str, p: np.ndarray) -> list[tuple[int, int]]:
    """Offsets (start, past) in code points of the lower-cased text of the runs of tokens that are more likely toxic than not."""
    out: list[tuple[int, int]] = []
    was = False
    lower = text.lower()
    for m, bad in zip(TOKEN.finditer(lower), p >= 0.5):
        if bad and was:
            out[-1] = (out[-1][0], m.end())
        elif bad:
            out.append((m.start(), m.end()))
        was = bad
    return out


def no_field() -> Field:
    return Field(np.zeros(SLOTS, np.float32), -8.0, np.zeros((2, 2)), (-30.0, 0.0, 0.0))


def fit_sample(sample: DataFrame) -> Field:
    """A field learned from a bounded sample (text, label), which is read three times."""
    keys = evidence(sample)
    got = chains_of(sample, keys).toArrow() if keys else None
    if got is None or not got.num_rows:
        return no_field()
    got = got.sort_by([("words", "ascending"), ("y", "ascending")])
    field = learn([w.split(" ") for w in got.column("words").to_pylist()], [np.frombuffer(y.encode(), np.uint8) - 48 for y in got.column("y").to_pylist()])
    sums = summed(sample, field).toArrow().sort_by([(c, "ascending") for c in ("top", "total", "label")])
    field.link = _logistic(np.column_stack([sums.column("top").to_numpy(), sums.column("total").to_numpy()]), (sums.column("label").to_numpy() > 0).astype(float))
    return field


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, out: int = 0) -> Field:
    """A field learned from at most about TRAIN_ROWS labelled documents of the learning folds."""
    sample = written(labelled_sample(docs, labels, label, TRAIN_ROWS, "text", "doc_id", parts, out).select("text", "label"), "toxicity-sample", TRAIN_ROWS // 24)
    field = fit_sample(sample)
    dropped(docs.sparkSession, sample)
    return field


def summed(sample: DataFrame, field: Field) -> DataFrame:
    """top, total and label of the sample (text, label): what the logistic is fitted on."""

    def run(batches):
        known = Emissions(field)
        for batch in batches:
            got = [summary(p) for p in field_marginals(field, (TOKEN.findall((t or "").lower()) for t in batch.column("text").to_pylist()), known)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), batch.column("label").cast(pa.int64())], ["top", "total", "label"])

    return sample.mapInArrow(run, "top double, total double, label long")


def tag(docs: DataFrame, field: Field, with_spans: bool = True) -> DataFrame:
    """doc_id, score and the offending spans of every document."""

    def run(batches):
        known = Emissions(field)
        constant, by_top, by_sum = field.link
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            scores, found = [], []
            for text, p in zip(texts, field_marginals(field, (TOKEN.findall(t.lower()) for t in texts), known)):
                top, total = summary(p)
                scores.append(1 / (1 + np.exp(-np.clip(constant + by_top * top + by_sum * total, -30, 30))))
                found.append([{"start": a, "past": b} for a, b in spans(text, p)] if with_spans and top >= 0 else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("past", pa.int32())])))], ["doc_id", "score", "spans"]
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,past:int>>")


def op2_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = tag(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
