"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Shallow trees on one feature at a time are boosted in turn, round after round,
and their leaf values are added into that feature's lookup table; then the pairs of features that the residuals bear out
most get tables of their own, boosted with trees that split one feature and then the other. A text's score is the
logistic of the intercept and its tables' entries, so scoring a batch is one vectorised addition a table.

Features come from the whole text and from nothing else. They are written once, and training takes a bounded sample of
labelled rows (TRAIN_ROWS); everything else covers all rows.

Defined results: null and empty texts have all-zero features and get a score like any text; without labelled rows of
both kinds every score is the share of label 1 (0.5 without any); repeated rows score alike; null doc_ids are held
out of learning; clashing columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

from .common import dropped, held_out, labelled_sample, table, written

TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 10, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
NAMES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "bangs", "stops", "commas", "newlines", "high_bytes",
    "distinct", "commonest", "same_as_last", "dup_lines", "line_words", "capitals", "long_words", "odd_words", "window_repeats",
)
_CLASSES = ("upper", "digits", "symbols", "bangs", "stops", "commas", "newlines", "high", "letters")


def _class_table() -> np.ndarray:
    t = np.zeros((256, len(_CLASSES)), np.float32)
    for b in range(256):
        c = chr(b)
        t[b, 0] = "A" <= c <= "Z"
        t[b, 1] = "0" <= c <= "9"
        t[b, 2] = c in "#*$%&|<>{}[]=_~^@\\"
        t[b, 3] = c in "!?"
        t[b, 4] = c == "."
        t[b, 5] = c in ",;:"
        t[b, 6] = c == "\n"
        t[b, 7] = b >= 128
        t[b, 8] = c.isalpha() if b < 128 else 1
    return t


def features(text: bytes | None) -> np.ndarray:
    """The NAMES of a text."""
    out = np.zeros(len(NAMES), np.float32)
    ws = (text or b"").split()
    if not ws:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ features.classes
    upper, digits, symbols, bangs, stops, commas, newlines, high, letters = counts.tolist()
    n, size = len(ws), len(text)
    seen = Counter(ws)
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = Counter(zip(ws, ws[1:], ws[2:]))
    out[:] = (
        np.log1p(size), np.log1p(n), sum(map(len, ws)) / n, upper / max(1, letters), digits / size, symbols / n, bangs / n, stops / n, commas / n,
        newlines / n, high / size, len(seen) / n, max(seen.values()) / n, sum(a == b for a, b in zip(ws, ws[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), sum(w[:1].isupper() for w in seen) / len(seen),
        sum(len(w) > 14 for w in seen) / len(seen), sum(not w.isalnum() for w in seen) / len(seen),
        sum(triples.values()) / max(1, n) - len(triples) / max(1, n),
    )
    return out


features.classes = _class_table()


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``also``, and x, the features, of every document."""

    def run(batches):
        for batch in batches:
            x = [features(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rest = [batch.column(c) for c in also]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest, pa.array(x, pa.list_(pa.float32()))], ["doc_id", *also, "x"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *also)
    return slim.mapInArrow(run, StructType([StructField("doc_id", LongType()), *[docs.schema[c] for c in also], StructField("x", ArrayType(FloatType()))]))


def _leaf(g, h):
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def grow(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values per bin of a tree on one feature, from sums of gradients and curvatures per bin; splits are best first."""
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    parts = [(0, len(g))]

    def best(a, b):
        if b - a < 2:
            return 0.0, -1
        k = np.arange(a + 1, b)
        gain = _gain(cg[k] - cg[a], ch[k] - ch[a]) + _gain(cg[b] - cg[k], ch[b] - ch[k]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
        i = int(gain.argmax())
        return float(gain[i]), int(k[i])

    open_ = [(*best(0, len(g)), 0, len(g))]
    while open_ and len(parts) < leaves:
        i = max(range(len(open_)), key=lambda j: open_[j][0])
        gain, k, a, b = open_.pop(i)
        if k < 0 or gain <= 1e-6:
            continue
        parts.remove((a, b))
        parts += [(a, k), (k, b)]
        open_ += [(*best(a, k), a, k), (*best(k, b), k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def grow_pair(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values per cell of the best tree that splits one feature and then, on each side, the other."""
    best, values = 0.0, np.zeros_like(g)
    total = _gain(g.sum(), h.sum())
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        cg, ch = np.cumsum(gg, axis=0), np.cumsum(hh, axis=0)
        for k in range(1, len(gg)):
            sides = ((cg[k - 1], ch[k - 1]), (cg[-1] - cg[k - 1], ch[-1] - ch[k - 1]))
            gain, cuts = -total, []
            for sg, sh in sides:
                lg, lh = np.cumsum(sg)[:-1], np.cumsum(sh)[:-1]
                both = _gain(lg, lh) + _gain(sg.sum() - lg, sh.sum() - lh)
                m = int(both.argmax())
                gain += float(both[m])
                cuts.append((m + 1, _leaf(lg[m], lh[m]), _leaf(sg.sum() - lg[m], sh.sum() - lh[m])))
            if gain > best:
                best, out = gain, np.zeros_like(gg)
                for rows, (m, left, right) in zip((slice(0, k), slice(k, None)), cuts):
                    out[rows, :m], out[rows, m:] = left, right
                values = out if axis == 0 else out.T
    return best, values


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        if self.tables and len(x):
            b = self.bins(x)
            for j, t in enumerate(self.tables):
                z += t[b[:, j]]
            for (i, j), t in zip(self.pairs, self.pair_tables):
                z += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    model = Model(float(np.log(share / (1 - share))))
    if n < 20 or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    z = np.full(n, model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, size in enumerate(sizes):
            g, h = slopes()
            step = RATE * grow(np.bincount(b[:, j], g, size), np.bincount(b[:, j], h, size))
            model.tables[j] += step
            z += step[b[:, j]]
    model.coarse = [np.minimum(np.arange(s) * PAIR_BINS // s, PAIR_BINS - 1) for s in sizes]
    c = np.stack([m[b[:, j]] for j, m in enumerate(model.coarse)], axis=1)

    def cells(i, j, w):
        return np.bincount(c[:, i] * PAIR_BINS + c[:, j], w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    g, h = slopes()
    found = sorted(((grow_pair(cells(i, j, g), cells(i, j, h))[0], i, j) for i in range(len(sizes)) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in found[:PAIRS] if gain > 1e-3]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for t, (i, j) in zip(model.pair_tables, model.pairs):
            g, h = slopes()
            step = RATE * grow_pair(cells(i, j, g), cells(i, j, h))[1]
            t += step
            z += step[c[:, i], c[:, j]]
    return model


def fit(x: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, out: int = 0) -> Model:
    """Model of the features x (doc_id, x) learned from at most about TRAIN_ROWS labelled ids of the learning folds."""
    return learned(labelled_sample(x, labels, label, TRAIN_ROWS, "x", "doc_id", parts, out))


def learned(sample: DataFrame) -> Model:
    """Model of a bounded sample (doc_id, x, label)."""
    rows = sample.toArrow().sort_by("doc_id")
    xs = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)) if rows.num_rows else np.zeros((0, len(NAMES)))
    return train(xs.astype(np.float64), (rows.column("label").to_numpy() > 0).astype(float) if rows.num_rows else np.zeros(0))


def scored(x: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of the features."""

    def run(batches):
        for batch in batches:
            xs = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(xs.astype(np.float64)))], ["doc_id", "score"])

    return x.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    x = written(featured(docs), "quality-features")
    out = scored(x, fit(x, labels))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score at least the threshold. Texts are scored where they are, without a join."""
    sample = written(labelled_sample(docs, labels, "quality", TRAIN_ROWS), "quality-sample", TRAIN_ROWS // 24)
    model = learned(featured(sample, also=("label",)))
    dropped(docs.sparkSession, sample)
    columns = docs.columns

    def run(batches):
        for batch in batches:
            xs = [features(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            good = model.score(np.array(xs, np.float64).reshape(-1, len(NAMES))) >= threshold
            yield batch.filter(pa.array(good))

    return docs.select(*columns).mapInArrow(run, docs.schema)


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
