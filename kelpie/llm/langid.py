"""Language identification with a byte convolutional network.

Bytes (ASCII lower-cased) are embedded, filters of several widths run over them, each filter's strongest answer in a
window is kept (max pooling), and a softmax over those names the language. The network is trained in numpy on windows of
labelled texts with Adam. Applied, the embedding and a filter's weights at one offset are one table of 256 rows, so a
convolution is a sum of table rows; windows of fixed length go through in batches. All windows of a text are read, and
their probabilities are averaged.

Training takes a bounded sample: WINDOWS_PER_DOC windows, cut where the texts are, of up to DOCS_PER_LANG documents of each
of the LANGS commonest languages, and of no more than TRAIN_DOCS documents in all; everything else covers all rows.

Defined results: null texts and texts without a letter are ``und`` with score 0; a text shorter than a window is
padded with zero bytes; with no labelled rows everything is ``und``; null languages teach nothing; repeated rows get
equal predictions; clashing columns of the input are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 16, 8
DOCS_PER_LANG, WINDOWS_PER_DOC = 800, 4
LANGS, TRAIN_DOCS = 256, 25_600
STEPS, BATCH, RATE = 260, 96, 0.01
#: Windows that go through the tables at a time.
AT_ONCE = 96


@dataclass
class Network:
    langs: list[str]
    tables: list[np.ndarray]  # per width: (width, 256, FILTERS), float32
    biases: list[np.ndarray]
    weights: np.ndarray  # (filters, langs)
    offset: np.ndarray

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Max-pooled filter answers of windows of bytes, (n, WINDOW) to (n, all filters)."""
        n, out = len(windows), []
        for width, t, bias in zip(WIDTHS, self.tables, self.biases):
            span = WINDOW - width + 1
            acc = t[0][windows[:, :span]]
            for k in range(1, width):
                acc += t[k][windows[:, k : k + span]]
            out.append(np.maximum(acc.max(axis=1) + bias, 0))
        return np.concatenate(out, axis=1).reshape(n, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for a in range(0, len(windows), AT_ONCE):
            z = self.pooled(windows[a : a + AT_ONCE]) @ self.weights + self.offset
            z = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)))

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """Language and its mean window probability for each text."""
        known = [t is not None and has_letter(t) and bool(self.langs) for t in texts]
        lows = [t.lower() if ok else b"" for t, ok in zip(texts, known)]
        counts = np.array([-(-len(t) // WINDOW) for t in lows], np.int64)
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not counts.sum():
            return langs, scores
        whole = b"".join([t.ljust(int(c) * WINDOW, b"\0") for t, c in zip(lows, counts)])
        p = self.probabilities(np.frombuffer(whole, np.uint8).reshape(-1, WINDOW))
        rows = np.flatnonzero(counts)
        starts = np.concatenate(([0], np.cumsum(counts[rows])[:-1]))
        mean = np.add.reduceat(p, starts, axis=0) / counts[rows][:, None]
        best = mean.argmax(axis=1)
        for r, b, s in zip(rows, best, mean.max(axis=1)):
            langs[r], scores[r] = self.langs[b], min(1.0, float(s))
        return langs, scores


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter; only texts without an ASCII one are decoded."""
    return has_letter.ascii(text) is not None or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def _ascii_letter():
    import re

    return re.compile(rb"[A-Za-z]").search


has_letter.ascii = _ascii_letter()


def windows_of(text: bytes) -> list[bytes]:
    """Training windows at random places of a text, some cut short as short texts are. Equal texts have equal windows."""
    rng, out = np.random.default_rng(zlib.crc32(text)), []
    for _ in range(WINDOWS_PER_DOC):
        length = WINDOW if rng.random() < 0.75 else int(rng.integers(12, WINDOW))
        a = int(rng.integers(0, max(1, len(text) - length + 1)))
        out.append(text[a : a + length].lower().ljust(WINDOW, b"\0"))
    return out


def train(windows: list[bytes], langs: list[str], seed: int = 5) -> Network:
    """A network from labelled windows; every language weighs the same."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    wide = FILTERS * len(WIDTHS)
    p = {"e": rng.normal(0, 0.3, (256, EMBED)), "w": np.zeros((wide, len(names))), "o": np.zeros(len(names))}
    for w in WIDTHS:
        p[f"f{w}"], p[f"b{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)), np.zeros(FILTERS)
    p["w"] = rng.normal(0, 0.1, p["w"].shape)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    if len(names) > 1:
        x = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW)
        y = np.searchsorted(names, np.array(langs))
        share = 1 / np.bincount(y, minlength=len(names))[y]
        share /= share.sum()
        first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            pick = rng.choice(len(x), BATCH, p=share)
            grads = _gradients(p, x[pick], y[pick])
            rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return compiled(p, names)


def compiled(p: dict[str, np.ndarray], names: list[str]) -> Network:
    """The network with each filter's weights at an offset multiplied into the embedding: a table of 256 rows."""
    tables = [np.stack([p["e"] @ p[f"f{w}"][k * EMBED : (k + 1) * EMBED] for k in range(w)]).astype(np.float32) for w in WIDTHS]
    return Network(names, tables, [p[f"b{w}"] for w in WIDTHS], p["w"], p["o"])


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy of a batch."""
    n, ids = len(x), np.arange(FILTERS)
    e, pools, kept = p["e"][x], [], []
    for w in WIDTHS:
        span = WINDOW - w + 1
        cols = np.concatenate([e[:, k : k + span] for k in range(w)], axis=2)
        z = cols.reshape(n * span, -1) @ p[f"f{w}"]
        z = z.reshape(n, span, FILTERS)
        at = z.argmax(axis=1)
        top = z[np.arange(n)[:, None], at, ids[None, :]] + p[f"b{w}"]
        pools.append(np.maximum(top, 0))
        kept.append((at, top > 0, cols))
    h = np.concatenate(pools, axis=1)
    z = h @ p["w"] + p["o"]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(n), y] -= 1
    z /= n
    out = {"w": h.T @ z, "o": z.sum(axis=0), "e": np.zeros_like(p["e"])}
    back = z @ p["w"].T
    for i, (w, (at, live, cols)) in enumerate(zip(WIDTHS, kept)):
        d = back[:, i * FILTERS : (i + 1) * FILTERS] * live  # (n, FILTERS), only at the pooled places
        seen = cols[np.arange(n)[:, None], at]  # (n, FILTERS, w * EMBED)
        out[f"f{w}"] = np.einsum("nf,nfc->cf", d, seen)
        out[f"b{w}"] = d.sum(axis=0)
        into = np.einsum("nf,cf->nfc", d, p[f"f{w}"]).reshape(n, FILTERS, w, EMBED)
        for k in range(w):
            np.add.at(out["e"], x[np.arange(n)[:, None], at + k], into[:, :, k])
    return out


def fit(docs: DataFrame, parts: int = 4, out: int = 2) -> Network:
    """A network learned from text and lang of the learning folds; see the module's text for the sample's bounds."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", parts, out))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()
    if not counts:
        return Network([], [], [], np.zeros((0, 0)), np.zeros(0))
    each = min(DOCS_PER_LANG, TRAIN_DOCS // len(counts))
    shares = docs.sparkSession.createDataFrame([(r["lang"], int(1_000_000 * min(1, each / r["count"]))) for r in counts], "lang string, share int")
    drawn = rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(23)), F.lit(1_000_000)) < F.col("share"))
    # a repeated id does not widen the sample
    drawn = drawn.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def cut(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(windows_of(t)) for t in texts], pa.binary())], ["lang", "windows"])

    got = drawn.select("lang", "text").mapInArrow(cut, "lang string, windows binary").toArrow().sort_by([("lang", "ascending"), ("windows", "ascending")])
    langs = [lang for lang in got.column("lang").to_pylist() for _ in range(WINDOWS_PER_DOC)]
    return train(got.column("windows").to_pylist(), langs)


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, lang_pred and score of every document."""

    def run(batches):
        for batch in batches:
            langs, scores = [], []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a in range(0, len(texts), 500):
                some, p = network.predict(texts[a : a + 500])
                langs += some
                scores.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
