"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens that accepts exactly the token sequences
BPE produces. It starts with one state in which every base symbol loops. The gadget of a merge (u, v) acts where a
u-transition is followed by a v-transition: the u-transition is led to a copy of its target that has lost v, and a
uv-transition goes where v led. All transitions of one token lead to one state at any time, so the automaton is kept as
the state of each token and, per state, the state it was copied from, the token it lost and when. A token is a
transition of a state if no token on its left spine was lost there before the merge that built on it; such answers
are cached in the transition table that encoding is driven by.

A pre-split word is encoded by running the automaton over it, longest arc first; the path that spans the word is the
only one, places from which it cannot be reached are marked, so no place and state is left twice. Decoding emits the
labels of the arcs.

The vocabulary file is read with the tokenizers library's format; normalising and splitting follow the file (NFC, runs
of blanks to one space, lower case one character at a time; the file's pattern). Text is whole; special tokens written
out in a text become their ids.

Defined results: a null text is encoded as an empty one, which has no tokens; very long words are encoded in one run;
ties cannot occur, repeated rows are encoded alike; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Runs between blanks whose encodings a worker remembers; the memory is emptied when it is full.
REMEMBERED = 500_000
#: Arcs of this many symbols or more are looked up by their first symbols before any is tried.
HEAD = 4


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Automaton:
    """Token automaton of a merge list; see the module's text."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        self.label = {i: t for t, i in vocab.items()}
        made = {}  # token: (left part, time of its merge)
        copied: list[tuple[int, int]] = [(-1, -1)]  # per state: the state it was copied from, and when
        state: dict[int, int] = {}
        own: list[dict[int, int]] = [{}]  # per state: tokens lost since the copy, with their times
        self._made, self._copied, self._own, self.state = made, copied, own, state
        heads = set()  # tokens whose transitions alone lead to their state
        for t in vocab.values():
            state[t] = 0
        for rank, (left, right) in enumerate(merges):
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            was, target = state[u], state[v]
            # a doubled token is lost just before its merge: no lone copy may precede the merged one
            time, lost = 2 * rank, 2 * rank - (u == v)
            if w in made or not self._has(was, v, time):
                continue
            made[w] = (u, time)
            if v in heads:  # w goes where v led until now; what v loses from now on is not lost after w
                copied.append((target, lost))
                own.append({})
                state[w] = len(copied) - 1
                heads.add(w)
            else:
                state[w] = target
            if u not in heads:  # the first loss after u: its transitions move to a copy of their own
                copied.append((was, lost))
                own.append({})
                state[u] = len(copied) - 1
                heads.add(u)
            own[state[u]].setdefault(v, lost)
        self._table: dict[tuple[int, int], bool] = {}

    def _lost(self, q: int, token: int, before: int) -> bool:
        """Whether state q lost the token before the time."""
        while q >= 0:
            at = self._own[q].get(token)
            if at is not None and at < before:
                return True
            parent, when = self._copied[q]
            before = min(before, when)  # what the parent lost after the copy is not lost here
            q = parent
        return False

    def _has(self, q: int, token: int, before: int) -> bool:
        while True:
            if self._lost(q, token, before):
                return False
            if token not in self._made:
                return True
            token, before = self._made[token]

    def allows(self, last: int, token: int) -> bool:
        """Whether the token is a transition of the state that the last token leads to (-1: the start)."""
        if last < 0:
            return True
        key = (last, token)
        if (known := self._table.get(key)) is None:
            if len(self._table) > 2_000_000:
                self._table.clear()
            known = self._table[key] = self._has(self.state[last], token, 1 << 60)
        return known

    def arcs(self, end: str) -> tuple[dict[str, int], dict[str, int], dict[str, int]]:
        """Labels that can be arcs inside a word, those that end it (without the mark), and the longest by first HEAD symbols."""
        inner, last = {}, {}
        for label, t in self.vocab.items():
            bare = label[: -len(end)] if end and label.endswith(end) else label
            if t in self._made or len(bare) == 1:
                (inner if bare is label else last)[bare] = t
        last = last if end else inner
        reach: dict[str, int] = {}
        for bare in (*inner, *last):
            if len(bare) >= HEAD:
                reach[bare[:HEAD]] = max(reach.get(bare[:HEAD], HEAD), len(bare))
        return inner, last, reach

    def encode(self, word: str, arcs: tuple[dict[str, int], dict[str, int], dict[str, int]]) -> list[int]:
        """Ids of a pre-split word of base symbols, one character each."""
        inner, final, reach = arcs
        if (one := final.get(word)) is not None:
            return [one]
        n, far, table, short = len(word), reach.get, self._table, HEAD - 1
        dead = set()
        path: list[int] = []
        places: list[int] = []
        at, last, stop = 0, -1, min(n, far(word[:HEAD], short))
        while at < n:
            found = None
            while stop > at:
                t = final.get(word[at:]) if stop == n else inner.get(word[at:stop])
                if t is not None and (last < 0 or ((ok := table.get((last, t))) or ok is None and self.allows(last, t))) and (not dead or (stop, t) not in dead):
                    found = t
                    break
                stop -= 1
            if found is not None:
                path.append(found)
                places.append(stop)
                at, last = stop, found
                stop = min(n, at + far(word[at : at + HEAD], short))
            else:
                if not path:
                    raise ValueError(f"no path for {word!r}")
                dead.add((at, path.pop()))
                stop = places.pop() - 1
                at, last = (places[-1], path[-1]) if path else (0, -1)
        return path


class Memory(dict):
    """A dict that works out what it misses, and forgets all when it is full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[key] = self.make(key)
        return got


class WordTokenizer:
    """Encoder and decoder of a word-level BPE file with an end-of-word mark."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]] != ["Split", "ByteLevel"]:
            raise ValueError("not a file of word-level BPE")
        self.end = model["end_of_word_suffix"] or ""
        vocab = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = Automaton(vocab, [tuple(m) for m in model["merges"]])
        self.label = {**self.automaton.label, **{i: t for t, i in self.special.items()}}
        self.symbols = dict(enumerate(byte_symbols()))
        self.arcs = self.automaton.arcs(self.end)
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.blank = regex.compile(r"\s+")
        # no word of the pattern reaches over a blank, so runs between blanks are split and encoded once
        self.words = Memory(self.word)
        self.runs = Memory(self.pieces)
        self.odd = regex.compile("[\x1c-\x1f]").search  # str.split takes these for blanks, the pattern doesn't

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if text.isascii():
            return text.lower()
        text = text.replace("Σ", "σ")  # one character at a time: no final sigma
        return text.lower()

    def word(self, w: str) -> tuple[bytes, str]:
        ids = self.automaton.encode(w.encode().decode("latin-1").translate(self.symbols), self.arcs)
        return array("I", ids).tobytes(), " ".join([self.label[i] for i in ids])

    def pieces(self, run: str) -> tuple[bytes, str]:
        """Ids and labels of a run between blanks."""
        got = [self.words[w] for w in self.split(run)]
        return got[0] if len(got) == 1 else (b"".join([g[0] for g in got]), " ".join([g[1] for g in got]))

    def _part(self, text: str) -> tuple[bytes, str]:
        text = self.normal(text)
        runs = self.blank.split(text) if self.odd(text) else text.split()
        got = [self.runs[r] for r in runs]
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])

    def run(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit integers, and the decoded text."""
        if self.specials is None or not any(s in text for s in self.special):
            return self._part(text)
        got = [(np.array([self.special[p]], "<u4").tobytes(), p) if p in self.special else self._part(p) for p in self.specials.split(text) if p]
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.run(text)[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.label[i] for i in ids if i in self.label])


@lru_cache(2)
def loaded(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> and decoded string of every document."""

    def run(batches):
        tok = loaded(path)
        for batch in batches:
            ids, texts = [], []
            for t in batch.column(1).to_pylist():
                raw, said = tok.run(t or "")
                ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                texts.append(said)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The encodings' digests, worked out where the text is, so that ids and texts never cross a process."""

    def run(batches):
        tok = loaded(path)
        for batch in batches:
            counts, ids, said = [], [], []
            for t in batch.column(1).to_pylist():
                raw, decoded = tok.run(t or "")
                counts.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                said.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(said, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_automaton(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return digest(table(spark, sf_dir, "documents"), path)
