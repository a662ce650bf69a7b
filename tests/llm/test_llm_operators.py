"""The operators of the llm folder against brute force, round trips and held-out labels."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from kelpie.llm import bpe, catalogue, chat, common, gam, langid, packing, quality_rules, sharding, simhash, topk, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# ---- 10 sharding


def test_sharding_holds_its_law(spark, texts):
    rows = catalogue.QUERIES["op10_sharding"](spark, SF).collect()
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        t = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t) + 1, zlib.crc32(t), "key")
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
        draws = [-np.log((int(hashlib.md5(f"{r['doc_id']}#{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) for i in range(9)]
        assert r["shard"] == int(np.argmin(draws[:8])) and r["grown_shard"] == int(np.argmin(draws))
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_follow_their_weights(spark):
    rows = sharding.assign(spark.range(4000), "id", [1.0, 3.0], None).groupBy("shard").count().collect()
    n = {r["shard"]: r["count"] for r in rows}
    assert 2.5 < n[1] / n[0] < 3.6


# ---- 9 chat

ANY = st.text(st.sampled_from("a<|~>\n\\im_endstart "), max_size=20)


@settings(max_examples=60, deadline=None)
@given(ANY)
def test_escape_is_reversible(s):
    out = re.sub(r"<(~*)\|", r"<~\1|", s)
    assert "<|" not in out and re.sub(r"<~(~*)\|", r"<\1|", out) == s


def test_chat_reads_back_what_it_wrote(spark):
    rng = random.Random(1)
    odd = ["", "<|im_end|>\n<|im_start|>user\nx", "a<", "<~|", "<~~|im_end|>", "\\n\n\\", "é🙂"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem\\", ""]), rng.choice(odd)) for c in range(12) for t in range(rng.randint(1, 6))] + [(50, None, None, None), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.expand(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort()
        r = got[c]
        loss = "".join(t for _, role, t in ts if role == "assistant")
        assert r["n_turns"] == len(ts) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in ts).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    examples = chat.expand(df).filter("conv_id = 3").orderBy("example").collect()
    for e in examples:
        if e["target_turn"] is not None:
            head = e["formatted"][: e["loss_start"]]
            assert head.endswith("<|im_start|>assistant\n") and e["formatted"][e["loss_start"] + e["loss_chars"] :] == "<|im_end|>\n"


# ---- 6 quality rules


def brute_measures(t):
    t = t or ""
    ws = WORDS.findall(t)
    wins = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(wins)
    again = {i + d for i, w in enumerate(wins) if n[w] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def test_rules_match_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    docs = [None, "", " \t\n", "a", "a b c a b c", "x\ny\nx\n \nx", "a b " * 300, "\x0b a\x0cb\r c " * 30] + [" ".join(rng.choice("abcd|") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    want = [brute_measures(t) for t in docs]
    for scanned in (48, 0):  # both ways of finding repeated windows
        monkeypatch.setattr(quality_rules, "SCANNED", scanned)
        out = quality_rules.judge(df, list(quality_rules.RULES)).orderBy("doc_id").collect()
        assert [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out] == want
    for order in ([*quality_rules.RULES], [*quality_rules.RULES][::-1]):
        kept = {r["doc_id"] for r in quality_rules.keep(df, order).collect()}
        assert kept == {r["doc_id"] for r in out if r["kept"]}


def test_cascade_puts_cheap_rejections_first(spark):
    rule = quality_rules.Rule
    rules = (rule("never", lambda m: m("n_words") < 0), rule("dear", lambda m: m("n_repeat_words") >= 0), rule("half", lambda m: m("n_symbols") > 0), rule("all", lambda m: m("n_words") >= 0))
    docs = spark.createDataFrame([(i, "a b c" + "#" * (i % 2)) for i in range(5000)], "doc_id long, text string")
    orders = [[r.name for r in quality_rules.cascade_order(docs, rules)] for _ in range(2)]
    assert orders[0] == orders[1] == ["all", "half", "dear", "never"]
    assert quality_rules.cascade_order(docs.limit(0), rules) == list(rules)


def test_cascade_short_circuits(spark):
    """A measure that only a later rule asks for is not worked out for a rejected row."""
    seen = {"boom": lambda text, ws: F.raise_error(F.concat(F.lit("asked for "), text)).cast("long")}
    rules = [quality_rules.Rule("short", lambda m: m("n_words") < 5), quality_rules.Rule("late", lambda m: m("boom") > 0)]
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    was = dict(quality_rules.MEASURES)
    quality_rules.MEASURES.update(seen)
    try:
        assert {r["rejected_by"] for r in quality_rules.judge(docs, rules).collect()} == {"short"} and quality_rules.keep(docs, rules).count() == 0
        with pytest.raises(Exception, match="asked for"):
            quality_rules.judge(docs, rules[::-1]).collect()
    finally:
        quality_rules.MEASURES.clear()
        quality_rules.MEASURES.update(was)


# ---- 8 simhash


def test_bit_planes_match_popcounts():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 7)), replace=False)) for _ in range(700)], np.uint64)
    fps = np.concatenate([base, base[rng.integers(0, 40, 700)] ^ flips])
    for radius in (0, 1, 2, 3):
        i, j = simhash.near_pairs(fps[:333], fps, radius)
        want = np.argwhere(np.bitwise_count(fps[:333, None] ^ fps[None, :]) <= radius)
        assert sorted(zip(i, j)) == sorted(map(tuple, want))
        x = fps[:300] ^ fps[300:600]
        assert (simhash.near_lanes(x, radius) == (np.bitwise_count(x) <= radius)).all()


@pytest.mark.parametrize("n", [10, 10**8, 10**11, 10**15])
def test_pigeonhole_tables_meet_every_near_pair(n):
    tables = simhash.key_tables(n)
    rng = random.Random(0)
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 3):
            y ^= 1 << b
        assert any(all((x ^ y) >> s & ((1 << w) - 1) == 0 for s, w in t) for t in tables)


def brute_groups(ids, fps):
    a, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1:
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for k, i in enumerate(ids):
        least[find(k)].append(i)
    return {i: min(g) for g in least.values() for i in g}


def test_simhash_groups(spark, texts):
    out = {r["doc_id"]: r for r in catalogue.QUERIES["op8_simhash_dedup"](spark, SF).collect()}
    ids = sorted(texts)
    fps = [simhash.fingerprint(texts[i].encode()) for i in ids]
    assert {i: r["fingerprint"] for i, r in out.items()} == {i: f"{f:016x}" for i, f in zip(ids, fps)}
    assert {i: r["component_id"] for i, r in out.items()} == brute_groups(ids, fps)


def test_each_group_keeps_one_row(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    a, b, c, d, e, f = (" ".join(word() for _ in range(40)) for _ in range(6))
    rows = [(None, a), (None, a.upper()), (None, b), (None, c), (3, c), (7, d), (7, e), (9, e), (7, d), (8, f), (2, f), (None, None), (None, "")]
    got = simhash.keep_one(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")).collect()
    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    root = brute_groups(range(len(rows)), fps)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[root[k]].append(i)
    assert len(groups) == 7
    place = {fp: root[k] for k, fp in enumerate(fps)}
    kept = [(place[simhash.fingerprint((r["text"] or "").encode())], r["doc_id"]) for r in got]
    assert sorted(kept) == sorted((g, min((i for i in ids if i is not None), default=None)) for g, ids in groups.items())


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = np.random.default_rng(3)
    fps = np.unique(np.array([sum(1 << int(b) for b in rng.choice(24, int(rng.integers(0, 9)), replace=False)) for _ in range(600)], np.uint64))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    roots = {r["u"]: r["root"] for r in simhash.components(simhash.links(df, len(fps))).collect()}
    want = brute_groups(list(fps.view(np.int64)), fps)
    assert all(roots.get(int(f), int(f)) == want[f] for f in want)


# ---- 7 BPE


def test_bpe_is_the_librarys(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, mine = Tokenizer.from_file(path), bpe.loaded(path)
    rng = random.Random(4)
    odd = ["", "<|endoftext|> a <|startoftext|>", "aaa aaaaa", "Σίσυφος ΣΑΣ İ", "don't WE'LL", "x\x1cy \x85 z", "é é", "a" * 3000, "!" * 99]
    odd += ["".join(rng.choice("abcdefghilmnorstuy") for _ in range(rng.randint(1, 16))) for _ in range(3000)]
    odd += ["".join(chr(rng.choice([rng.randint(33, 126), rng.randint(160, 900), rng.randint(0x3040, 0x30FF)])) for _ in range(20)) for _ in range(500)]
    for t in [*texts.values(), *odd]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids
        assert mine.run(t)[1] == mine.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_doubled_tokens_merge_from_the_left():
    vocab = {t: i for i, t in enumerate(["a", "b", "aa", "aaaa", "ab"])}
    a = bpe.Automaton(vocab, [("a", "a"), ("aa", "aa"), ("a", "b")])
    arcs = a.arcs("")
    label = lambda w: [a.label[i] for i in a.encode(w, arcs)]
    assert label("aaa") == ["aa", "a"] and label("aaaaa") == ["aaaa", "a"] and label("aab") == ["aa", "b"] and label("aaab") == ["aa", "ab"]


# ---- 5 packing


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 60), min_size=1, max_size=10))
def test_patterns_hold_every_piece_once(demand):
    plan = packing.patterns(demand, 16)
    got = Counter()
    for held, times in plan:
        assert sum(s * n for s, n in held.items()) <= 16
        for s, n in held.items():
            got[s] += n * times
    assert got == demand
    lower = max(-(-sum(s * n for s, n in demand.items()) // 16), sum(n for s, n in demand.items() if s > 8))
    assert sum(t for _, t in plan) <= 1.25 * lower + 3


def test_price_is_the_best_pattern():
    sizes, values = np.array([3, 5, 7]), np.array([0.31, 0.5, 0.72])
    best = max((a * 0.31 + b * 0.5 + c * 0.72) for a, b, c in itertools.product(range(5), repeat=3) if 3 * a + 5 * b + 7 * c <= 14)
    worth, counts = packing.price(values, sizes, 14)
    assert worth == pytest.approx(best) == pytest.approx(counts @ values)


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.paths()[0])
    rows = catalogue.QUERIES["op5_packing"](spark, SF).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert set(docs) == set(texts)
    for i, ps in docs.items():
        ids, at = np.array([*lib.encode(texts[i], add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(ps, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for ps in seqs.values():
        at = 0
        for r in sorted(ps, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.05 * sum(r["length"] for r in rows)


_TOKENIZERS = {}


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeiou 'stré\n\t  \r0129<|>")), max_size=80))
def test_packing_tokens_are_the_librarys(text):
    from tokenizers import Tokenizer

    if not _TOKENIZERS:
        _TOKENIZERS.update(lib=Tokenizer.from_file(packing.paths()[0]), mine=packing._encoder(*packing.paths()))
    for t in (text, text + "<|endoftext|>" + text):
        assert list(_TOKENIZERS["mine"](t)) == _TOKENIZERS["lib"].encode(t, add_special_tokens=False).ids


def test_packing_tokens_of_whole_documents(spark):
    from tokenizers import Tokenizer

    lib, mine = Tokenizer.from_file(packing.paths()[0]), packing._encoder(*packing.paths())
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert list(mine(r["text"])) == lib.encode(r["text"], add_special_tokens=False).ids


def test_sequences_are_what_the_pieces_say(spark):
    docs = spark.createDataFrame([(1, "a b c " * 900), (2, None), (3, "<|endoftext|>")], "doc_id long, text string")
    pieces = packing.pack_documents(docs)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, pieces).collect()}
    for p in pieces.collect():
        ids = whole[p["sequence_id"]][p["offset"] : p["offset"] + p["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == p["ids_crc32"]


# ---- 4 top-k


def brute_best(ids, v, q, me, k=5):
    return [(-a, b) for a, b in sorted((-int(s), int(i)) for s, i in zip(v @ q, ids) if i != me)[:k]]


def test_nra_matches_brute_force(monkeypatch):
    monkeypatch.setattr(topk, "SEGMENT", 1500)
    rng = np.random.default_rng(5)
    for n, dims in ((1, 3), (6, 1), (40, 4), (900, 9), (2500, 64), (4000, 3)):
        v = rng.integers(-4, 5, (n, dims))
        v[n // 2 :] = v[: n - n // 2]  # copies
        ids = rng.permutation(n)
        q = np.concatenate([v[:6], np.zeros((1, dims), np.int64)])
        own = np.concatenate([ids[:6], [-1]])
        for scale in (1, 1 << 24, 1 << 27):  # sums beyond single precision, and beyond double
            got, _ = topk.nra(ids, v * scale, q * scale, own, 5)
            assert got == [brute_best(ids, v * scale, x * scale, me) for x, me in zip(q, own)]


def test_reading_stops_early_on_skewed_lists():
    rng = np.random.default_rng(9)
    v = np.floor(rng.pareto(1.5, (9000, 6)) * 100).astype(np.int64)
    q, ids = np.abs(v[:20]) // 50 + 1, np.arange(9000)
    got, read = topk.nra(ids, v, q, ids[:20], 5)
    assert got == [brute_best(ids, v, x, i) for i, x in enumerate(q)]
    assert read < 0.4 * v.size * len(q)
    lists = topk.Lists(ids, v, 6)
    rows_of, alone = topk.contenders(lists, q, 5, np.full(20, -np.inf))  # bounds of its own reading only
    assert alone < 0.5 * v.size * len(q)
    for x, rows in zip(q, rows_of):
        assert len(rows) < 0.2 * len(lists.v) and {*np.sort(lists.v @ x)[::-1][:5]} <= {*(lists.v[rows] @ x)}


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [1.0, 1.0]), (50, [0.5, 0.5]), (6, [1.0, 1.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", 256)
    assert {r["vec_id"] for r in v.collect()} == {0, 5, 6, 50}
    out = topk.top_k(v.filter("vec_id = 0"), v, 2).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(5, 256 * 256 * 3), (6, 256 * 256 * 3)]


def test_every_length_has_its_ranks(spark):
    rng = np.random.default_rng(6)
    vs = {i: [int(x) for x in rng.integers(-4, 5, (2, 2, 3, 0)[i % 4])] for i in range(80)}
    v = spark.createDataFrame([(i, x) for i, x in vs.items()], "vec_id long, v array<long>")
    got = [tuple(r) for r in topk.top_k(v.filter("vec_id % 5 = 0"), v, 5).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 80, 5):
        best = sorted((-sum(a * b for a, b in zip(vs[q], x)), i) for i, x in vs.items() if i != q and len(x) == len(vs[q]))[:5]
        want += [(q, n + 1, i, -s if vs[q] else None) for n, (s, i) in enumerate(best)]
    assert got == want


# ---- 1, 2, 3 learned models


def held_out(spark, name, label):
    out = catalogue.QUERIES[name](spark, "/root/testdata/sf0.01")
    rows = out.filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    return np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])


@pytest.mark.parametrize("name, label", [("op1_quality_gam", "quality"), ("op2_toxicity_crf", "toxic")])
def test_held_out_labels(spark, name, label):
    s, y = held_out(spark, name, label)
    assert ((s >= 0) & (s <= 1)).all()
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.97


def test_gam_finds_an_interaction():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.train(x, y)
    assert (1, 0) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.9


def test_gam_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(10)
    x = np.round(rng.normal(size=(800, 4)), 1)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0.2).astype(float)
    model = gam.train(x, y)
    new = np.round(rng.normal(0, 2, (50, 4)), 1)
    for row, score in zip(new, model.score(new)):
        bins = [sum(edge <= v for edge in edges) for v, edges in zip(row, model.edges)]  # the edges that the value reaches
        z = model.intercept + sum(t[b] for t, b in zip(model.tables, bins))
        for (i, j), t in zip(model.pairs, model.pair_tables):
            z += t[model.coarse[i][bins[i]]][model.coarse[j][bins[j]]]
        assert score == pytest.approx(1 / (1 + np.exp(-z)))


def test_trees_take_the_best_splits():
    rng = np.random.default_rng(11)
    g, h = rng.normal(size=9), rng.uniform(0.1, 1, 9)
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    k = max(range(1, 9), key=lambda k: gain(0, k) + gain(k, 9))
    want = [g[:k].sum() / (h[:k].sum() + 1)] * k + [g[k:].sum() / (h[k:].sum() + 1)] * (9 - k)
    assert np.allclose(gam.grow(g, h, 2), want)
    gg, hh = rng.normal(size=(4, 4)), rng.uniform(0.1, 1, (4, 4))
    part = lambda gs, hs: gs.sum() ** 2 / (hs.sum() + 1)
    best = 0.0
    for a, b in ((gg, hh), (gg.T, hh.T)):
        for k in (1, 2, 3):
            both = sum(max(part(x[:, :m], y[:, :m]) + part(x[:, m:], y[:, m:]) for m in (1, 2, 3)) for x, y in ((a[:k], b[:k]), (a[k:], b[k:])))
            best = max(best, both - part(gg, hh))
    assert gam.grow_pair(gg, hh)[0] == pytest.approx(best)


def test_features_of_a_small_text():
    x = dict(zip(gam.NAMES, gam.features(b"The cat. The cat sat!\nThe cat.").tolist()))
    assert x["log_words"] == pytest.approx(np.log(8)) and x["distinct"] == pytest.approx(4 / 7) and x["commonest"] == pytest.approx(3 / 7)
    assert x["stops"] == pytest.approx(2 / 7) and x["bangs"] == pytest.approx(1 / 7) and x["line_words"] == pytest.approx(3.5)
    assert x["same_as_last"] == 0 and x["dup_lines"] == 0 and x["capitals"] == pytest.approx(1 / 4)
    assert not gam.features(None).any() and not gam.features(b" \n").any()


def test_gam_without_both_kinds():
    assert gam.train(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    e, lengths, move = rng.normal(0, 2, 12), np.array([5, 1, 6]), rng.normal(0, 1, (2, 2))
    got, at = toxicity.marginals(e, lengths, move), 0
    for n in lengths:
        z, total = np.zeros(n), 0.0
        for s in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[at + i] * s[i] for i in range(n)) + sum(move[s[i - 1], s[i]] for i in range(1, n)))
            total, z = total + w, z + w * np.array(s)
        assert np.allclose(z / total, got[at : at + n])
        at += n


def test_toxic_spans(spark):
    texts = [f"word{i % 7} other{i % 5} {'scumbag' if i % 3 == 0 else 'nice'}{i % 4} thing{i % 11} end" for i in range(300)]
    sample = spark.createDataFrame([(t, int(i % 3 == 0)) for i, t in enumerate(texts)], "text string, label int")
    keys = toxicity.evidence(sample)
    assert "5^scumb" in keys and "scumbag0" in keys and not keys & {"end", "word0", "4^nice", "4^thin"}
    field = toxicity.fit_sample(sample)
    text = "Other1 SCUMBAG2 thing3"
    p = next(toxicity.field_marginals(field, [toxicity.TOKEN.findall(text.lower())]))
    assert [text[a:b] for a, b in toxicity.spans(text, p)] == ["SCUMBAG2"]


def test_languages(spark):
    sf = "/root/testdata/sf0.01"
    out = catalogue.QUERIES["op3_language_cnn"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_evidence_counts_contexts_once(spark):
    """The likelihood ratio in plain Python; a copied document adds nothing."""
    rng = random.Random(3)
    rows = [(" ".join(rng.choice([*(f"w{i}" for i in range(40)), *["vile" if k % 2 else "nice"] * 9]) for _ in range(12)), k % 2) for k in range(120)] + [("rare words of one copied text", 1)] * 50
    places = {(y, w, a, b) for t, y in rows for ws in (["", *t.split(), ""],) for a, w, b in zip(ws, ws[1:], ws[2:])}
    n = [1 + sum(p[0] == y for p in places) for y in (0, 1)]
    want = set()
    for key in {k for _, w, _, _ in places for k in toxicity.keys_of(w)}:
        k0, k1 = (sum(p[0] == y and key in toxicity.keys_of(p[1]) for p in places) for y in (0, 1))
        share = (k0 + k1) / sum(n)
        gain = 2 * (k1 * np.log(k1 / n[1] / share) + (k0 * np.log(k0 / n[0] / share) if k0 else 0)) if k1 else 0
        if k1 >= 6 and k1 / n[1] >= 8 * (k0 + 0.5) / n[0] and gain > 40:
            want.add(key)
    assert toxicity.evidence(spark.createDataFrame(rows, "text string, label int")) == want and want >= {"vile", "4^vile"} and "rare" not in want


def test_chains_are_bounded():
    words = [f"w{i}" for i in range(500)]
    every = toxicity.cut_chains(words, True, lambda w: True, None)
    assert len(every) == toxicity.CHAINS and all(len(w) == toxicity.CHAIN_TOKENS and all(y) for w, y in every)
    (w, y), = toxicity.cut_chains(words, True, lambda w: w == "w100", None)
    assert w == words[94:107] and y == [0] * 6 + [1] + [0] * 6
    clean = toxicity.cut_chains(words, False, None, np.random.default_rng(0))
    assert [len(w) for w, _ in clean] == [24, 24] and not any(sum(y) for _, y in clean) and toxicity.cut_chains([], False, None, np.random.default_rng(0)) == []


def plain_probabilities(p, window):
    """The network as it is defined: embedded bytes, filters slid over them one place at a time, maxima, softmax."""
    e, pooled = p["e"][list(window)], []
    for w in langid.WIDTHS:
        slid = [e[a : a + w].reshape(-1) @ p[f"f{w}"] + p[f"b{w}"] for a in range(len(window) - w + 1)]
        pooled.append(np.maximum(np.max(slid, axis=0), 0))
    z = np.concatenate(pooled) @ p["w"] + p["o"]
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_tables_are_the_convolution():
    rng = np.random.default_rng(12)
    p = {"e": rng.normal(0, 1, (256, langid.EMBED)), "w": rng.normal(0, 1, (langid.FILTERS * 3, 3)), "o": rng.normal(0, 1, 3)}
    for w in langid.WIDTHS:
        p[f"f{w}"], p[f"b{w}"] = rng.normal(0, 1, (w * langid.EMBED, langid.FILTERS)), rng.normal(0, 1, langid.FILTERS)
    net = langid.compiled(p, ["a", "b", "c"])
    texts = ["Straße in DE".encode(), bytes(rng.integers(32, 127, 128, dtype=np.uint8)), bytes(rng.integers(32, 255, 300, dtype=np.uint8)) + b"A", None, b"", b"12 3"]
    langs, scores = net.predict(texts)
    for t, lang, score in zip(texts[:3], langs, scores):
        low = t.lower()
        mean = np.mean([plain_probabilities(p, low[a : a + 128].ljust(128, b"\0")) for a in range(0, len(low), 128)], axis=0)
        assert lang == "abc"[mean.argmax()] and score == pytest.approx(mean.max(), abs=1e-4)
    assert langs[3:] == ["und"] * 3 and not scores[3:].any()


def test_gradients_match_differences():
    rng = np.random.default_rng(13)
    p = {"e": rng.normal(0, 0.5, (256, langid.EMBED)), "w": rng.normal(0, 0.5, (langid.FILTERS * 3, 2)), "o": np.zeros(2)}
    for w in langid.WIDTHS:
        p[f"f{w}"], p[f"b{w}"] = rng.normal(0, 0.5, (w * langid.EMBED, langid.FILTERS)), np.zeros(langid.FILTERS)
    x, y = rng.integers(97, 123, (4, langid.WINDOW)), np.array([0, 1, 1, 0])
    grads = langid._gradients(p, x, y)
    loss = lambda: -np.mean([np.log(plain_probabilities(p, r)[c]) for r, c in zip(x, y)])
    for name, at in (("w", (3, 1)), ("o", (0,)), ("f2", (5, 2)), ("f4", (1, 7)), ("b3", (4,)), ("e", (int(x[0, 0]), 2))):
        was, h = p[name][at], 1e-5
        p[name][at] = was + h
        up = loss()
        p[name][at] = was - h
        down = loss()
        p[name][at] = was
        assert grads[name][at] == pytest.approx((up - down) / (2 * h), abs=1e-5)


def test_language_network_learns():
    rng = np.random.default_rng(7)
    texts = [bytes(rng.integers(97, 107 if i % 2 else 117, 200, dtype=np.uint8)) for i in range(60)]
    net = langid.train([w for t in texts for w in langid.windows_of(t)], ["xy"[i % 2] for i in range(60) for _ in range(langid.WINDOWS_PER_DOC)])
    langs, p = net.predict([*texts, None, b"", b"12 3", "é".encode()])
    assert np.mean([a == "xy"[i % 2] for i, a in enumerate(langs[:60])]) > 0.9
    assert langs[60:63] == ["und"] * 3 and langs[63] != "und" and ((p >= 0) & (p <= 1)).all()


# ---- what every operator must take


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, kept boolean, fp long, rank int"


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('odd')}"
    good = "the people of the town went to the market in the morning and bought bread milk and apples for all of their children then walked home again"
    texts = [None, "", " \n\t", "a", "é ß 🙂", good, good, "Same Same " * 4, "w" * 50_000, ("long text here " * 20_000)]
    rows = [(i, t, None if i % 3 == 0 else "en", None, None, 0.0, 1, True, 5, 2) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "nobody's text", "en", "s", 1, None, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (0, [1.0, 2.0]), (7, [3.0, 1.0]), (9, [])], "vec_id long, embedding array<float>").write.parquet(f"{root}/embeddings.parquet")
    spark.createDataFrame([(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 0, "assistant", "")], "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    spark.createDataFrame([(5, 1, 0), (5, 1, 0), (6, None, None), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


@pytest.fixture(scope="module")
def empty_dir(spark, odd_dir, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('empty')}"
    for t in ("documents", "embeddings", "conversations", "labels"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{root}/{t}.parquet")
    return root


def by_text(spark, root, rows):
    """Each row with its text; rows of id 5 share one text, and there is one row without an id."""
    text_of = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    return [(r, text_of[r["doc_id"]]) for r in rows]


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_odd_rows(spark, odd_dir, name):
    rows = catalogue.QUERIES[name](spark, odd_dir).collect()
    if name == "op4_exact_top_k":  # ids 0, 0 and 7 take part, and 9 of length zero; 0 asks, twice
        assert sorted(tuple(r) for r in rows) == [(0, 1, 7, 327680), (0, 2, 7, 327680)]
        return
    if name == "op9_chat_formatting":
        got = {r["conv_id"]: r for r in rows}
        assert set(got) == {-1, 1, 2} and got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 0 and got[2]["loss_chars"] == 0
        assert got[1]["turns_sha256"] == hashlib.sha256(b"\n\nuser\nx\nuser\nx\n").hexdigest()
        return
    if name == "op5_packing":
        assert {r["doc_id"] for r in rows} == {*range(10), None}
        assert all(r["doc_tokens"] == 1 for r in rows if r["doc_id"] in (0, 1))
        return
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted([(False, i) for i in [*range(10), 5]] + [(True, 0)])
    told = by_text(spark, odd_dir, rows)
    if name in ("op1_quality_gam", "op2_toxicity_crf", "op3_language_cnn"):
        parts, out = (4, 2) if name == "op3_language_cnn" else (5, 0)
        for r, t in told:
            assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % parts == out)
            assert 0 <= r["score"] <= 1
        assert len({r["score"] for r, t in told if not (t or "").strip()}) == 1  # null, empty and blank texts
        assert len({r["score"] for r, t in told if r["doc_id"] in (5, 6)}) == 1
    if name in ("op1_quality_gam", "op2_toxicity_crf"):
        bar = 0.3 if name == "op1_quality_gam" else 0.5
        assert all(r["predicted"] == int(r["score"] >= bar) for r, _ in told)
    elif name == "op3_language_cnn":
        assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) for r, t in told)
        assert all(r["lang_pred"] in ("und", "en") for r, _ in told)
    elif name == "op6_quality_rules":
        for r, t in told:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_measures(t)
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and (not r["kept"] or not r["base_failed"])
    elif name == "op7_bpe_automaton":
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        for r, t in told:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    elif name == "op8_simhash_dedup":
        assert all(r["fingerprint"] == f"{simhash.fingerprint((t or '').encode()):016x}" for r, t in told)
        assert {r["component_id"] for r, t in told if not (t or "").strip()} == {0} and {r["component_id"] for r, _ in told if r["doc_id"] in (5, 6)} == {5}
    elif name == "op10_sharding":
        assert all((r["size"], r["text_crc32"]) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for r, t in told)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    rows = catalogue.QUERIES[name](spark, empty_dir).collect()
    assert len(rows) == (1 if name == "op9_chat_formatting" else 0)


def test_written_tables_are_read_back_and_deleted(spark):
    df, other = common.written(spark.range(5), "t"), common.written(spark.range(3), "t")
    assert df.count() == 5
    common.dropped(spark, df)
    assert other.count() == 3 and len([m for m in common._MADE if m.rsplit("/", 1)[-1].startswith("t-")]) == 1
    common.clear(spark)
    assert not common._MADE


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = Conf

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_hot_rows_are_dealt(spark, monkeypatch):
    """Many rows of one id, and many copies of one text: slots stay gapless, groups whole."""
    monkeypatch.setattr(simhash, "LEAST_HOT", 5)
    rows = [(7 if i % 3 else i, f"text {i % 50} some more words here" if i % 2 else "copy of one text") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    slots = defaultdict(list)
    for r in sharding.shard_documents(docs, [1.0] * 8).collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 600
    got = simhash.group(docs).collect()
    want = brute_groups([i for i, _ in rows], [simhash.fingerprint(t.encode()) for _, t in rows])
    copies = simhash.fingerprint(b"copy of one text")
    assert len(got) == 600 and {r["component_id"] for r in got if r["fp"] == np.uint64(copies).astype(np.int64)} == {0}
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] != 7)
