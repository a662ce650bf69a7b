"""The pipeline, stage by stage, on the smallest tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from kelpie.llm import gam, packing, quality_rules, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, was = docs.columns, {r["doc_id"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == was
            break
        assert out.columns == columns
        out.write.parquet(f"file://{tmp_path}/{i}")
        kept = spark.read.parquet(f"file://{tmp_path}/{i}")
        now = {r["doc_id"] for r in kept.collect()}
        assert now <= was and (i or now < was) and kept.count() == len(now)
        if name == "quality_rules":
            assert now == {r["doc_id"] for r in quality_rules.judge(docs, list(quality_rules.RULES)).filter("kept").collect()}
        elif name == "quality_classifier":
            assert all(labels.get(d, 0) == 0 for d in was - now if d in labels)
        else:
            groups = {r["doc_id"]: r["component_id"] for r in simhash.group(docs).collect()}
            assert now == set(groups.values())
        docs, was = kept, now


def test_run(spark):
    assert pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def plain_keep(rows, labels):
    """The first three stages in plain Python: indexes of the rows that stay after each."""
    ruled = [k for k, (_, t) in enumerate(rows) if not rejected(t)]
    known = {i: max(y for j, y in labels if j == i) for i, y in labels if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5}
    texts = {i: min(rows[k][1] for k in ruled if rows[k][0] == i) for i in known if any(rows[k][0] == i for k in ruled)}
    ids = sorted(texts)
    x = np.array([gam.features(texts[i].encode()) for i in ids], np.float32).astype(float).reshape(-1, len(gam.NAMES))
    model = gam.train(x, np.array([float(known[i] > 0) for i in ids]))
    score = lambda t: model.score(gam.features(t.encode()).astype(float)[None])[0]
    good = [k for k in ruled if score(rows[k][1]) >= 0.3]
    fps = {k: simhash.fingerprint(rows[k][1].encode()) for k in good}
    groups = []
    for k in good:
        near = [g for g in groups if any((fps[k] ^ fps[j]).bit_count() <= 3 for j in g)]
        groups = [g for g in groups if g not in near] + [[k, *(j for g in near for j in g)]]
    return ruled, good, groups


def rejected(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = Counter(zip(ws, ws[1:], ws[2:]))
    again = {i + d for i, w in enumerate(zip(ws, ws[1:], ws[2:])) if wins[w] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup, chars, n = len(lines) - len(set(lines)), sum(map(len, ws)), len(ws)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return n < 50 or 100 * len(again) > 50 * n or not 2 * n <= chars <= 14 * n or 10 * symbols > n or (dup >= 3 and 10 * dup > 3 * len(lines))


def test_run_matches_a_plain_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    long = next(t for _, t in rows if not rejected(t))
    rows += [(None, long), (None, long.upper()), (3, long + " and one more sentence at its end"), (None, None), (900, ""), rows[0], rows[0]]
    spark.createDataFrame([(i, t, "en", None, 0, 5, 2) for i, t in rows], DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    ruled, good, groups = plain_keep(rows, labels)
    assert len(rows) > len(ruled) >= len(good) > len(groups) > 0
    pieces = pipeline.run(spark, f"file://{tmp_path}").collect()
    want = sorted(min((rows[k][0] for k in g if rows[k][0] is not None), default=-1) for g in groups)
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in pieces if r["start"] == 0) == want
    lib = Tokenizer.from_file(packing.paths()[0])
    ids = {k: np.array([*lib.encode(rows[k][1], add_special_tokens=False).ids, 0], "<u4") for g in groups for k in g}
    for r in pieces:  # the piece is one of a document of its id that is in some group
        assert any(rows[k][0] == r["doc_id"] and len(v) == r["doc_tokens"] and zlib.crc32(v[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for k, v in ids.items())
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, rank int"
GOOD = "the people of the town went to the market in the morning and bought bread milk and apples for all of their children then walked home again"
TEXTS = [None, "", " \n\t", "a", "é ß 🙂", GOOD, GOOD, "Same Same " * 4, "w" * 50_000, "long text here " * 20_000]
OTHERS = [" ".join(f"w{i}{c}" for c in "abcdefghijklmnop") for i in range(3)]
#: Null ids over unrelated texts, one of them a copy; one id with two texts; a repeated row.
ROWS = [*enumerate(TEXTS), (5, GOOD), (5, OTHERS[0]), (None, GOOD), (None, OTHERS[0]), (None, OTHERS[1]), (None, OTHERS[2]), (None, OTHERS[2].upper())]


@pytest.fixture(scope="module")
def odd_dirs(spark, tmp_path_factory):
    roots = [f"file://{tmp_path_factory.mktemp('pipeline')}" for _ in range(2)]
    docs = spark.createDataFrame([(i, t, "en", None, 0, 5, 2) for i, t in ROWS], DOCS)
    labels = spark.createDataFrame([(5, 1, 0), (6, None, None), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for root, n in zip(roots, (1000, 0)):
        docs.limit(n).write.parquet(f"{root}/documents.parquet")
        labels.limit(n).write.parquet(f"{root}/labels.parquet")
    return roots


def one_a_group(rows):
    """(text's fingerprint, least id) of each group of rows, by comparing all."""
    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    groups = []
    for k, fp in enumerate(fps):
        near = [g for g in groups if any((fp ^ fps[j]).bit_count() <= 3 for j in g)]
        groups = [g for g in groups if g not in near] + [[k, *(j for g in near for j in g)]]
    ids = [[rows[j][0] for j in g] for g in groups]
    return sorted(min((i for i in g if i is not None), default=-1) for g in ids), [{fps[j] for j in g} for g in groups]


@pytest.mark.parametrize("at", range(4))
def test_stages_take_odd_and_empty_tables(spark, odd_dirs, at):
    odd, empty = odd_dirs
    name, stage = pipeline.STAGES[at]
    none = stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty)
    got = stage(spark, spark.read.parquet(f"{odd}/documents.parquet"), odd)
    assert none.columns == got.columns and none.count() == 0
    rows = got.collect()
    if name == "packing":
        assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows if r["start"] == 0) == sorted(-1 if i is None else i for i, _ in ROWS)
    elif name == "near_duplicates":
        ids, groups = one_a_group(ROWS)
        assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows) == ids
        kept = [simhash.fingerprint((r["text"] or "").encode()) for r in rows]
        assert all(sum(fp in g for fp in kept) == 1 for g in groups)
    else:
        assert {(r["doc_id"], r["text"]) for r in rows} <= set(ROWS)
