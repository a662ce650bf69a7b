"""Queries over rankings. Benchmark items ask, documents and embeddings answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions.text import ITEM_CUES
from kelpie.operators import context, golden, probes
from kelpie.operators import retrieval as op

from .registry import query, table

#: Cosine in millionths, the same rounding as the engine's.
COS = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]) * 1000000)::BIGINT"
_TERMS = """terms AS (
  SELECT query_id, unnest(list_slice(list_filter(list_distinct_first, lambda t: length(t) >= 2), 1, 24)) AS term FROM (
    SELECT item_id AS query_id, list_transform(list_filter(list_zip(ts, range(len(ts))), lambda p: list_position(ts, p[1]) = p[2] + 1), lambda p: p[1]) AS list_distinct_first
    FROM (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: lower(t)) AS ts FROM benchmark)
  )
)"""
_LEX = (
    _TERMS
    + """, words AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: lower(t))) AS term FROM documents),
hits AS (SELECT query_id, doc_id AS id, count(*) AS score FROM words JOIN terms USING (term) GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM hits) WHERE rank <= 50)"""
)
_DENSE = f"""dense AS (SELECT * FROM (
  SELECT q.item_id AS query_id, e.vec_id AS id, {COS.format(a="e.embedding", b="v.embedding")} AS similarity,
    row_number() OVER (PARTITION BY q.item_id ORDER BY {COS.format(a="e.embedding", b="v.embedding")} DESC, e.vec_id)::INT AS rank
  FROM benchmark q JOIN embeddings v ON q.item_id = v.vec_id CROSS JOIN embeddings e) WHERE rank <= 50)"""
_FUSED = """fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR)::INT AS rank FROM (
  SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.id, l.id) AS id, d.rank AS rank_0, l.rank AS rank_1,
    0.0::DOUBLE + coalesce(1.0::DOUBLE / (60 + d.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0.0) AS score
  FROM dense d FULL JOIN lex l ON d.query_id = l.query_id AND d.id = l.id))"""
_REL = """rel AS (SELECT q.item_id AS query_id, e.vec_id AS id, 1.0::DOUBLE AS gain FROM benchmark q JOIN embeddings v ON q.item_id = v.vec_id JOIN embeddings e ON e.label = v.label AND v.label <> 0)"""

def _texts(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def _vectors(spark, sf):
    """The items' query vectors: the embedding of the same number."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return e.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")), "query_id")


def _lists(spark, sf, k=50):
    return op.dense_search(_vectors(spark, sf), table(spark, sf, "embeddings"), k), op.search_texts(_texts(spark, sf), table(spark, sf, "documents"), k)


@query(f"SELECT vec_id AS id, {COS.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 0)')} AS similarity FROM embeddings ORDER BY similarity DESC, id LIMIT 20")
def vec_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    return op.nearest(rows, rows.filter("vec_id = 0").first()["embedding"], 20)


@query("WITH " + _DENSE + " SELECT query_id, id, similarity, rank FROM dense")
def vec_topk_batch(spark, sf):
    return op.dense_search(_vectors(spark, sf), table(spark, sf, "embeddings"), 50)


@query("WITH " + _LEX + " SELECT query_id, id, score, rank FROM lex")
def lex_topk(spark, sf):
    return op.search_texts(_texts(spark, sf), table(spark, sf, "documents"), 50)


@query("SELECT term, count(*) AS n_docs, sum(tf)::BIGINT AS n FROM (SELECT doc_id, lower(t) AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS t FROM documents) GROUP BY 1, 2) GROUP BY 1")
def postings_terms(spark, sf):
    return op.postings(table(spark, sf, "documents")).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n"))


@query("WITH " + _DENSE + ", " + _LEX + ", " + _FUSED + " SELECT query_id, id, rank, rank_0, rank_1 FROM fused")
def rrf_fusion(spark, sf):
    return op.fuse(list(_lists(spark, sf))).select("query_id", "id", "rank", "rank_0", "rank_1")


@query("WITH " + _DENSE + ", " + _LEX + ", " + _FUSED + " SELECT query_id, id, rank, rank <= 8 AS included FROM fused")
def hybrid_search(spark, sf):
    dense, lexical = _lists(spark, sf)
    return op.hybrid(dense, lexical, 8).select("query_id", "id", "rank", "included")


_TAIL = "CASE item_id % 3 WHEN 0 THEN ' litigation risk' WHEN 1 THEN ' cash flow and hedging' ELSE ' employees' END"
_CUED = " UNION ALL ".join(
    f"SELECT query_id, {i} AS priority, '{item}' AS item, " + " + ".join(f"contains(low, '{cue.replace(chr(39), chr(39) * 2)}')::INT" for cue in cues) + " AS hits FROM cue_texts" for i, (item, cues) in enumerate(ITEM_CUES)
)
_ITEM_OF = ("3", "1A", "7A", "7", "1")


@query(
    "WITH " + _LEX + f""", cue_texts AS (SELECT item_id AS query_id, lower(text) || {_TAIL} AS low FROM benchmark), cued AS ({_CUED}),
want AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, priority) AS place FROM cued WHERE hits > 0),
items AS (SELECT doc_id AS id, ['{"', '".join(_ITEM_OF)}'][1 + doc_id % 5] AS item FROM documents)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY place, rank)::INT AS rank FROM lex JOIN items USING (id) JOIN want USING (query_id, item)"""
)
def item_boost(spark, sf):
    lexical = op.search_texts(_texts(spark, sf), table(spark, sf, "documents"), 50)
    q = F.col("query_id")
    tail = F.when(q % 3 == 0, " litigation risk").when(q % 3 == 1, " cash flow and hedging").otherwise(" employees")
    asked = _texts(spark, sf).withColumn("query_text", F.concat("query_text", tail))
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.get(F.array(*map(F.lit, _ITEM_OF)), (F.col("doc_id") % 5).cast("int")).alias("item"))
    return op.item_ranking(lexical, items, asked).select("query_id", "id", "rank")


@query("WITH " + _LEX + " SELECT query_id, id, score, rank FROM lex")
def lex_index(spark, sf):
    return op.lexical_search(_texts(spark, sf), op.postings(table(spark, sf, "documents")), 50)


@query()
def lex_english(spark, sf):
    return op.search_texts(_texts(spark, sf), table(spark, sf, "documents"), 50, english=True)


@query(
    "WITH " + _LEX + ", " + _REL + """, top AS (SELECT * FROM lex WHERE rank <= 8), b AS (SELECT query_id, id, rank, length(text)::BIGINT AS chars FROM top JOIN documents ON id = doc_id),
c AS (SELECT *, sum(chars) OVER (PARTITION BY query_id ORDER BY rank) <= 4000 AS shown FROM b), w AS (SELECT DISTINCT query_id, id FROM rel), m AS (SELECT c.*, w.id IS NOT NULL AS wanted FROM c LEFT JOIN w USING (query_id, id)),
u AS (SELECT *, sum(CASE WHEN shown THEN chars ELSE 0 END) OVER (PARTITION BY query_id) AS used FROM m),
s AS (SELECT query_id, count(*) FILTER (WHERE shown) AS n_included, count(*) FILTER (WHERE NOT shown) AS n_dropped, max(used)::BIGINT AS chars_after, count(*) FILTER (WHERE shown AND wanted) AS in_prompt,
  count(*) FILTER (WHERE NOT shown AND wanted) AS lost_to_cap, coalesce(bool_or(NOT shown AND used + chars <= 4000), false) AS would_fit FROM u GROUP BY 1),
p AS (SELECT query_id, count(*) AS pre FROM lex JOIN w USING (query_id, id) GROUP BY 1), f AS (SELECT query_id, count(*) AS final FROM top JOIN w USING (query_id, id) GROUP BY 1), n AS (SELECT query_id, count(*) AS n FROM w GROUP BY 1)
SELECT item_id AS query_id, coalesce(n_included, 0) AS n_included, coalesce(n_dropped, 0) AS n_dropped, coalesce(chars_after, 0) AS chars_after, coalesce(in_prompt, 0) AS in_prompt, coalesce(lost_to_cap, 0) AS lost_to_cap, coalesce(would_fit, false) AS would_fit,
  CASE WHEN n IS NULL THEN 'unlabelled' WHEN pre IS NULL THEN 'search' WHEN final IS NULL THEN 'truncation' WHEN coalesce(in_prompt, 0) = 0 THEN 'cap' ELSE 'prompt' END AS lost_at
FROM benchmark LEFT JOIN s ON item_id = s.query_id LEFT JOIN p ON item_id = p.query_id LEFT JOIN f ON item_id = f.query_id LEFT JOIN n ON item_id = n.query_id"""
)
def context_probe(spark, sf):
    lexical = op.search_texts(_texts(spark, sf), table(spark, sf, "documents"), 50)
    candidates = op.hybrid(None, lexical, 8, mode="lexical")
    chars = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("chars"))
    out = context.stage_of_loss(context.probed(candidates, chars, _relevant(spark, sf), _texts(spark, sf), 4000))
    return out.select("query_id", "n_included", "n_dropped", "chars_after", F.col("relevant_in_prompt").alias("in_prompt"), "lost_to_cap", F.col("would_fit_with_skip").alias("would_fit"), "lost_at")


@query(
    "WITH " + _LEX + """, p AS (SELECT query_id, len(regexp_extract_all(b.text, '[^ ]+')) AS q, len(regexp_extract_all(d.text, '[^ ]+')) AS n FROM lex JOIN benchmark b ON item_id = query_id JOIN documents d ON id = doc_id),
a AS (SELECT query_id, max(q) AS query_tokens, count(*) AS passages, count(*) FILTER (WHERE n > 512 - 3 - q) AS truncated, max(n) AS most_tokens, list_sort(list(n)) AS xs FROM p GROUP BY 1)
SELECT query_id, query_tokens, passages, truncated, most_tokens, xs[len(xs) // 2 + 1] AS median_tokens FROM a"""
)
def truncation_audit(spark, sf):
    lexical = op.search_texts(_texts(spark, sf), table(spark, sf, "documents"), 50)
    pairs = lexical.join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id").join(_texts(spark, sf), "query_id")
    out = context.truncation_audit(pairs, lambda texts: [sum(1 for t in x.split(" ") if t) for x in texts])
    return out.select("query_id", "query_tokens", "passages", "truncated", "most_tokens", "median_tokens")


@query("SELECT count(*) AS labels, count(v.vec_id) AS labels_in_index, count(DISTINCT case_id) AS cases, count(*) - count(v.vec_id) AS stale_labels FROM (SELECT DISTINCT item_id % 5 AS case_id, item_id * 7 AS id FROM benchmark) l LEFT JOIN embeddings v ON l.id = v.vec_id")
def stale_labels(spark, sf):
    labels = table(spark, sf, "benchmark").select((F.col("item_id") % 5).alias("case_id"), (F.col("item_id") * 7).alias("id"))
    return context.label_check(labels, table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))


@query(
    "WITH " + _DENSE + ", " + _LEX + ", " + _REL + """, a AS (SELECT query_id, list(id ORDER BY rank) AS ids FROM dense WHERE rank <= 8 GROUP BY 1), b AS (SELECT query_id, list(id ORDER BY rank) AS ids FROM lex WHERE rank <= 8 GROUP BY 1), w AS (SELECT query_id, list(DISTINCT id) AS ids FROM rel GROUP BY 1),
j AS (SELECT query_id, a.ids AS was, b.ids AS now, w.ids AS wanted FROM a FULL JOIN b USING (query_id) LEFT JOIN w USING (query_id))
SELECT count(*) AS questions, count(*) FILTER (WHERE was IS DISTINCT FROM now) AS changed, round(avg(list_has_any(coalesce(was, [])[:5], wanted)::INT) * 1000000)::BIGINT AS before_ppm, round(avg(list_has_any(coalesce(now, [])[:5], wanted)::INT) * 1000000)::BIGINT AS after_ppm FROM j"""
)
def retrieval_check(spark, sf):
    dense, lexical = (x.filter("rank <= 8") for x in _lists(spark, sf))
    out = golden.retrieval_check(dense, lexical, _relevant(spark, sf))
    ppm = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    return out.select("questions", "changed", ppm("hit_before").alias("before_ppm"), ppm("hit_after").alias("after_ppm"))


@query(
    "WITH " + _LEX + """, o AS (
  SELECT query_id, id, rank, len(list_intersect(list_distinct(list_transform(regexp_extract_all(b.text, '[A-Za-z0-9]+'), lambda t: lower(t))),
      list_distinct(list_transform(regexp_extract_all(d.text, '[A-Za-z0-9]+'), lambda t: lower(t)))))::DOUBLE
    / len(list_distinct(list_transform(regexp_extract_all(b.text, '[A-Za-z0-9]+'), lambda t: lower(t)))) AS overlap
  FROM lex JOIN benchmark b ON query_id = item_id JOIN documents d ON id = doc_id
) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank)::INT AS new_rank FROM o"""
)
def overlap_rerank(spark, sf):
    lexical = op.search_texts(_texts(spark, sf), table(spark, sf, "documents"), 50, overlap=True)
    return op.overlap_rerank(lexical).select("query_id", "id", "new_rank")


@query(
    "WITH " + _LEX + """, p AS (SELECT query_id, rank, length(text)::BIGINT AS chars FROM lex JOIN documents ON id = doc_id)
SELECT query_id, rank, chars, cum_chars, cum_chars <= 20000 AS included FROM (SELECT *, sum(chars) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS cum_chars FROM p)"""
)
def context_pack_greedy(spark, sf):
    _, lexical = _lists(spark, sf)
    blocks = lexical.join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("chars")), "id")
    return op.pack_greedy(blocks.select("query_id", "rank", "chars"), 20_000)


@query(
    "WITH RECURSIVE " + _LEX + """, p AS (SELECT query_id, rank, length(text)::BIGINT AS chars FROM lex JOIN documents ON id = doc_id),
f AS (
  SELECT query_id, rank, chars, chars <= 20000 AS included, CASE WHEN chars <= 20000 THEN chars ELSE 0 END AS used FROM p WHERE rank = 1
  UNION ALL SELECT p.query_id, p.rank, p.chars, f.used + p.chars <= 20000, f.used + CASE WHEN f.used + p.chars <= 20000 THEN p.chars ELSE 0 END
  FROM f JOIN p ON p.query_id = f.query_id AND p.rank = f.rank + 1
) SELECT query_id, rank, chars, included FROM f"""
)
def context_pack_skip(spark, sf):
    _, lexical = _lists(spark, sf)
    blocks = lexical.join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("chars")), "id")
    return op.pack_skipping(blocks.select("query_id", "rank", "chars"), 20_000)


def _relevant(spark, sf):
    e = table(spark, sf, "embeddings")
    asked = e.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").filter("label <> 0").select(F.col("vec_id").alias("query_id"), "label")
    return e.select(F.col("vec_id").alias("id"), "label").join(asked, "label").select("query_id", "id", F.lit(1.0).alias("gain"))


@query(
    "WITH " + _DENSE + ", " + _REL + """, h AS (SELECT d.query_id, d.rank, r.gain FROM dense d LEFT JOIN rel r USING (query_id, id)),
m AS (SELECT query_id, min(rank) FILTER (WHERE gain IS NOT NULL) AS first, count(*) FILTER (WHERE gain IS NOT NULL AND rank <= 5) AS h5,
  count(*) FILTER (WHERE gain IS NOT NULL AND rank <= 10) AS h10, coalesce(sum(gain / log2(rank + 1)) FILTER (WHERE rank <= 10), 0) AS dcg FROM h GROUP BY 1),
n AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1),
i AS (SELECT query_id, sum(1.0::DOUBLE / log2(k + 1)) AS ideal FROM (SELECT query_id, unnest(range(1, least(10, n_rel) + 1)) AS k FROM n) GROUP BY 1)
SELECT item_id AS query_id, round(coalesce(1.0::DOUBLE / first, 0) * 1000000)::BIGINT AS rr, coalesce(h5 > 0, false)::INT AS hit_5, round(coalesce(h10::DOUBLE / n_rel, 0) * 1000000)::BIGINT AS recall_10,
  round(coalesce(h5::DOUBLE / 5, 0) * 1000000)::BIGINT AS precision_5, round(coalesce(dcg / ideal, 0) * 1000000)::BIGINT AS ndcg_10
FROM benchmark LEFT JOIN m ON item_id = m.query_id LEFT JOIN n ON item_id = n.query_id LEFT JOIN i ON item_id = i.query_id"""
)
def ir_metrics(spark, sf):
    dense = op.dense_search(_vectors(spark, sf), table(spark, sf, "embeddings"), 50)
    out = op.ir_metrics(dense, _relevant(spark, sf), _texts(spark, sf))
    ppm = lambda c: F.round(F.col(f"`{c}`") * 1_000_000).cast("long")
    return out.select("query_id", ppm("rr").alias("rr"), F.col("`hit@5`").cast("int").alias("hit_5"), ppm("recall@10").alias("recall_10"), ppm("precision@5").alias("precision_5"), ppm("ndcg@10").alias("ndcg_10"))


@query(
    "WITH " + _DENSE + ", " + _REL + """, f AS (SELECT d.query_id, min(d.rank) AS first FROM dense d JOIN rel USING (query_id, id) GROUP BY 1)
SELECT round(coalesce(avg(coalesce(1.0::DOUBLE / first, 0)), 0) * 1000000)::BIGINT AS mrr, count(*) AS n FROM benchmark LEFT JOIN f ON item_id = query_id"""
)
def mean_reciprocal_rank(spark, sf):
    dense = op.dense_search(_vectors(spark, sf), table(spark, sf, "embeddings"), 50)
    out = op.ir_metrics(dense, _relevant(spark, sf), _texts(spark, sf), (5,))
    return out.agg(F.round(F.coalesce(F.avg("rr"), F.lit(0.0)) * 1_000_000).cast("long").alias("mrr"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT kind, metric, round(avg(value) * 1000000)::BIGINT AS mean_ppm, count(value) AS n_cases FROM (
  SELECT event_type AS kind, 'value' AS metric, value FROM events WHERE value IS NOT NULL
  UNION ALL SELECT event_type, 'k', (props->>'$.k')::DOUBLE FROM events WHERE user_id % 3 <> 0 AND (props->>'$.k') IS NOT NULL) GROUP BY 1, 2"""
)
def metric_macro_avg(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    both = F.map_filter(F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.when(F.col("user_id") % 3 != 0, k)), lambda _, v: v.isNotNull())
    out = op.macro_average(table(spark, sf, "events").select(F.col("event_type").alias("kind"), both.alias("metrics")), ["kind"])
    return out.select("kind", "metric", F.round(F.col("mean") * 1_000_000).cast("long").alias("mean_ppm"), "n_cases")


@query("SELECT count(DISTINCT l.doc_id) AS labelled, count(DISTINCT d.doc_id) AS found FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d USING (doc_id)")
def evidence_labels(spark, sf):
    ids = table(spark, sf, "labels").select("doc_id").distinct()
    held = table(spark, sf, "documents").filter("lang = 'en'").select("doc_id", F.lit(1).alias("held")).distinct()
    return ids.join(held, "doc_id", "left").agg(F.count(F.lit(1)).alias("labelled"), F.count("held").alias("found"))


_WIDE = {"dense": _DENSE.replace("rank <= 50", "rank <= 80"), "lex": _LEX.replace("rank <= 50", "rank <= 80")}
_CUT = ", ".join(f"{name}_{k} AS (SELECT * FROM {name} WHERE rank <= {k})" for name in ("dense", "lex") for k in (20, 80))
_FUSED_AT = lambda k: _FUSED.replace("fused AS", f"fused_{k} AS").replace("FROM dense d FULL JOIN lex l", f"FROM dense_{k} d FULL JOIN lex_{k} l")
_TOKEN_SET = "list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda t: lower(t)))"
_RERANKED = f"""reranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect({_TOKEN_SET.format("b.text")}, {_TOKEN_SET.format("d.text")}))::DOUBLE / len({_TOKEN_SET.format("b.text")}) DESC, f.rank) AS rank
  FROM fused_20 f JOIN benchmark b ON query_id = item_id JOIN documents d ON id = doc_id)"""


def _sweep_part(s: probes.Setting) -> str:
    source = "reranked" if s.rerank else {"dense": "dense", "lexical": "lex", "hybrid": "fused"}[s.mode] + f"_{s.k}"
    return f"""SELECT '{s.name}' AS config, '{s.mode}' AS mode, {s.top_n} AS top_n, count(*) AS n_cases, round(avg(coalesce(1.0::DOUBLE / f, 0)) * 1000000)::BIGINT AS mrr_ppm, round(avg((coalesce(f, 999) <= 5)::INT) * 1000000)::BIGINT AS hit_5_ppm
FROM (SELECT a.query_id, min(rank) AS f FROM (SELECT DISTINCT query_id FROM rel) a LEFT JOIN (SELECT s.query_id, s.rank FROM {source} s JOIN rel USING (query_id, id) WHERE s.rank <= {s.top_n}) h ON a.query_id = h.query_id GROUP BY 1)"""


_SETTINGS = probes.settings(20, 8)


@query(f"WITH {_WIDE['dense']}, {_WIDE['lex']}, {_CUT}, {_FUSED_AT(20)}, {_FUSED_AT(80)}, {_RERANKED}, {_REL} " + " UNION ALL ".join(map(_sweep_part, _SETTINGS)))
def retrieval_sweep(spark, sf):
    dense, lexical = _lists(spark, sf, 80)
    candidates = dense.filter("rank <= 20").select("query_id", "id").union(lexical.filter("rank <= 20").select("query_id", "id")).distinct()
    overlaps = op.overlaps(candidates, _texts(spark, sf), table(spark, sf, "documents"))
    out = probes.sweep(dense, lexical, _relevant(spark, sf), _texts(spark, sf), _SETTINGS, overlaps, (5,))
    return out.select("config", "mode", "top_n", "n_cases", F.round(F.col("rr") * 1_000_000).cast("long").alias("mrr_ppm"), F.round(F.col("`hit@5`") * 1_000_000).cast("long").alias("hit_5_ppm"))


@query(
    r"""SELECT doc_id, (regexp_matches(text, '(?i)token')::INT + regexp_matches(text, '(?i)\bare\b')::INT + regexp_matches(text, '(?i)de la')::INT) AS n_facts,
  CASE WHEN n_facts >= 2 THEN 'primary' WHEN n_facts = 1 THEN 'supporting' ELSE 'weak' END AS support FROM documents"""
)
def probe_links(spark, sf):
    found = probes.classified(table(spark, sf, "documents"), probes.parse_spec(r"token; are=\bare\b; de la"), "text")
    return found.select("doc_id", "n_facts", "support")
