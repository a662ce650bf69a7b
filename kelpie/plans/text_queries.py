"""Queries over texts: terms, needles, chunks, grounding, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions import figures, text
from kelpie.operators import chunking, grading, html

from .registry import query, table

_TOKENS = "list_transform(regexp_extract_all({c}, '[A-Za-z0-9]+'), lambda t: lower(t))"
_FIRST = "list_transform(list_filter(list_zip(ts, range(len(ts))), lambda p: list_position(ts, p[1]) = p[2] + 1), lambda p: p[1])"


@query(
    f"""WITH a AS (SELECT item_id, {_TOKENS.format(c='text')} AS ts FROM benchmark)
SELECT item_id, array_to_string(list_slice(list_filter({_FIRST}, lambda t: length(t) >= 2), 1, 24), ' | ') AS terms FROM a"""
)
def or_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.or_query(F.col("text")).alias("terms"))


@query(
    f"""WITH a AS (SELECT item_id, {_TOKENS.format(c='text')} AS ts FROM benchmark)
SELECT item_id, array_to_string(list_slice(list_filter({_FIRST}, lambda t: length(t) >= 4 AND NOT regexp_full_match(t, '[0-9]+')
  AND NOT list_contains([{', '.join(repr(w) for w in text.STOPWORDS)}], t)), 1, 24), ' ') AS terms FROM a"""
)
def reference_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(text.reference_terms(F.col("text")), " ").alias("terms"))


@query("SELECT doc_id FROM documents WHERE text ILIKE '%the%' AND text ILIKE '%token%'")
def ilike_needles(spark, sf):
    return table(spark, sf, "documents").filter(text.ilike_all(F.col("text"), ["the", "token"])).select("doc_id")


_CUES = " + ".join
_ITEM_ROWS = " UNION ALL ".join(
    f"SELECT item_id, {i} AS priority, '{item}' AS item, " + _CUES(f"contains(low, '{cue.replace(chr(39), chr(39) * 2)}')::INT" for cue in cues) + " AS hits FROM q" for i, (item, cues) in enumerate(text.ITEM_CUES)
)


@query(
    "WITH q AS (SELECT conv_id * 100 + turn AS item_id, lower(text) || CASE conv_id % 4 WHEN 0 THEN ' litigation risk' WHEN 1 THEN ' cash flow and hedging' WHEN 2 THEN ' employees' ELSE '' END AS low FROM conversations), "
    f"h AS ({_ITEM_ROWS}) SELECT item_id, string_agg(item, ',' ORDER BY hits DESC, priority) AS items FROM h WHERE hits > 0 GROUP BY 1"
)
def inferred_items(spark, sf):
    tail = F.when(F.col("conv_id") % 4 == 0, " litigation risk").when(F.col("conv_id") % 4 == 1, " cash flow and hedging").when(F.col("conv_id") % 4 == 2, " employees").otherwise("")
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), F.concat("text", tail).alias("text"))
    return rows.select("item_id", F.array_join(text.inferred_items(F.col("text")), ",").alias("items")).filter("items <> ''")


@query(
    r"""WITH a AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE))) AS xs FROM documents),
s AS (SELECT doc_id, xs, list_transform(range(0, 40), lambda i: (1000 + 37 * i)::DOUBLE) AS ys FROM a)
SELECT doc_id, len(list_filter(xs, lambda x: x >= 1000 AND NOT (x >= 1900 AND x <= 2100 AND x = floor(x)) AND len(list_filter(ys, lambda y:
  abs(y - x) <= greatest(1, abs(x) * 1e-6) OR abs(y * 1e3 - x) <= greatest(1, abs(x) * 1e-6) OR abs(y * 1e6 - x) <= greatest(1, abs(x) * 1e-6))) = 0))::INT AS unseen FROM s"""
)
def numeric_grounding(spark, sf):
    sources = F.lit(" ".join(str(1000 + 37 * i) for i in range(40)))
    return table(spark, sf, "documents").select("doc_id", F.size(text.ungrounded(F.col("text"), sources)).alias("unseen"))


@query(
    r"""WITH c AS (SELECT doc_id, i AS ordinal, trim(substr(text, i * 1792 + 1, 2048), E' \t\n\r\x0b\x0c') AS body
  FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 2048) / 1792.0))::BIGINT + 1))::INT AS i FROM documents WHERE length(text) > 0))
SELECT doc_id, ordinal, length(body)::INT AS chars, md5(body) AS digest FROM c WHERE body <> ''"""
)
def fixed_chunks(spark, sf):
    return chunking.fixed(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ordinal", F.length("body").alias("chars"), F.md5("body").alias("digest"))


@query(
    """SELECT lang AS strategy, count(*) AS n_chunks, count(*) FILTER (WHERE doc_id % 2 = 0) AS embedded, round(avg(greatest(1, length(text) // 4)))::INT AS avg_tokens,
  min(greatest(1, length(text) // 4))::INT AS min_tokens, max(greatest(1, length(text) // 4))::INT AS max_tokens FROM documents GROUP BY 1"""
)
def index_report(spark, sf):
    rows = table(spark, sf, "documents").select("lang", text.token_estimate(F.col("text")).alias("t"), F.when(F.col("doc_id") % 2 == 0, 1).alias("e"))
    return rows.groupBy(F.col("lang").alias("strategy")).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count("e").alias("embedded"), F.round(F.avg("t")).cast("int").alias("avg_tokens"), F.min("t").alias("min_tokens"), F.max("t").alias("max_tokens")
    )


@query(
    r"""SELECT doc_id, regexp_matches(text, '(?i)\b(?:no (?:information|data|figure|mention)|unable to (?:determine|answer))\b') AS abstains, length(trim(text)) BETWEEN 3 AND 2000 AS allowed FROM documents"""
)
def screens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.is_abstention(F.col("text")).alias("abstains"), text.screen(F.col("text"))["allowed"].alias("allowed"))


@query(
    """WITH v AS (SELECT o_orderkey, round(o_totalprice)::BIGINT AS v, (o_orderkey % 5 = 0) AS same FROM orders)
SELECT o_orderkey, (same OR abs(v // 1000 * 1000 - v) <= 0.005 * v) AS matches, year(o_orderdate)::INT - (month(o_orderdate) = 1 AND day(o_orderdate) <= 7)::INT AS fiscal_year
FROM v JOIN orders USING (o_orderkey)"""
)
def figure_matches(spark, sf):
    v = F.round("o_totalprice").cast("long")
    said = F.when(F.col("o_orderkey") % 5 == 0, v).otherwise(F.floor(v / 1000))
    return table(spark, sf, "orders").select(
        "o_orderkey", figures.values_match(said.cast("double"), v.cast("double")).alias("matches"), figures.fiscal_year_of(F.col("o_orderdate").cast("date"), F.lit(0)).alias("fiscal_year")
    )


@query()
def html_to_text(spark, sf):
    return html.with_text(table(spark, sf, "pages")).select("page_id", F.length("body").alias("chars"), F.md5("body").alias("digest"))


@query()
def sections(spark, sf):
    texts = html.with_text(table(spark, sf, "pages")).select("page_id", "body")
    return html.with_sections(texts).select("page_id", "ordinal", "item", "title", "char_len")


@query()
def recursive_chunks(spark, sf):
    return chunking.chunked(table(spark, sf, "documents").select("doc_id", "text"), "recursive").select("doc_id", "ordinal", "token_est", F.md5("body").alias("digest"))


@query()
def semantic_chunks(spark, sf):
    return chunking.chunked(table(spark, sf, "documents").select("doc_id", "text"), "semantic").select("doc_id", "ordinal", "token_est", F.md5("body").alias("digest"))


@query()
def section_chunks(spark, sf):
    parts = html.with_sections(html.with_text(table(spark, sf, "pages")).select("page_id", "body")).withColumn("id", F.col("page_id") * 100 + F.col("ordinal"))
    return chunking.chunked_sections(parts, "page_id").select("page_id", "ordinal", "section_id", F.length("body").alias("chars"))


@query()
def embed_hash(spark, sf):
    rows = chunking.embedded(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x) * 1000).cast("long").alias("norm"))


@query(
    """WITH o AS (SELECT o_orderkey, o_totalprice AS v, round_even(o_totalprice / 1000, 2) * 1000 AS said FROM orders),
g AS (SELECT *, o_orderkey % 7 <> 0 AND (abs(said - v) <= 0.005 * abs(v) OR abs(said * 1000 - v) <= 0.005 * abs(v) OR abs(said * 1000000 - v) <= 0.005 * abs(v)) AS ok FROM o)
SELECT o_orderkey, ok AS passed, ok::INT::DOUBLE AS score, CASE WHEN o_orderkey % 7 = 0 THEN 'abstained' WHEN ok THEN 'matches' ELSE 'differs' END AS rationale FROM g"""
)
def grade_numeric(spark, sf):
    o = table(spark, sf, "orders")
    answers = o.select(
        "o_orderkey", F.col("o_totalprice").alias("expected_value"), F.lit("USD").alias("unit"), F.lit(None).cast("string").alias("notes"),
        F.when(F.col("o_orderkey") % 7 == 0, "The filing does not state it").otherwise(F.concat(F.lit("In fiscal 1996 it was $"), F.format_number(F.col("o_totalprice") / 1000, 2), F.lit(" thousand"))).alias("answer"),
    )
    return grading.graded(answers).select("o_orderkey", "verdict.passed", "verdict.score", "verdict.rationale")
