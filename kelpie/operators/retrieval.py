"""Ranking: exact vector search, lexical search, fusion, reranking, context packing, retrieval metrics.

Searches read the corpus once for each MOST_QUERIES queries: the queries go to every task, which scores its rows in blocks
with matrix products and keeps the k best of each query, so what is shuffled is k rows a query and task, whatever the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from kelpie.functions.text import inferred_items, or_terms, tokens

#: Queries of one pass over the corpus; all of them travel to every task, so their number is bounded.
MOST_QUERIES = 4096
#: Rows and queries of one matrix product.
ROWS, COLUMNS = 2048, 256


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def small(queries: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """The queries, marked for broadcast if they are known to be few; otherwise the join is left to Spark."""
    return F.broadcast(queries) if len(queries.limit(most + 1).select(F.lit(1)).collect()) <= most else queries


def in_batches(queries: DataFrame, search: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """search of the queries, in passes of about ``most`` queries each."""
    most = MOST_QUERIES if most is None else most
    passes = max(1, -(-queries.count() // most))
    if passes == 1:
        return search(queries)
    part = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    return reduce(DataFrame.unionByName, [search(queries.filter(part == i)) for i in range(passes)])


class Best:
    """The k best (score, id) of each query while rows pass by: higher scores first, then smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * queries

    def add(self, at: int, ids: np.ndarray, scores: np.ndarray, extra: np.ndarray | None = None, least: int | None = None) -> None:
        """Rows' scores for the queries from ``at`` on: (query, row). Scores below ``least`` don't count."""
        for j, mine in enumerate(scores, at):
            held = self.held[j]
            full = held is not None and len(held[0]) == self.k
            floor = max(x for x in (least, int(held[0][-1]) if full else None, np.iinfo(np.int64).min) if x is not None)
            rows = np.flatnonzero(mine >= floor)
            if len(rows) > self.k:
                rows = rows[mine[rows] >= np.partition(mine[rows], len(rows) - self.k)[len(rows) - self.k]]
            if not len(rows):
                continue
            new = (mine[rows], ids[rows], np.zeros(len(rows)) if extra is None else extra[j - at, rows])
            score, name, more = new if held is None else (np.concatenate(x) for x in zip(held, new))
            order = np.lexsort((name, -score))[: self.k]
            self.held[j] = (score[order], name[order], more[order])

    def batch(self, query_ids: pa.Array, id_type: pa.DataType) -> pa.RecordBatch:
        found = [(j, *h) for j, h in enumerate(self.held) if h is not None]
        owner = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
        whole = lambda i, empty: np.concatenate([f[i] for f in found]) if found else empty
        ids = pa.array(whole(2, np.zeros(0, np.int64)).tolist(), id_type)
        return pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(owner)), ids, pa.array(whole(1, np.zeros(0, np.int64)).astype(np.int64)), pa.array(whole(3, np.zeros(0)).astype(float))], ["query_id", "id", "score", "extra"]
        )


Scorer = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]]


def _ids(column: pa.Array) -> np.ndarray:
    ids = column.to_numpy(zero_copy_only=False)
    return ids.astype(str) if ids.dtype == object else ids


def best_of(rows: DataFrame, query_ids: pa.Array, query_type, make: Callable[[], Scorer], k: int, least: int | None = None) -> DataFrame:
    """query_id, id, score and extra of each task's k best rows (id, payload) of every query.

    ``make`` gives, in the task, a function from a batch to (first query, ids, scores, extra) of its blocks.
    """

    def run(batches):
        score, best, id_type = make(), Best(len(query_ids), k), None
        for batch in batches:
            id_type = batch.column(0).type
            for at, ids, scores, extra in score(batch):
                best.add(at, ids, scores, extra, least)
        if id_type is not None:
            yield best.batch(query_ids, id_type)

    schema = StructType([StructField("query_id", query_type), StructField("id", rows.schema["id"].dataType), StructField("score", LongType()), StructField("extra", DoubleType())])
    return rows.mapInArrow(run, schema)


def top(ranked: DataFrame, k: int, query: str, *order: Column) -> DataFrame:
    """The k best rows of each query with their rank; Spark cuts to k before it shuffles."""
    w = Window.partitionBy(query).orderBy(*order)
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """query_id, id, similarity (millionths, so that ties are ties in any engine) and rank of the k nearest. queries: query_id, query_vector.

    A query meets the vectors of its own length; null vectors and vectors with a null or non-finite component take no part,
    and a vector of norm 0 has similarity 0.
    """
    rows = vectors.filter(F.col(vec_col).isNotNull()) if where is None else vectors.filter(F.col(vec_col).isNotNull() & where)
    rows = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))

    def search(some: DataFrame) -> DataFrame:
        asked = some.select("query_id", F.transform("query_vector", lambda x: x.cast("double")).alias("q")).filter(F.col("q").isNotNull()).toArrow()
        wanted = [np.array(q, float) for q in asked.column("q").to_pylist()]
        order = sorted(range(len(wanted)), key=lambda i: len(wanted[i]))  # queries of one length side by side
        wanted = [wanted[i] for i in order]
        return best_of(rows, asked.column("query_id").combine_chunks().take(pa.array(order, pa.int64())), queries.schema["query_id"].dataType, lambda: _cosines(wanted), k)

    found = in_batches(queries, search).withColumnRenamed("score", "similarity").drop("extra")
    return top(found, k, "query_id", F.desc("similarity"), F.col("id"))


def _unit(v: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norms, out=np.zeros_like(v), where=norms > 0)


def _cosines(wanted: list[np.ndarray]) -> Scorer:
    """Cosines in millionths with the queries, which are in order of their lengths."""
    lengths = np.array([len(q) for q in wanted], np.int64)
    blocks = []  # (first query, unit vectors)
    for width in np.unique(lengths):
        first, past = np.searchsorted(lengths, [width, width + 1])
        blocks += [(at, _unit(np.stack(wanted[at : min(past, at + COLUMNS)]))) for at in range(first, past, COLUMNS)]

    def score(batch):
        ids, column = _ids(batch.column(0)), batch.column(1)
        sizes = np.asarray(column.value_lengths())
        values, ends = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(sizes)
        for width in {q.shape[1] for _, q in blocks}:
            mine = np.flatnonzero(sizes == width)
            for a in range(0, len(mine), ROWS):
                some = mine[a : a + ROWS]
                v = values[(ends[some] - width)[:, None] + np.arange(width)]
                fine = np.isfinite(v).all(axis=1)
                v, some = _unit(v[fine]), some[fine]
                for at, q in blocks:
                    if q.shape[1] == width and len(some):
                        cos = q @ v.T
                        yield at, ids[some], (np.sign(cos) * np.floor(np.abs(cos) * 1e6 + 0.5)).astype(np.int64), None

    return score


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows to one literal vector: no shuffle, each task keeps its k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.round(cosine(F.col(vec_col), q) * 1_000_000).cast("long").alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """term, id and tf of every document: the text index, to be written sorted by term."""
    term = F.explode(tokens(F.col(text_col)))
    rows = docs.select(F.col(id_col).alias("id"), term.alias("term"))
    rows = rows if stem is None else rows.withColumn("term", stem(F.col("term")))
    return rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def lexical_search(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """query_id, id, score and rank by the sum of term frequencies of the query's distinct terms. queries: query_id, query_text.

    index: postings, best written sorted by term, so that a scan skips what no query asks for.
    """

    def search(some: DataFrame) -> DataFrame:
        terms = some.select("query_id", F.explode(or_terms(F.col("query_text"))).alias("term"))
        return index.join(F.broadcast(terms), "term").groupBy("query_id", "id").agg(F.sum("tf").alias("score"))

    return top(in_batches(queries, search), k, "query_id", F.desc("score"), F.col("id"))


def search_texts(queries: DataFrame, docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", overlap: bool = False, english: bool = False) -> DataFrame:
    """lexical_search without an index, in one pass over the texts. queries: query_id, query_text.

    With ``overlap`` hits have the share of the question's distinct tokens that the text holds. With ``english`` terms are
    stemmed and stopwords dropped on both sides, see functions.stem, and the score is ten times the cover density.
    """
    from kelpie.functions.stem import lexemes

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def search(some: DataFrame) -> DataFrame:
        asked = some.select("query_id", or_terms(F.col("query_text")).alias("terms"), F.array_distinct(tokens(F.col("query_text"))).alias("all")).toArrow()
        terms, every = asked.column("terms").to_pylist(), asked.column("all").to_pylist()
        if english:
            terms = [list(dict.fromkeys(lexemes(ts))) for ts in terms]
        return best_of(rows, asked.column("query_id").combine_chunks(), queries.schema["query_id"].dataType, lambda: _term_sums(terms, every if overlap else None, english), k, 1)

    found = in_batches(queries, search).withColumnRenamed("extra", "overlap")
    return top(found if overlap else found.drop("overlap"), k, "query_id", F.desc("score"), F.col("id"))


def _incidence(terms: list[list[str]]) -> list[tuple[int, dict[str, int], np.ndarray]]:
    """Per block of queries its first query, its terms by number, and (term, query) 1 where the query has the term."""
    out = []
    for at in range(0, len(terms), COLUMNS):
        some = terms[at : at + COLUMNS]
        number: dict[str, int] = {}
        for t in (t for ts in some for t in ts):
            number.setdefault(t, len(number))
        has = np.zeros((len(number), len(some)), np.float32)
        for j, ts in enumerate(some):
            has[[number[t] for t in ts], j] = 1
        out.append((at, number, has))
    return out


def _term_sums(terms: list[list[str]], every: list[list[str]] | None, english: bool) -> Scorer:
    """Sums of the frequencies of the queries' terms, and the shares of all of their tokens that a text holds."""
    from kelpie.functions.stem import counted_lexemes, plain_counts

    sums = _incidence(terms)
    shares = _incidence(every) if every is not None else [(at, {}, None) for at, _, _ in sums]
    sizes = np.array([max(1, len(e)) for e in every], float) if every is not None else None

    def filled(counts: list[Counter], number: dict[str, int]) -> np.ndarray:
        out = np.zeros((len(counts), len(number)), np.float32)
        for row, found in zip(out, counts):
            for t in found.keys() & number.keys():
                row[number[t]] = found[t]
        return out

    def score(batch):
        ids, texts = _ids(batch.column(0)), batch.column(1).to_pylist()
        for a in range(0, len(texts), ROWS // 4):
            plain = [plain_counts(t) for t in texts[a : a + ROWS // 4]]
            counts = [counted_lexemes(t) for t in texts[a : a + ROWS // 4]] if english else plain
            for (at, number, has), (_, others, inside) in zip(sums, shares):
                got = (filled(counts, number).astype(np.float64) @ has).T.astype(np.int64)
                held = None if inside is None else (np.minimum(filled(plain, others), 1) @ inside).T / sizes[at : at + inside.shape[1], None]
                yield at, ids[a : a + ROWS // 4], got, held

    return score


def fuse(lists: list[DataFrame], weights: list[float] | None = None, rrf_k: int = 60, id_col: str = "id") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, id, rank): score and rank, ties by the id as text, and each list's rank."""
    weights = weights or [1.0] * len(lists)
    parts = [d.select("query_id", F.col(id_col).alias("id"), F.lit(i).alias("list"), "rank") for i, d in enumerate(lists)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    ranks = [F.max(F.when(F.col("list") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(lists))]
    fused = union.groupBy("query_id", "id").agg(*ranks)
    score = sum((F.coalesce(F.lit(float(w)) / (rrf_k + F.col(f"rank_{i}")), F.lit(0.0)) for i, w in enumerate(weights)), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("id").cast("string"))
    return fused.withColumn("score", score).withColumn("rank", F.row_number().over(order))


def item_ranking(fused: DataFrame, items: DataFrame, queries: DataFrame) -> DataFrame:
    """The fused hits whose Item the question points to, by the Item's priority and then their rank. items: id, item."""
    wanted = small(queries).select("query_id", F.posexplode(inferred_items(F.col("query_text"))).alias("priority", "item"))
    hits = fused.join(items, "id").join(F.broadcast(wanted), ["query_id", "item"])
    return hits.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("priority", "rank")).alias("rank"))


def hybrid(dense: DataFrame, lexical: DataFrame, top_n: int, items: DataFrame | None = None, queries: DataFrame | None = None, boost: float = 0.0, mode: str = "hybrid") -> DataFrame:
    """Dense, lexical or fused hits with candidate rank; ``included`` marks the first top_n, nothing is cut from the candidates."""
    if mode == "dense":
        out = dense.select("query_id", "id", "rank")
    elif mode == "lexical":
        out = lexical.select("query_id", "id", "rank")
    elif mode == "hybrid":
        out = fuse([dense, lexical])
        if boost and items is not None:
            out = fuse([dense, lexical, item_ranking(out, items, queries)], [1.0, 1.0, boost])
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return out.withColumn("included", F.col("rank") <= (top_n or 8))


def with_overlap(hits: DataFrame) -> DataFrame:
    """Hits (query_id, id, rank, query_text, text) with overlap, for lists that do not come from search_texts."""
    q, p = F.array_distinct(tokens(F.col("query_text"))), F.array_distinct(tokens(F.col("text")))
    return hits.withColumn("overlap", F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, p)) / F.size(q)))


def overlaps(pairs: DataFrame, queries: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pairs (query_id, id) with overlap; every question and every text that some pair names is split into tokens once."""
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("query_text"))).alias("q"))
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(pairs.select("id").distinct(), "id", "left_semi")
    held = named.select("id", F.array_distinct(tokens(F.col("text"))).alias("p"))
    share = F.when(F.size("q") == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("q", "p")) / F.size("q"))
    return pairs.select("query_id", "id").join(held, "id").join(small(asked), "query_id").select("query_id", "id", share.alias("overlap"))


def overlap_rerank(hits: DataFrame) -> DataFrame:
    """Hits (query_id, id, rank, overlap) in the order of the share of question tokens they hold; ties keep their rank."""
    return hits.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank")))


def pack_greedy(blocks: DataFrame, most: int) -> DataFrame:
    """Blocks (query_id, rank, chars) with the running size and included: everything from the first overflow on is left out."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("cum_chars", F.sum("chars").over(upto)).withColumn("included", F.col("cum_chars") <= most)


def pack_skipping(blocks: DataFrame, most: int) -> DataFrame:
    """As pack_greedy, but a block that does not fit is passed over: an ordered fold per query over its (few) hits."""
    one = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chars"))).alias("bs"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<rank:int,chars:long,included:boolean>>").alias("out"))

    def step(acc, b):
        fits = acc["used"] + b["chars"] <= most
        row = F.struct(b["rank"].cast("int").alias("rank"), b["chars"].cast("long").alias("chars"), fits.alias("included"))
        return F.struct((acc["used"] + F.when(fits, b["chars"]).otherwise(0)).cast("long").alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = one.select("query_id", F.aggregate("bs", start, step)["out"].alias("rows"))
    return folded.select("query_id", F.inline("rows"))


def block_text(n: Column, ticker: Column, cik: Column, year: Column, item: Column, body: Column) -> Column:
    """A passage as it goes into the context: a tag line and the body."""
    tag = F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.coalesce(ticker, cik), F.lit(" FY"), F.coalesce(year.cast("string"), F.lit("?")))
    return F.concat(tag, F.coalesce(F.concat(F.lit(" Item "), item), F.lit("")), F.lit("\n"), body)


def ir_metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """Per query hit, recall, precision and nDCG at each k, and the reciprocal rank; queries without relevant ids score 0.

    ranked: query_id, id, rank. relevant: query_id, id, gain. Precision divides by what was retrieved, not by k.
    """
    hits = ranked.join(relevant.withColumnRenamed("gain", "g"), ["query_id", "id"], "left")
    got = [F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("g").isNotNull(), F.col("rank"))).alias("first")]
    for k in ks:
        within = F.col("rank") <= k
        got += [F.count_if(within & F.col("g").isNotNull()).alias(f"hits_{k}"), F.sum(F.when(within & F.col("g").isNotNull(), F.col("g") / F.log2(F.col("rank") + 1))).alias(f"dcg_{k}")]
    mine = hits.groupBy("query_id").agg(*got)
    best = relevant.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "id")))
    ideal = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"), *[F.sum(F.when(F.col("place") <= k, F.col("gain") / F.log2(F.col("place") + 1))).alias(f"ideal_{k}") for k in ks])
    rows = queries.select("query_id").join(mine, "query_id", "left").join(ideal, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = [F.col("query_id"), zero(1 / F.col("first")).alias("rr")]
    for k in ks:
        h = F.col(f"hits_{k}")
        out += [
            F.coalesce((h > 0).cast("double"), F.lit(0.0)).alias(f"hit@{k}"),
            zero(h / F.nullif("n_rel", F.lit(0))).alias(f"recall@{k}"),
            zero(h / F.nullif(F.least(F.lit(k), F.col("n")), F.lit(0))).alias(f"precision@{k}"),
            zero(F.col(f"dcg_{k}") / F.nullif(f"ideal_{k}", F.lit(0.0))).alias(f"ndcg@{k}"),
        ]
    return rows.select(*out)


def macro_average(per_case: DataFrame, keys: list[str], metrics: str = "metrics") -> DataFrame:
    """Mean of each metric over the cases that have it. metrics: a map column."""
    rows = per_case.select(*keys, F.explode(metrics).alias("metric", "value"))
    return rows.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n_cases"))
