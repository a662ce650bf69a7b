"""The engine as functions, for a server, a command line or a notebook: search, ask, status, SQL functions, prompts, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions import text
from kelpie.operators import providers, retrieval

_TOKENS = "transform(regexp_extract_all(coalesce(body, ''), '[A-Za-z0-9]+', 0), t -> lower(t))"
_DOT = "aggregate(zip_with({0}, {1}, (p, q) -> double(p) * double(q)), 0D, (s, v) -> s + v)"
_NEAR = "CASE WHEN expected = 0 THEN predicted = 0 ELSE abs(abs(predicted) * {0} - abs(expected)) / abs(expected) <= 0.005D END"
_N = "(tp + fp + fn + tn)"
_CHANCE = f"(((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / double({_N} * {_N}))"
#: Functions that SQL may call by name: arguments, type and body. The bodies say what the column functions of the same name do.
SQL_FUNCTIONS = {
    "kelpie_or_query": ("body STRING", "STRING", f"array_join(slice(array_distinct(filter({_TOKENS}, t -> length(t) >= 2)), 1, 24), ' | ')"),
    "kelpie_is_abstention": ("answer STRING", "BOOLEAN", f"answer RLIKE r'{text.ABSTENTION}'"),
    "kelpie_token_estimate": ("body STRING", "INT", "greatest(1, int(floor(length(body) / 4)))"),
    "kelpie_answer_hash": ("answer STRING", "STRING", "substr(sha2(coalesce(answer, ''), 256), 1, 12)"),
    "kelpie_values_match": ("predicted DOUBLE, expected DOUBLE", "BOOLEAN", " OR ".join(f"({_NEAR.format(s)})" for s in ("1D", "1e3D", "1e6D", "1e9D"))),
    "kelpie_percent_change": ("before DOUBLE, after DOUBLE", "DOUBLE", "(after - before) / nullif(abs(before), 0D) * 100"),
    "kelpie_cosine": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", f"coalesce({_DOT.format('a', 'b')} / nullif(sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')}), 0D), 0D)"),
    "kelpie_kappa": ("tp BIGINT, fp BIGINT, fn BIGINT, tn BIGINT", "DOUBLE", f"CASE WHEN {_N} = 0 THEN NULL WHEN {_CHANCE} = 1 THEN 1D ELSE ((tp + tn) / double({_N}) - {_CHANCE}) / (1 - {_CHANCE}) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the SQL_FUNCTIONS temporary functions of the session: expressions that Catalyst inlines, no Python at run time."""
    for name, (arguments, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    return sorted(SQL_FUNCTIONS)


def search(queries: DataFrame, chunks: DataFrame, k: int = 50, top_n: int = 8, mode: str = "hybrid", where: Column | None = None) -> DataFrame:
    """Hits (query_id, id, rank, included) of questions (query_id, query_text, query_vector) among chunks (id, body, embedding)."""
    some = chunks if where is None else chunks.filter(where)
    dense = retrieval.dense_search(queries, some, k, "id", "embedding") if mode != "lexical" else None
    lexical = retrieval.search_texts(queries, some, k, "id", "body") if mode != "dense" else None
    return retrieval.hybrid(dense, lexical, top_n, mode=mode).select("query_id", "id", "rank", "included")


def contexts(hits: DataFrame, chunks: DataFrame, cap: int = 20_000) -> DataFrame:
    """query_id and context: the included hits' blocks in order, up to the cap."""
    blocks = hits.filter("included").join(chunks, "id")
    blocks = blocks.withColumn("block", retrieval.block_text(F.col("rank"), F.col("ticker"), F.col("cik"), F.col("fiscal_year"), F.col("item"), F.col("body")))
    packed = retrieval.pack_greedy(blocks.withColumn("chars", F.length("block")).select("query_id", "rank", "block", "chars"), cap).filter("included")
    parts = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return packed.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n").alias("context"))


def ask(queries: DataFrame, chunks: DataFrame, answer: Callable[[Column], Column] = providers.largest_number, **search_options) -> DataFrame:
    """query_id, allowed, reason and answer: screened questions are answered from their context, the offline stand-in by default."""
    checked = queries.withColumn("screened", text.screen(F.col("query_text"))).select("*", "screened.allowed", "screened.reason").drop("screened")
    asked = checked.filter("allowed")
    found = contexts(search(asked, chunks, **search_options), chunks)
    return checked.select("query_id", "allowed", "reason").join(found, "query_id", "left").withColumn("answer", answer(F.col("context"))).drop("context")


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """name and n: how many rows each table holds."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Prompts of judges by version: what they are told, and what they get to see. The default is the second.
CONTRACTS = {
    "v1": "Question: {question}\nReference: {reference}\nCandidate: {candidate}\nDoes the candidate agree with the reference? Answer PASS or FAIL.",
    "v2": "Question: {question}\nReference: {reference}\nCandidate: {candidate}\nFAIL a candidate that contradicts the reference or leaves out a fact it needs; PASS one that says more. Answer PASS or FAIL, then why.",
    "v3": "Question: {question}\nReference: {reference}\nSource: {source}\nCandidate: {candidate}\nList each claim of the candidate that neither reference nor source bears out. PASS if there is none and no needed fact is missing.",
    "v3_1": "Question: {question}\nReference: {reference}\nSource: {source}\nCandidate: {candidate}\nList the facts that the question needs, then whether the candidate states each. PASS if all are stated and none is contradicted.",
}


def judge_prompt(version: str, question: Column, reference: Column, candidate: Column, source: Column | None = None) -> Column:
    """The prompt of a contract; parts that are null are empty. Braces in a part are text."""
    parts = {"question": question, "reference": reference, "candidate": candidate, "source": F.lit("") if source is None else source}
    pieces, rest = [], CONTRACTS[version]
    while rest:
        before, _, after = rest.partition("{")
        pieces.append(F.lit(before))
        if not after:
            break
        name, _, rest = after.partition("}")
        pieces.append(F.coalesce(parts[name], F.lit("")))
    return F.concat(*pieces)


def report(title: str, sections: dict[str, DataFrame], most: int = 50) -> str:
    """A report in Markdown: each section a table of at most ``most`` rows, with a note where there are more."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
        out += ["", *(["More rows are not shown.", ""] if len(rows) > most else [])]
    return "\n".join(out)


def save(spark: SparkSession, path: str, body: str) -> None:
    """Writes a small text file to any file system that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(body.encode()))
    out.close()
