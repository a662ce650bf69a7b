"""What a model gets to see of the evidence: ranks before and after truncation, the context cap, stale labels, read windows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.stats import ranked, same_keys

from .retrieval import hybrid, pack_greedy, pack_skipping

PACKINGS = {"greedy-stop": pack_greedy, "skip": pack_skipping}


def relevant_ranks(candidates: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per query the ranks of its relevant ids among the candidates, and among those included. candidates: query_id, id, rank, included."""
    hits = candidates.join(relevant.select("query_id", "id").distinct(), ["query_id", "id"])
    return hits.groupBy("query_id").agg(
        F.sort_array(F.collect_list("rank")).alias("pre_ranks"), F.sort_array(F.collect_list(F.when(F.col("included"), F.col("rank")))).alias("final_ranks")
    )


def probed(candidates: DataFrame, chars: DataFrame, relevant: DataFrame, queries: DataFrame, cap: int = 20_000, packing: str = "greedy-stop") -> DataFrame:
    """Per query an account of its evidence through the stages: found, kept by top_n, and put before the model.

    candidates: query_id, id, rank, included (by top_n). chars: id, chars of its block. relevant: query_id, id.
    Columns: n_relevant, pre_ranks, final_ranks, n_included, n_dropped, chars_before, chars_after, cap_binding, relevant_in_prompt,
    lost_to_cap, first_excluded_rank, would_fit_with_skip (a later block would still have fitted).
    """
    picked = candidates.filter("included").join(chars, "id").select("query_id", "id", "rank", "chars")
    packed = PACKINGS[packing](picked.select("query_id", "rank", "chars"), cap).select("query_id", "rank", F.col("included").alias("shown"))
    marked = picked.join(packed, ["query_id", "rank"]).join(relevant.select("query_id", "id", F.lit(1).alias("wanted")).distinct(), ["query_id", "id"], "left")
    shown = F.col("shown")
    used = F.sum(F.when(shown, F.col("chars")).otherwise(0)).over(Window.partitionBy("query_id"))
    marked = marked.withColumn("used", used)
    sums = marked.groupBy("query_id").agg(
        F.count_if(shown).alias("n_included"), F.count_if(~shown).alias("n_dropped"), F.sum("chars").alias("chars_before"), F.max("used").alias("chars_after"),
        F.count_if(shown & F.col("wanted").isNotNull()).alias("relevant_in_prompt"), F.count_if(~shown & F.col("wanted").isNotNull()).alias("lost_to_cap"),
        F.min(F.when(~shown, F.col("rank"))).alias("first_excluded_rank"), F.coalesce(F.max(~shown & (F.col("used") + F.col("chars") <= cap)), F.lit(False)).alias("would_fit_with_skip"),
    )
    wanted = relevant.select("query_id", "id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    out = queries.select("query_id").join(wanted, "query_id", "left").join(relevant_ranks(candidates, relevant), "query_id", "left").join(sums, "query_id", "left")
    none = F.array().cast("array<int>")
    counts = ("n_relevant", "n_included", "n_dropped", "chars_before", "chars_after", "relevant_in_prompt", "lost_to_cap")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {c: F.coalesce(c, none) for c in ("pre_ranks", "final_ranks")})
    return out.withColumn("cap_binding", F.col("n_dropped") > 0).withColumn("would_fit_with_skip", F.coalesce("would_fit_with_skip", F.lit(False)))


def stage_of_loss(account: DataFrame) -> DataFrame:
    """An account with lost_at: where a query's evidence was last seen before it was lost, ``prompt`` if the model saw some."""
    lost = (
        F.when(F.col("n_relevant") == 0, "unlabelled")
        .when(F.size("pre_ranks") == 0, "search")
        .when(F.size("final_ranks") == 0, "truncation")
        .when(F.col("relevant_in_prompt") == 0, "cap")
        .otherwise("prompt")
    )
    return account.withColumn("lost_at", lost)


def label_check(labels: DataFrame, index: DataFrame) -> DataFrame:
    """One row: labels, those in the index, stale ones, and cases. labels: case_id, id. index: id."""
    held = labels.distinct().join(index.select("id", F.lit(1).alias("held")).distinct(), "id", "left")
    out = held.agg(F.count(F.lit(1)).alias("labels"), F.count("held").alias("labels_in_index"), F.count_distinct("case_id").alias("cases"))
    return out.withColumn("stale_labels", F.col("labels") - F.col("labels_in_index"))


def labels_for(labels: DataFrame, index: DataFrame, relink: Callable[[], DataFrame]) -> tuple[DataFrame, dict]:
    """Labels that hold for an index, and a record: untouched if all are in it, else all cases are linked anew."""
    record = label_check(labels, index).first().asDict()
    record["relinked"] = bool(record["labels"] and record["stale_labels"])
    if not record["relinked"]:
        return labels, record
    fresh = relink()
    return fresh, record | {"cases_after": fresh.select("case_id").distinct().count()}


def compared_strategies(run: Callable[[str], DataFrame], strategies: list[str]) -> DataFrame:
    """The same cases under every strategy: the rows of run(strategy) with the strategy's name."""
    out = None
    for name in strategies:
        rows = run(name).withColumn("strategy", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def truncation_audit(pairs: DataFrame, count: Callable[[list[str]], list[int]], window: int = 512, reserved: int = 3) -> DataFrame:
    """How much of its passages a reranker reads: per query the passages past its budget, and the share of the median one that is seen.

    pairs: query_id, query_text, text. count: the lengths in tokens of some texts. The query and reserved marks come out of the window.
    """

    @F.pandas_udf("long")
    def tokens(text: pd.Series) -> pd.Series:
        return pd.Series(count(text.fillna("").tolist()))

    rows = pairs.select("query_id", tokens("query_text").alias("q"), tokens("text").alias("n")).withColumn("budget", F.lit(window - reserved) - F.col("q"))
    sums = rows.groupBy("query_id").agg(
        F.max("q").alias("query_tokens"), F.min("budget").alias("budget"), F.count(F.lit(1)).alias("passages"), F.count_if(F.col("n") > F.col("budget")).alias("truncated"), F.max("n").alias("most_tokens")
    )
    out = same_keys(sums, ranked(rows, ["query_id"], "n", median_tokens=lambda n: F.floor(n / 2)), ["query_id"])
    seen = F.least(F.lit(1.0), F.col("budget") / F.nullif("median_tokens", F.lit(0)))
    return out.withColumn("truncated_share", F.col("truncated") / F.col("passages")).withColumn("median_seen", F.coalesce(seen, F.lit(1.0)))


def searched(dense: DataFrame, lexical: DataFrame, top_n: int, mode: str = "hybrid") -> DataFrame:
    """Candidates of one arm with rank and included, for probed()."""
    return hybrid(dense, lexical, top_n, mode=mode).select("query_id", "id", "rank", "included")


def index_shape(chunks: DataFrame, strategy: str) -> DataFrame:
    """One row: chunks of a strategy, those embedded, their largest size in tokens (0 without any) and the range of their ids."""
    some = chunks.filter(F.col("strategy") == strategy)
    return some.agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("embedded"), F.coalesce(F.max("token_est"), F.lit(0)).alias("most_tokens"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def window_sample(chunks: DataFrame, count: Callable[[list[str]], list[int]], per_strategy: int = 300, seed: str = "7") -> DataFrame:
    """strategy and tokens of a seeded sample of chunks (id, strategy, body), counted by a model's tokenizer, for golden.window_audit."""
    from .sampling import per_group

    @F.pandas_udf("long")
    def tokens(text: pd.Series) -> pd.Series:
        return pd.Series(count(text.fillna("").tolist()))

    return per_group(chunks, "strategy", "id", per_strategy, seed).select("strategy", tokens("body").alias("tokens"))


def whole_filing(companies: DataFrame, filings: DataFrame, sections: DataFrame, ticker: str, fiscal_year: int, form: str = "10-K") -> tuple[str, str]:
    """(accession, text) of a company's one filing of a year: its sections in order; an error unless there is exactly one."""
    held = companies.filter(F.col("ticker") == ticker).join(filings.filter((F.col("fiscal_year") == fiscal_year) & (F.col("form") == form)), "cik")
    found = held.select("accession", F.col("id").alias("filing_id")).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{ticker} has {'no' if not found else 'more than one'} {form} of {fiscal_year}")
    parts = sections.filter(F.col("filing_id") == found[0]["filing_id"]).orderBy("ordinal").select("title", "body").collect()
    return found[0]["accession"], "\n\n".join(f"{p['title']}\n{p['body']}" if p["title"] else p["body"] for p in parts)


def transitions(before: DataFrame, after: DataFrame, key: str = "case_id") -> DataFrame:
    """One row: cases both runs have, and how many passed in both, in neither, or were fixed or broken. before, after: key, passed."""
    a, b = F.coalesce("was", F.lit(False)), F.coalesce("now", F.lit(False))
    both = before.select(key, F.col("passed").alias("was")).join(after.select(key, F.col("passed").alias("now")), key)
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(a & b).alias("kept"), F.count_if(~a & b).alias("fixed"), F.count_if(a & ~b).alias("broken"), F.count_if(~a & ~b).alias("failing"))
