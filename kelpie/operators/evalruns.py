"""Evaluation runs: summaries, gates, flips, votes, failure attribution, monitoring statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.figures import values_match
from kelpie.functions.stats import capped, confusion, percentile_capped, ranked, same_keys, wilson

#: The gated metrics, and how far a metric may fall.
GATED = ("overall_score", "numeric_accuracy", "recall@5", "mrr")
MAX_REGRESSION, KAPPA_FLOOR = 0.03, 0.60


def summarise(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per run the accuracy of numeric cases (null without any), pass rate of narrative ones (0 without), overall score, abstention and
    hallucination over numeric cases without error, latency median and 95th percentile. Columns: kind, passed, errored, abstained, latency_ms."""
    numeric, narrative = F.col("kind") == "numeric", F.col("kind") == "narrative"
    ok = F.coalesce(F.col("passed"), F.lit(False))
    clean = numeric & ~F.coalesce(F.col("errored"), F.lit(False))
    sums = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.avg(F.when(numeric, ok.cast("double"))).alias("numeric_accuracy"),
        F.coalesce(F.avg(F.when(narrative, ok.cast("double"))), F.lit(0.0)).alias("narrative_pass_rate"),
        F.avg(ok.cast("double")).alias("overall_score"),
        F.coalesce(F.avg(F.when(clean, F.col("abstained").cast("double"))), F.lit(0.0)).alias("abstention_rate"),
        F.coalesce(F.avg(F.when(clean, (~ok & ~F.col("abstained")).cast("double"))), F.lit(0.0)).alias("hallucination_rate"),
    )
    # the median is the mean of the two middle entries
    middle = {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)}
    out = same_keys(sums, ranked(results, keys, "latency_ms", **middle, latency_p95=capped(0.95)), keys)
    return out.withColumn("latency_p50", (F.col("_low") + F.col("_high")) / 2).drop("_low", "_high")


def gate(current: DataFrame, baseline: DataFrame, most: float = MAX_REGRESSION) -> DataFrame:
    """Per gated metric (metric, value) on both sides its delta and whether it blocks; metrics that a side lacks are left out."""
    both = current.join(baseline.withColumnRenamed("value", "base"), "metric").filter(F.col("value").isNotNull() & F.col("base").isNotNull())
    both = both.filter(F.col("metric").isin(*GATED)).withColumn("delta", F.col("value") - F.col("base"))
    return both.withColumn("blocks", F.col("delta") < -most)


def failure_cause(retrieval_json: Column) -> Column:
    """unlabelled without recall@5, retrieval where it is 0, generation otherwise."""
    recall = F.get_json_object(retrieval_json, "$.recall@5").try_cast("double")
    return F.when(recall.isNull(), "unlabelled").when(recall == 0, "retrieval").otherwise("generation")


def majority(runs: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """Majority verdict per key; ties fail, errors (null) have no vote."""
    votes = runs.filter(F.col(verdict).isNotNull()).groupBy(*keys)
    return votes.agg((F.count_if(F.col(verdict)) > F.count_if(~F.col(verdict))).alias("passed"), (F.count_distinct(verdict) > 1).alias("unstable"))


def flips(before: DataFrame, after: DataFrame, key: str, truth: str) -> DataFrame:
    """Cases whose verdict changed, regressions first. before, after: key, passed; before also has the truth."""
    out = before.select(key, truth, F.col("passed").alias("was")).join(after.select(key, F.col("passed").alias("now")), key).filter("was <> now")
    kind = F.when(F.col("now") == F.col(truth), "FIXED").otherwise("REGRESSION")
    return out.withColumn("kind", kind).orderBy(F.desc("kind"), key)


def last_wins(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key."""
    return records.groupBy(key).agg(F.max_by(F.struct(*[c for c in records.columns if c != key]), order).alias("r")).select(key, "r.*")


def latest(runs: DataFrame, when: str = "finished_at", tie: str = "id") -> DataFrame:
    """The newest row: unfinished ones last, ties by the larger id."""
    return runs.orderBy(F.col(when).desc_nulls_last(), F.col(tie).desc()).limit(1)


def outcome_mix(traces: DataFrame, newest: int, id_col: str, outcome: str, latency: str, cost: str) -> DataFrame:
    """Outcomes of the newest traces: count, mean latency (rounded), mean cost, share."""
    rows = traces.orderBy(F.desc(id_col)).limit(newest)
    out = rows.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(latency)).cast("int").alias("avg_latency_ms"), F.avg(cost).alias("avg_cost"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def latency_window(requests: DataFrame, path: str, seq: str, status: str, ms: str, newest: int = 1000) -> DataFrame:
    """Per path over its newest requests: counts by kind of status, and percentiles of the successful ones."""
    recent = requests.withColumn("_n", F.row_number().over(Window.partitionBy(path).orderBy(F.desc(seq)))).filter(F.col("_n") <= newest)
    good = F.col(status).between(200, 399)
    return recent.groupBy(path).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(good).alias("ok"),
        F.count_if(F.col(status).between(400, 499)).alias("client_errors"),
        F.count_if(F.col(status) >= 500).alias("server_errors"),
        percentile_capped(F.when(good, F.col(ms)), 0.5).alias("p50"),
        percentile_capped(F.when(good, F.col(ms)), 0.95).alias("p95"),
    )


def knee(levels: DataFrame, level: str, p95: str, throughput: str) -> DataFrame:
    """The first level where the 95th percentile grows over half and the throughput by less than a fifth."""
    w = Window.orderBy(level)  # a row for each load level: a handful
    out = levels.withColumn("_p", F.lag(p95).over(w)).withColumn("_t", F.lag(throughput).over(w))
    return out.filter((F.col(p95) > 1.5 * F.col("_p")) & (F.col(throughput) < 1.2 * F.col("_t"))).agg(F.min(level).alias("knee"))


def running_abort(cases: DataFrame, run: str, order: str, infra: str, least: int = 8, share: float = 0.25) -> DataFrame:
    """Cases with void: from the first case on where, after at least ``least`` cases, more than ``share`` were infrastructure errors."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    bad = (F.count(F.lit(1)).over(w) >= least) & (F.sum(F.col(infra).cast("int")).over(w) > share * F.count(F.lit(1)).over(w))
    return cases.withColumn("_bad", bad.cast("int")).withColumn("void", F.max("_bad").over(w) == 1).drop("_bad")


def cost_ceiling(steps: DataFrame, run: str, order: str, cost: str, most: float) -> DataFrame:
    """Steps with the running cost and whether the run had gone over the ceiling."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("running_cost", F.sum(cost).over(w)).withColumn("over", F.col("running_cost") > most)


def loops(calls: DataFrame, run: str, order: str, key: list[str], most: int = 2) -> DataFrame:
    """Calls with looping: made more than ``most`` times so far in the run."""
    w = Window.partitionBy(run, *key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("looping", F.count(F.lit(1)).over(w) > most)


def token_cost(prompt: Column, completion: Column, in_price: Column, out_price: Column) -> Column:
    """Dollars of a call, prices per million tokens."""
    return (prompt * in_price + completion * out_price) / 1_000_000


def fingerprint(cases: DataFrame, fields: list[str]) -> DataFrame:
    """n_cases and a digest of the cases that no order changes: 16 hex digits over the sums of the rows' digests.

    A row's digest covers its fields by length and text, nulls apart from empty ones; its two halves are added up over all
    rows, so nothing is collected.
    """
    said = [F.coalesce(F.concat(F.length(F.col(f).cast("string")).cast("string"), F.lit(":"), F.col(f).cast("string")), F.lit("-")) for f in sorted(fields)]
    rows = cases.select(F.md5(F.concat_ws(";", *said)).alias("d"))
    half = lambda at: F.coalesce(F.sum(F.conv(F.substring("d", at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    sums = rows.agg(F.count(F.lit(1)).alias("n_cases"), half(1).alias("a"), half(17).alias("b"))
    return sums.select("n_cases", F.substring(F.md5(F.concat_ws("/", F.col("n_cases").cast("string"), "a", "b")), 1, 16).alias("digest"))


def score_extraction(predicted: DataFrame, expected: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Per case tp, n_predicted, n_expected, precision, recall and f1; precision and recall are 1 where both sides are empty.

    predicted, expected: case_id, concept, fiscal_year, value, ord; the first value of a (concept, year) counts. Cases in
    arrays, with facts to leave out, are scored by extraction.scored.
    """
    key = ["case_id", "concept", "fiscal_year"]
    p = predicted.groupBy(*key).agg(F.min_by("value", "ord").alias("p"))
    e = expected.groupBy(*key).agg(F.min_by("value", "ord").alias("e"))
    both = p.join(e, key, "full_outer")
    hit = F.col("p").isNotNull() & F.col("e").isNotNull() & values_match(F.col("p"), F.col("e"), tolerance)
    out = both.groupBy("case_id").agg(F.count_if(hit).alias("tp"), F.count("p").alias("n_predicted"), F.count("e").alias("n_expected"))
    return with_rates(out)


def with_rates(counts: DataFrame) -> DataFrame:
    """tp, n_predicted and n_expected with precision, recall, f1 and exact: whether all of both sides match."""
    empty = (F.col("n_predicted") == 0) & (F.col("n_expected") == 0)
    rate = lambda n: F.when(empty, 1.0).when(F.col(n) == 0, 0.0).otherwise(F.col("tp") / F.col(n))
    out = counts.withColumn("precision", rate("n_predicted")).withColumn("recall", rate("n_expected"))
    both = F.col("precision") + F.col("recall")
    out = out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))
    return out.withColumn("exact", (F.col("tp") == F.col("n_expected")) & (F.col("tp") == F.col("n_predicted")))


#: What adopting a judge asks for.
MOST_FALSE_PASSES = 4


def adoption(candidate: DataFrame, baseline: DataFrame, must_pass: tuple[str, ...] = (), must_fail: tuple[str, ...] = (), noise: float = 0.0) -> DataFrame:
    """Clauses (clause, passed) of adopting a judge over its baseline, both given as verdicts: case_id, truth, said (null: an error).

    Asked for are: no false fail that the baseline lacks, at most MOST_FALSE_PASSES false passes, the named cases passed
    and failed, kappa at KAPPA_FLOOR or more, and a gain of kappa over the baseline's that beats the noise between replicates.
    """
    counts = lambda df: confusion(df, [], F.col("truth"), F.col("said"))
    b = counts(baseline).select(F.col("kappa").alias("base_kappa"))
    fails = lambda df: df.filter(F.col("truth") & ~F.col("said")).select("case_id")
    new = fails(candidate).join(fails(baseline), "case_id", "left_anti").agg(F.count(F.lit(1)).alias("new_fails"))
    named = candidate.agg(
        F.count_if(F.col("case_id").isin(*must_pass) & F.coalesce(F.col("said"), F.lit(False))).alias("passed_named") if must_pass else F.lit(0).alias("passed_named"),
        F.count_if(F.col("case_id").isin(*must_fail) & F.coalesce(~F.col("said"), F.lit(False))).alias("failed_named") if must_fail else F.lit(0).alias("failed_named"),
    )
    row = counts(candidate).crossJoin(b).crossJoin(new).crossJoin(named)  # a row each
    clause = lambda name, ok: F.struct(F.lit(name).alias("clause"), F.coalesce(ok, F.lit(False)).alias("passed"))
    clauses = F.array(
        clause("no new false fails", F.col("new_fails") == 0),
        clause("few false passes", F.col("fp") <= MOST_FALSE_PASSES),
        clause("named cases pass", F.col("passed_named") == len(must_pass)),
        clause("named cases fail", F.col("failed_named") == len(must_fail)),
        clause("kappa floor", F.col("kappa") >= KAPPA_FLOOR),
        clause("gain beats noise", F.col("kappa") - F.col("base_kappa") > noise),
    )
    return row.select(F.inline(clauses))


# ---- infrastructure errors and case ids

#: Fixed value: errors of the machinery, which say nothing about an answer.
INFRASTRUCTURE = (
    r"(?i)401 Unauthorized|403 Forbidden|429 Too Many Requests|invalid[_ ]api[_ ]key|authentication|insufficient_quota"
    r"|Connection (?:refused|error|reset)|Timeout|Name or service not known|nodename nor servname|SSL"
)


def is_infrastructure(message: Column) -> Column:
    """Whether an error is one of the machinery; no message is none."""
    return F.coalesce(message.rlike(INFRASTRUCTURE), F.lit(False))


def case_parts(case_id: Column) -> Column:
    """struct(kind, ticker, subject, topic) of an id kind-TICKER-topic: subject is the ticker where it is one in capitals, else ``?``;
    a part that is missing is ``unknown``."""
    parts = F.split(case_id, "-", 3)
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit("unknown"))
    subject = F.when((F.size(parts) >= 3) & F.get(parts, F.lit(1)).rlike("^[A-Z]+$"), F.get(parts, F.lit(1))).otherwise("?")
    return F.struct(part(0).alias("kind"), part(1).alias("ticker"), subject.alias("subject"), part(2).alias("topic"))


# ---- summaries of arms and loads


def arm_summary(answers: DataFrame, calls: DataFrame) -> DataFrame:
    """Per arm of a router or a long-context run: accuracy with its Wilson interval, calls, tokens, cost and latency a question.

    answers: arm, case_id, difficulty, passed, outcome, strong (answered by the strong model). calls: arm, case_id,
    prompt_tokens, completion_tokens, cached_tokens, cost_usd, latency_ms; every call counts, repeated ones too.
    """
    asked = answers.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("passed")).alias("correct"),
        F.avg(F.coalesce("strong", F.lit(False)).cast("int")).alias("strong_share"),
        F.count_if(F.col("outcome") == "abstained").alias("abstained"),
    )
    spent = calls.groupBy("arm").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("cached_tokens").alias("cached_tokens"), F.sum("cost_usd").alias("cost_usd"),
    )
    out = same_keys(same_keys(asked, spent, ["arm"]), ranked(calls, ["arm"], "latency_ms", latency_p50=capped(0.5), latency_p95=capped(0.95)), ["arm"])
    return out.withColumns(
        {
            "accuracy": F.col("correct") / F.col("n"), "interval": wilson(F.col("correct").cast("double"), F.col("n").cast("double")),
            "calls_per_question": F.col("calls") / F.col("n"), "cost_per_1k": F.col("cost_usd") / F.col("n") * 1000,
            "cost_per_1k_correct": F.col("cost_usd") / F.nullif("correct", F.lit(0)) * 1000,
            "cache_hit_rate": F.col("cached_tokens") / F.nullif("prompt_tokens", F.lit(0)),
        }
    )


def accuracy_by(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Cases, passes and accuracy by arm and the given keys, such as the difficulty or whether the evidence was in the context."""
    out = answers.groupBy("arm", *keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("passed")).alias("correct"))
    return out.withColumn("accuracy", F.col("correct") / F.col("n"))


def load_summary(requests: DataFrame, level: str = "level", usd_per_hour: float | None = None) -> DataFrame:
    """Per load level of a load test (level, started, ms, ok): requests, failures, throughput and latency of the successes, and their cost per thousand."""
    good = F.col("ok")
    ended = F.col("started") + F.col("ms")
    sums = requests.groupBy(level).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"),
        ((F.max(ended) - F.min("started")) / 1000.0).alias("seconds"), F.max(F.when(good, F.col("ms"))).alias("most"), F.avg(F.when(good, F.col("ms"))).alias("mean"),
    )
    out = same_keys(sums, ranked(requests.filter(good), [level], "ms", p50=capped(0.5), p95=capped(0.95), p99=capped(0.99)), [level])
    out = out.withColumn("per_second", F.col("succeeded") / F.nullif("seconds", F.lit(0.0)))
    cost = F.lit(usd_per_hour) / 3600 / F.nullif("per_second", F.lit(0.0)) * 1000 if usd_per_hour else F.lit(None).cast("double")
    return out.withColumn("usd_per_1k", cost)


def figures_in_context(needles: Column, context: Column) -> Column:
    """Whether a context prints every figure an answer needs. needles: for each figure the array of its printings.

    Only printings of four digits or more, or with decimals, count; null where a figure has none, or none is needed.
    """
    telling = F.transform(needles, lambda ns: F.filter(ns, lambda n: (F.length(F.regexp_replace(n, "[^0-9]", "")) >= 4) | n.contains(".")))
    shown = F.forall(telling, lambda ns: F.exists(ns, lambda n: F.contains(F.coalesce(context, F.lit("")), n)))
    return F.when((F.size(telling) > 0) & F.forall(telling, lambda ns: F.size(ns) > 0), shown)
