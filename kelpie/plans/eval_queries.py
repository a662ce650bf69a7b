"""Queries over evaluation runs, monitoring, sampling, upserts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions import stats
from kelpie.operators import evalruns as op
from kelpie.operators import sampling
from kelpie.sources import sinks

from .registry import query, table


def _events(spark, sf):
    return table(spark, sf, "events")


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents")
def status_union(spark, sf):
    parts = [table(spark, sf, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("nation", "customer", "orders", "documents")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    """WITH l AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 500)
SELECT event_type AS outcome, count(*) AS n, round(avg(value * 1000))::INT AS avg_latency_ms, round(count(*) * 1000000.0 / sum(count(*)) OVER ())::BIGINT AS share_ppm FROM l GROUP BY 1"""
)
def outcome_mix(spark, sf):
    rows = _events(spark, sf).select("event_id", F.col("event_type").alias("outcome"), (F.col("value") * 1000).alias("ms"), "value")
    return op.outcome_mix(rows, 500, "event_id", "outcome", "ms", "value").select("outcome", "n", "avg_latency_ms", F.round(F.col("share") * 1_000_000).cast("long").alias("share_ppm"))


_STATUS = "CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'click' THEN 404 ELSE 200 END"


@query(
    f"""WITH r AS (SELECT user_id % 5 AS path, event_id, {_STATUS} AS status, floor(value * 1000)::BIGINT AS ms FROM events),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY event_id DESC) AS k FROM r) WHERE k <= 1000),
a AS (SELECT path, count(*) AS requests, count(*) FILTER (WHERE status < 400) AS ok, count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS client_errors,
  count(*) FILTER (WHERE status >= 500) AS server_errors, list_sort(list(ms) FILTER (WHERE status < 400)) AS xs FROM w GROUP BY 1)
SELECT path, requests, ok, client_errors, server_errors, xs[least(len(xs) - 1, floor(0.5 * len(xs))::BIGINT) + 1] AS p50, xs[least(len(xs) - 1, floor(0.95 * len(xs))::BIGINT) + 1] AS p95 FROM a"""
)
def latency_window(spark, sf):
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "click", 404).otherwise(200)
    rows = _events(spark, sf).select((F.col("user_id") % 5).alias("path"), "event_id", status.alias("status"), F.floor(F.col("value") * 1000).alias("ms"))
    return op.latency_window(rows, "path", "event_id", "status", "ms")


@query(
    """WITH l AS (SELECT floor(value * 1000000)::BIGINT AS c FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 500)), a AS (SELECT count(*) AS n, sum(c)::BIGINT AS total, list_sort(list(c)) AS xs FROM l)
SELECT n, total, xs[least(len(xs) - 1, floor(0.5 * len(xs))::BIGINT) + 1] AS p50, xs[least(len(xs) - 1, floor(0.95 * len(xs))::BIGINT) + 1] AS p95, xs[floor(0.5 * (len(xs) - 1))::BIGINT + 1] AS inner_p50, xs[len(xs) // 2 + 1] AS upper_median FROM a"""
)
def cost_stats(spark, sf):
    rows = _events(spark, sf).orderBy(F.desc("event_id")).limit(500).select(F.floor(F.col("value") * 1_000_000).alias("c"))
    c = F.col("c")
    return rows.agg(
        F.count(c).alias("n"), F.sum(c).alias("total"), stats.percentile_capped(c, 0.5).alias("p50"), stats.percentile_capped(c, 0.95).alias("p95"), stats.percentile_inner(c, 0.5).alias("inner_p50"), stats.upper_median(c).alias("upper_median")
    )


@query("SELECT event_type, event_id, pick FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR || '7'), event_id)::INT AS pick FROM events) WHERE pick <= 25")
def sample_per_group(spark, sf):
    return sampling.per_group(_events(spark, sf), "event_type", "event_id", 25, "7").select("event_type", "event_id", "pick")


@query("SELECT event_id FROM events ORDER BY md5(event_id::VARCHAR || '17'), event_id LIMIT 200")
def sample_superset(spark, sf):
    return sampling.superset_stable(_events(spark, sf), "event_id", 200, "17").select("event_id")


@query(
    """WITH d AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id)::INT AS depth FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY depth, user_id)::INT AS turn FROM d) SELECT event_type, user_id, event_id, depth, turn FROM t WHERE turn <= 25"""
)
def round_robin_sample(spark, sf):
    return sampling.round_robin(_events(spark, sf), "event_type", "user_id", "event_id", 25).select("event_type", "user_id", "event_id", "depth", "turn")


@query(
    """WITH s AS (SELECT s_nationkey, s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5(s_suppkey::VARCHAR || '13'), s_suppkey) AS place FROM supplier)
SELECT s_suppkey, n >= 2 AND place <= 1 AS held_out FROM s"""
)
def stratified_split(spark, sf):
    return sampling.held_out_split(table(spark, sf, "supplier"), "s_nationkey", "s_suppkey", 1, "13").select("s_suppkey", "held_out")


@query(
    """WITH z AS (SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS total FROM events GROUP BY 1), q AS (SELECT event_type, greatest(1, round_even(n * 100 / total, 0))::INT AS quota FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR || '11'), event_id) AS pick FROM events) SELECT event_id, event_type FROM r JOIN q USING (event_type) WHERE pick <= quota"""
)
def proportional_sample(spark, sf):
    return sampling.proportional(_events(spark, sf), ["event_type"], "event_id", 100, "11").select("event_id", "event_type")


_CONF = """WITH c AS (SELECT quality = 1 AS truth, length(text) > 600 AS said FROM labels JOIN documents USING (doc_id)),
m AS (SELECT count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE NOT truth AND said) AS fp, count(*) FILTER (WHERE truth AND NOT said) AS fn, count(*) FILTER (WHERE NOT truth AND NOT said) AS tn FROM c)"""


def _verdicts(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("doc_id", (F.col("quality") == 1).alias("truth"), (F.length("text") > 600).alias("said"), "toxic")


@query(
    _CONF + """SELECT tp, fp, fn, tn, round(((tp + tn) / (tp + fp + fn + tn)::DOUBLE - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn))::DOUBLE)
  / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn))::DOUBLE) * 1000000)::BIGINT AS kappa_ppm,
  round((tp / (tp + fn)::DOUBLE + tn / (fp + tn)::DOUBLE) / 2 * 1000000)::BIGINT AS balanced_ppm FROM m"""
)
def kappa(spark, sf):
    out = stats.confusion(_verdicts(spark, sf), [], F.col("truth"), F.col("said"))
    return out.select("tp", "fp", "fn", "tn", F.round(F.col("kappa") * 1_000_000).cast("long").alias("kappa_ppm"), F.round(F.col("balanced_accuracy") * 1_000_000).cast("long").alias("balanced_ppm"))


@query("SELECT user_id, count(*) FILTER (WHERE v) > count(*) FILTER (WHERE NOT v) AS passed, count(DISTINCT v) > 1 AS unstable FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value > 10 END AS v FROM events) WHERE v IS NOT NULL GROUP BY 1")
def majority_vote(spark, sf):
    verdict = F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value") > 10)
    return op.majority(_events(spark, sf).select("user_id", verdict.alias("verdict")), ["user_id"])


@query(
    """WITH p AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality = 1) AS predicted, count(*) FILTER (WHERE toxic = 0) AS expected FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, tp, round(tp::DOUBLE / nullif(predicted, 0) * 1000000)::BIGINT AS precision_ppm, round(tp::DOUBLE / nullif(expected, 0) * 1000000)::BIGINT AS recall_ppm, round(2 * tp::DOUBLE / nullif(predicted + expected, 0) * 1000000)::BIGINT AS f1_ppm FROM p"""
)
def micro_f1(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    sums = rows.groupBy("lang").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("tp"), F.count_if(F.col("quality") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("e"))
    m = stats.micro_f1(F.col("tp"), F.col("p"), F.col("e"))
    return sums.select("lang", "tp", *[F.round(v * 1_000_000).cast("long").alias(f"{k}_ppm") for k, v in m.items()])


@query(
    """WITH k AS (SELECT lang, count(*) FILTER (WHERE quality = 1)::DOUBLE AS k, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, floor((k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) * 100000)::BIGINT AS low,
  floor((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) * 100000)::BIGINT AS high, floor((k / n - 2 * sqrt(k / n * (1 - k / n) / n)) * 100000)::BIGINT AS accuracy_floor FROM k"""
)
def wilson(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 1).cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    w = stats.wilson(F.col("k"), F.col("n"))
    return rows.select("lang", F.floor(w["low"] * 100_000).alias("low"), F.floor(w["high"] * 100_000).alias("high"), F.floor(stats.accuracy_floor(F.col("k") / F.col("n"), F.col("n")) * 100_000).alias("accuracy_floor"))


@query(
    """SELECT cause, count(*) AS n FROM (SELECT CASE WHEN r IS NULL THEN 'unlabelled' WHEN r = 0 THEN 'retrieval' ELSE 'generation' END AS cause FROM
  (SELECT CASE WHEN event_id % 4 = 0 THEN NULL ELSE ((props->>'$.k')::INT % 3)::DOUBLE END AS r FROM events WHERE event_type = 'error')) GROUP BY 1"""
)
def failure_breakdown(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 3
    stored = F.when(F.col("event_id") % 4 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"recall@5": '), k.cast("string"), F.lit("}")))
    return _events(spark, sf).filter("event_type = 'error'").select(op.failure_cause(stored).alias("cause")).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, (props->>'$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_extract(spark, sf):
    return _events(spark, sf).groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH l AS (SELECT user_id % 20 AS level, max(value) AS p95, count(*)::DOUBLE AS rps FROM events GROUP BY 1), w AS (SELECT *, lag(p95) OVER (ORDER BY level) AS p, lag(rps) OVER (ORDER BY level) AS t FROM l)
SELECT min(level) AS knee FROM w WHERE p95 > 1.5 * p AND rps < 1.2 * t"""
)
def knee(spark, sf):
    levels = _events(spark, sf).groupBy((F.col("user_id") % 20).alias("level")).agg(F.max("value").alias("p95"), F.count(F.lit(1)).cast("double").alias("rps"))
    return op.knee(levels, "level", "p95", "rps")


_CASES = """cases AS (SELECT event_id, user_id % 7 AS run, CASE WHEN event_type IN ('view', 'click') THEN 'numeric' ELSE 'narrative' END AS kind, value > 5 AS passed, event_type = 'error' AS errored,
  user_id % 11 = 0 AS abstained, floor(value * 1000)::BIGINT AS latency_ms FROM events)"""


def _cases(spark, sf):
    kind = F.when(F.col("event_type").isin("view", "click"), "numeric").otherwise("narrative")
    return _events(spark, sf).select(
        "event_id", (F.col("user_id") % 7).alias("run"), kind.alias("kind"), (F.col("value") > 5).alias("passed"), (F.col("event_type") == "error").alias("errored"), (F.col("user_id") % 11 == 0).alias("abstained"), F.floor(F.col("value") * 1000).alias("latency_ms")
    )


@query(
    "WITH " + _CASES + """SELECT run, count(*) AS n_cases, round(avg(passed::INT) FILTER (WHERE kind = 'numeric') * 1000000)::BIGINT AS numeric_ppm, round(avg(passed::INT) FILTER (WHERE kind = 'narrative') * 1000000)::BIGINT AS narrative_ppm,
  round(avg(abstained::INT) FILTER (WHERE kind = 'numeric' AND NOT errored) * 1000000)::BIGINT AS abstention_ppm, list_sort(list(latency_ms))[least(count(*) - 1, floor(0.95 * count(*))::BIGINT) + 1] AS p95 FROM cases GROUP BY 1"""
)
def run_summary(spark, sf):
    out = op.summarise(_cases(spark, sf), ["run"])
    ppm = lambda c, n: F.round(F.col(c) * 1_000_000).cast("long").alias(n)
    return out.select("run", "n_cases", ppm("numeric_accuracy", "numeric_ppm"), ppm("narrative_pass_rate", "narrative_ppm"), ppm("abstention_rate", "abstention_ppm"), F.col("latency_p95").alias("p95"))


@query(
    "WITH " + _CASES + """, m AS (SELECT run, 'numeric_accuracy' AS metric, avg(passed::INT) AS v FROM cases WHERE kind = 'numeric' GROUP BY 1 UNION ALL SELECT run, 'overall_score', avg(passed::INT) FROM cases GROUP BY 1)
SELECT a.metric, round((a.v - b.v) * 1000000)::BIGINT AS delta_ppm, a.v - b.v < -0.03 AS blocks FROM m a JOIN m b ON a.metric = b.metric AND a.run = 1 AND b.run = 0"""
)
def gate(spark, sf):
    s = op.summarise(_cases(spark, sf), ["run"])
    long = s.select("run", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("numeric_accuracy", "overall_score")])))
    out = op.gate(long.filter("run = 1").select("metric", "value"), long.filter("run = 0").select("metric", "value"))
    return out.select("metric", F.round(F.col("delta") * 1_000_000).cast("long").alias("delta_ppm"), "blocks")


@query(
    """WITH mid AS (SELECT 50 AS m), a AS (SELECT user_id, avg(value) > m AS passed, bool_or(event_type = 'purchase') AS truth FROM events, mid WHERE event_id % 2 = 0 GROUP BY user_id, m), b AS (SELECT user_id, avg(value) > m AS passed FROM events, mid WHERE event_id % 2 = 1 GROUP BY user_id, m)
SELECT user_id, a.passed AS was, b.passed AS now, CASE WHEN b.passed = truth THEN 'FIXED' ELSE 'REGRESSION' END AS kind FROM a JOIN b USING (user_id) WHERE a.passed <> b.passed"""
)
def verdict_flips(spark, sf):
    side = lambda k: _events(spark, sf).filter(F.col("event_id") % 2 == k).groupBy("user_id").agg((F.avg("value") > 50).alias("passed"), F.max(F.col("event_type") == "purchase").alias("truth"))
    return op.flips(side(0), side(1), "user_id", "truth").select("user_id", "was", "now", "kind")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def dedup_last_wins(spark, sf):
    return op.last_wins(_events(spark, sf).select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query(
    """WITH o AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal >= 0), n AS (SELECT c_custkey, upper(c_name) AS c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'NEW' END AS c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_name ELSE o.c_name END AS c_name, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment FROM o FULL JOIN n USING (c_custkey)"""
)
def upsert_merge(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    new = c.filter("c_mktsegment <> 'BUILDING'").drop("c_acctbal").withColumns({"c_name": F.upper("c_name"), "c_mktsegment": F.when(F.col("c_custkey") % 5 != 0, "NEW")})
    return sinks.upsert(c.filter("c_acctbal >= 0").drop("c_acctbal"), new, ["c_custkey"], keep_old=("c_mktsegment",))


@query("SELECT o_custkey, o_orderkey, 'old' AS src FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, 'new' FROM orders WHERE o_orderstatus <> 'F'")
def insert_missing(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    held, o = o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), o.drop("o_orderstatus")
    return sinks.insert_missing(held.withColumn("src", F.lit("old")), o.withColumn("src", F.lit("new")), ["o_orderkey"])


@query("WITH t AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT o_custkey, o_orderkey FROM t UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM t)")
def replace_groups(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return sinks.replace_groups(o.drop("o_orderstatus"), o.filter("o_orderstatus = 'P'").drop("o_orderstatus"), "o_custkey")


@query("SELECT coalesce(max(o_orderkey), 0) AS high_water, count(*) FILTER (WHERE o_orderkey > 5000) AS fresh FROM orders")
def high_water(spark, sf):
    o = table(spark, sf, "orders")
    return sinks.high_water(o, "o_orderkey").join(sinks.above(o, 5000, "o_orderkey").agg(F.count(F.lit(1)).alias("fresh")))


@query(
    """WITH w AS (SELECT user_id, event_id, count(*) OVER v AS n, sum((event_type = 'error')::INT) OVER v AS bad FROM events WINDOW v AS (PARTITION BY user_id ORDER BY event_id)),
x AS (SELECT *, n >= 8 AND bad > 0.25 * n AS b FROM w) SELECT user_id, event_id, bool_or(b) OVER (PARTITION BY user_id ORDER BY event_id) AS void FROM x"""
)
def void_runs(spark, sf):
    return op.running_abort(_events(spark, sf).withColumn("infra", F.col("event_type") == "error"), "user_id", "event_id", "infra").select("user_id", "event_id", "void")


@query("WITH s AS (SELECT user_id, event_id, floor(value * 100)::BIGINT AS c FROM events), w AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS running_cost FROM s) SELECT user_id, event_id, running_cost, running_cost > 5000 AS over FROM w")
def cost_ceiling(spark, sf):
    return op.cost_ceiling(_events(spark, sf).select("user_id", "event_id", F.floor(F.col("value") * 100).alias("c")), "user_id", "event_id", "c", 5000).select("user_id", "event_id", "running_cost", "over")


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 2 AS looping FROM events")
def loop_detector(spark, sf):
    return op.loops(_events(spark, sf), "user_id", "event_id", ["event_type"]).select("user_id", "event_id", "looping")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, sum(floor(value * 100)::BIGINT)::BIGINT AS total FROM events GROUP BY 1, 2")
def event_counts(spark, sf):
    from kelpie.streaming.incremental import event_counts as counts

    return counts(_events(spark, sf).withColumn("cents", F.floor(F.col("value") * 100)), "ts", "event_type", "cents")


@query(
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
SELECT 'both' AS part, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'first only', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'one of them', count(*) FROM a FULL JOIN b USING (user_id) WHERE a.user_id IS NULL OR b.user_id IS NULL"""
)
def set_operations(spark, sf):
    e = _events(spark, sf)
    a, b = (e.filter(F.col("event_type") == t).select("user_id").distinct() for t in ("purchase", "error"))
    odd = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), "user_id", "full_outer").filter("x IS NULL OR y IS NULL").select("user_id")
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, d in (("both", a.intersect(b)), ("first only", a.subtract(b)), ("one of them", odd))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SIDES = """f AS (SELECT o_orderkey % 100 AS case_id, o_orderpriority AS concept, year(o_orderdate)::INT AS fiscal_year, arg_min(round(o_totalprice)::BIGINT, o_orderkey) FILTER (WHERE o_orderstatus <> 'O') AS p,
  arg_min(round(o_totalprice)::BIGINT * 1000, o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS e FROM orders GROUP BY ALL),
m AS (SELECT *, coalesce(abs(p * 1000 - e) <= 0.005 * e OR abs(p - e) <= 0.005 * e OR abs(p * 1000000 - e) <= 0.005 * e OR abs(p * 1000000000 - e) <= 0.005 * e, false) AS hit FROM f WHERE p IS NOT NULL OR e IS NOT NULL),
c AS (SELECT case_id, count(*) FILTER (WHERE hit) AS tp, count(p) AS n_predicted, count(e) AS n_expected FROM m GROUP BY 1)"""


@query(
    "WITH " + _SIDES + """ SELECT case_id, tp, n_predicted, n_expected, round(CASE WHEN n_predicted = 0 THEN 0 ELSE tp::DOUBLE / n_predicted END * 1000000)::BIGINT AS precision_ppm,
  round(CASE WHEN n_expected = 0 THEN 0 ELSE tp::DOUBLE / n_expected END * 1000000)::BIGINT AS recall_ppm, round(2 * tp::DOUBLE / (n_predicted + n_expected) * 1000000)::BIGINT AS f1_ppm, tp = n_predicted AND tp = n_expected AS exact FROM c"""
)
def extraction_keys(spark, sf):
    v = F.round("o_totalprice").cast("long")
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % 100).alias("case_id"), F.col("o_orderpriority").alias("concept"), F.year("o_orderdate").alias("fiscal_year"), v.alias("value"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    out = op.score_extraction(o.filter("o_orderstatus <> 'O'"), o.filter("o_orderstatus <> 'F'").withColumn("value", F.col("value") * 1000))
    ppm = lambda c: F.round(F.col(c) * 1_000_000).cast("long").alias(f"{c}_ppm")
    return out.select("case_id", "tp", "n_predicted", "n_expected", ppm("precision"), ppm("recall"), ppm("f1"), "exact")


_EDGES = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
_LANES = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT / 4294967296.0::DOUBLE AS u{i}" for i in range(4))
_WEIGHT = lambda i: "(" + " + ".join(f"(u{i} >= {e}::DOUBLE)::INT" for e in _EDGES) + ")"


@query(
    f"""WITH r AS (SELECT doc_id, (quality - toxic)::DOUBLE AS d FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
h AS (SELECT d, b, md5(doc_id::VARCHAR || ':' || b::VARCHAR || ':0') AS h FROM r, (SELECT unnest(range(50)) AS b)), u AS (SELECT d, b, {_LANES} FROM h),
m AS ({' UNION ALL '.join(f"SELECT b * 4 + {i} AS draw, sum({_WEIGHT(i)} * d) / sum({_WEIGHT(i)}) AS m FROM u GROUP BY b" for i in range(4))}),
s AS (SELECT list_sort(list(m)) AS ms FROM m)
SELECT round((SELECT avg(d) FROM r) * 1000000)::BIGINT AS delta_ppm, (SELECT count(*) FROM r) AS n, round(ms[6] * 1000000)::BIGINT AS low_ppm, round(ms[195] * 1000000)::BIGINT AS high_ppm FROM s"""
)
def bootstrap_ci(spark, sf):
    out = stats.paired_bootstrap(table(spark, sf, "labels"), "doc_id", "quality", "toxic", draws=200)
    ppm = lambda c: F.round(F.col(c) * 1_000_000).cast("long").alias(f"{c}_ppm")
    return out.select(ppm("delta"), "n", ppm("low"), ppm("high"))


_SAID = lambda c: f"coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


@query(
    f"""WITH d AS (SELECT md5({_SAID('item_id')} || ';' || {_SAID('text')}) AS d FROM benchmark),
s AS (SELECT count(*) AS n_cases, coalesce(sum(('0x' || substr(d, 1, 15))::BIGINT), 0)::VARCHAR AS a, coalesce(sum(('0x' || substr(d, 17, 15))::BIGINT), 0)::VARCHAR AS b FROM d)
SELECT n_cases, substr(md5(n_cases::VARCHAR || '/' || a || '/' || b), 1, 16) AS digest FROM s"""
)
def exam_fingerprint(spark, sf):
    return op.fingerprint(table(spark, sf, "benchmark"), ["item_id", "text"])


_CALLS = """a AS (SELECT event_type AS arm, event_id AS case_id, value > 40 AS passed, user_id % 3 = 0 AS strong, CASE WHEN value < 5 THEN 'abstained' ELSE 'answered' END AS outcome, CASE WHEN user_id % 2 = 0 THEN 'single_hop' ELSE 'comparative' END AS difficulty FROM events),
k AS (SELECT event_type AS arm, event_id AS case_id, user_id * 10 AS prompt_tokens, user_id AS completion_tokens, user_id * 3 AS cached_tokens, user_id * 0.5 AS cost_usd, floor(value * 100)::BIGINT AS latency_ms FROM events)"""


def _arms(spark, sf):
    e = _events(spark, sf)
    answers = e.select(
        F.col("event_type").alias("arm"), F.col("event_id").alias("case_id"), (F.col("value") > 40).alias("passed"), (F.col("user_id") % 3 == 0).alias("strong"),
        F.when(F.col("value") < 5, "abstained").otherwise("answered").alias("outcome"), F.when(F.col("user_id") % 2 == 0, "single_hop").otherwise("comparative").alias("difficulty"),
    )
    u = F.col("user_id")
    calls = e.select(F.col("event_type").alias("arm"), F.col("event_id").alias("case_id"), (u * 10).alias("prompt_tokens"), u.alias("completion_tokens"), (u * 3).alias("cached_tokens"), (u * 0.5).alias("cost_usd"), F.floor(F.col("value") * 100).alias("latency_ms"))
    return answers, calls


@query(
    "WITH " + _CALLS + """, s AS (SELECT arm, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(cost_usd)::DOUBLE AS cost, list_sort(list(latency_ms)) AS xs FROM k GROUP BY 1),
q AS (SELECT arm, count(*) AS n, count(*) FILTER (WHERE passed) AS correct, count(*) FILTER (WHERE outcome = 'abstained') AS abstained, avg(strong::INT) AS strong FROM a GROUP BY 1)
SELECT arm, n, correct, abstained, calls, prompt_tokens, round(strong * 1000000)::BIGINT AS strong_ppm, round(cost / n * 1000)::BIGINT AS cost_per_1k, xs[least(calls - 1, floor(0.95 * calls)::BIGINT) + 1] AS latency_p95 FROM q JOIN s USING (arm)"""
)
def arm_summary(spark, sf):
    out = op.arm_summary(*_arms(spark, sf))
    return out.select("arm", "n", "correct", "abstained", "calls", "prompt_tokens", F.round(F.col("strong_share") * 1_000_000).cast("long").alias("strong_ppm"), F.round("cost_per_1k").cast("long").alias("cost_per_1k"), "latency_p95")


@query("WITH " + _CALLS + " SELECT arm, difficulty, count(*) AS n, count(*) FILTER (WHERE passed) AS correct, floor(count(*) FILTER (WHERE passed)::DOUBLE / count(*) * 1000000)::BIGINT AS accuracy_ppm FROM a GROUP BY 1, 2")
def arm_accuracy(spark, sf):
    return op.accuracy_by(_arms(spark, sf)[0], ["difficulty"]).select("arm", "difficulty", "n", "correct", F.floor(F.col("accuracy") * 1_000_000).alias("accuracy_ppm"))


@query(
    """WITH r AS (SELECT user_id % 4 AS level, event_id * 10 AS started, floor(value * 100)::BIGINT AS ms, event_type <> 'error' AS ok FROM events),
s AS (SELECT level, count(*) AS requests, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, max(started + ms) - min(started) AS span, max(ms) FILTER (WHERE ok) AS most, list_sort(list(ms) FILTER (WHERE ok)) AS xs FROM r GROUP BY 1)
SELECT level, requests, succeeded, failed, most, xs[least(succeeded - 1, floor(0.5 * succeeded)::BIGINT) + 1] AS p50, xs[least(succeeded - 1, floor(0.99 * succeeded)::BIGINT) + 1] AS p99,
  floor(succeeded / (span / 1000.0::DOUBLE) * 1000)::BIGINT AS per_1000_s FROM s"""
)
def load_summary(spark, sf):
    rows = _events(spark, sf).select((F.col("user_id") % 4).alias("level"), (F.col("event_id") * 10).alias("started"), F.floor(F.col("value") * 100).alias("ms"), (F.col("event_type") != "error").alias("ok"))
    out = op.load_summary(rows, usd_per_hour=1.2)
    return out.select("level", "requests", "succeeded", "failed", "most", "p50", "p99", F.floor(F.col("per_second") * 1000).alias("per_1000_s"))


@query(
    """WITH v AS (SELECT event_id AS case_id, user_id % 2 = 0 AS truth, CASE WHEN event_type = 'error' THEN NULL ELSE value > 50 END AS cand, value > 30 AS base FROM events),
m AS (SELECT count(*) FILTER (WHERE truth AND cand) AS tp, count(*) FILTER (WHERE NOT truth AND cand) AS fp, count(*) FILTER (WHERE truth AND NOT cand) AS fn, count(*) FILTER (WHERE NOT truth AND NOT cand) AS tn,
  count(*) FILTER (WHERE truth AND base) AS btp, count(*) FILTER (WHERE NOT truth AND base) AS bfp, count(*) FILTER (WHERE truth AND NOT base) AS bfn, count(*) FILTER (WHERE NOT truth AND NOT base) AS btn,
  count(*) FILTER (WHERE truth AND NOT cand AND base) AS fresh, count(*) FILTER (WHERE case_id IN (3, 4) AND cand) AS named, count(*) FILTER (WHERE case_id = 5 AND NOT cand) AS unnamed FROM v),
k AS (SELECT *, ((tp + tn) / (tp + fp + fn + tn)::DOUBLE - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (tp + fp + fn + tn)::DOUBLE ** 2) / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (tp + fp + fn + tn)::DOUBLE ** 2) AS kappa,
  ((btp + btn) / (btp + bfp + bfn + btn)::DOUBLE - ((btp + bfp) * (btp + bfn) + (btn + bfn) * (btn + bfp)) / (btp + bfp + bfn + btn)::DOUBLE ** 2) / (1 - ((btp + bfp) * (btp + bfn) + (btn + bfn) * (btn + bfp)) / (btp + bfp + bfn + btn)::DOUBLE ** 2) AS bkappa FROM m)
SELECT 'no new false fails' AS clause, fresh = 0 AS passed FROM k UNION ALL SELECT 'few false passes', fp <= 4 FROM k UNION ALL SELECT 'named cases pass', named = 2 FROM k UNION ALL SELECT 'named cases fail', unnamed = 1 FROM k
UNION ALL SELECT 'kappa floor', kappa >= 0.6 FROM k UNION ALL SELECT 'gain beats noise', kappa - bkappa > 0.01 FROM k"""
)
def judge_adoption(spark, sf):
    e = _events(spark, sf).select(F.col("event_id").alias("case_id"), (F.col("user_id") % 2 == 0).alias("truth"), "event_type", "value")
    cand = e.select("case_id", "truth", F.when(F.col("event_type") != "error", F.col("value") > 50).alias("said"))
    return op.adoption(cand, e.select("case_id", "truth", (F.col("value") > 30).alias("said")), (3, 4), (5,), 0.01)


@query("SELECT event_id, regexp_matches(m, '(?i)429 Too Many Requests|Timeout') AS infra FROM (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'HTTP 429 too many requests' WHEN 1 THEN 'read timeout' WHEN 2 THEN 'wrong answer' END AS m FROM events) WHERE m IS NOT NULL UNION ALL SELECT event_id, false FROM events WHERE user_id % 4 = 3")
def infra_errors(spark, sf):
    u = F.col("user_id") % 4
    said = F.when(u == 0, "HTTP 429 too many requests").when(u == 1, "read timeout").when(u == 2, "wrong answer")
    return _events(spark, sf).select("event_id", op.is_infrastructure(said).alias("infra"))


@query(
    """WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'num-AB-Net-' || c_custkey WHEN 1 THEN 'nar-a1-x' ELSE 'odd' END AS id FROM customer), p AS (SELECT *, string_split(id, '-') AS ps FROM c)
SELECT c_custkey, ps[1] AS kind, coalesce(ps[2], 'unknown') AS ticker, CASE WHEN len(ps) >= 3 AND regexp_full_match(ps[2], '[A-Z]+') THEN ps[2] ELSE '?' END AS subject, CASE WHEN len(ps) >= 3 THEN array_to_string(ps[3:], '-') ELSE 'unknown' END AS topic FROM p"""
)
def case_ids(spark, sf):
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, F.concat(F.lit("num-AB-Net-"), k.cast("string"))).when(k % 3 == 1, "nar-a1-x").otherwise("odd")
    return table(spark, sf, "customer").select("c_custkey", op.case_parts(said).alias("p")).select("c_custkey", "p.*")


@query(
    """WITH v AS (SELECT o_orderkey, round(o_totalprice)::BIGINT AS v FROM orders)
SELECT o_orderkey, CASE WHEN v >= 1000 THEN o_orderkey % 2 = 0 END AS shown FROM v"""
)
def figures_in_context(spark, sf):
    v = F.round("o_totalprice").cast("long")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("in all "), F.format_number(v, 0))).otherwise("nothing of the kind")
    needles = F.array(F.array(F.format_number(v, 0), F.lit("12")))
    return table(spark, sf, "orders").select("o_orderkey", op.figures_in_context(needles, said).alias("shown"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN user_id * 15 WHEN 'click' THEN user_id * 250 ELSE 0 END AS cent_millionths FROM events")
def token_costs(spark, sf):
    price = F.when(F.col("event_type") == "view", 0.15).when(F.col("event_type") == "click", 2.5).otherwise(0.0)
    return _events(spark, sf).select("event_id", F.round(op.token_cost(F.col("user_id"), F.lit(0), price, F.lit(0.0)) * 100_000_000).cast("long").alias("cent_millionths"))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 1")
def latest_run(spark, sf):
    return op.latest(_events(spark, sf), "ts", "event_id").select("event_id", "event_type")
