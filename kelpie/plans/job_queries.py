"""Queries over readers, jobs, training sets, logs and text screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie import api, jobs
from kelpie.functions import text
from kelpie.operators import context, extraction, facts, golden, html, retrieval, sampling, training
from kelpie.sources import sinks, tables
from kelpie.streaming import incremental

from .registry import query, table


@query("SELECT upper(c_name) AS ticker, lpad(c_custkey::VARCHAR, 10, '0') AS cik, c_mktsegment AS title FROM customer")
def ticker_map(spark, sf):
    each = F.struct(F.col("c_custkey").alias("cik_str"), F.lower("c_name").alias("ticker"), F.col("c_mktsegment").alias("title"))
    raw = table(spark, sf, "customer").select(F.to_json(F.create_map(F.col("c_custkey").cast("string"), each)).alias("json"))
    return tables.tickers(raw)


@query(
    """WITH r AS (SELECT o_custkey::VARCHAR AS cik, o_orderkey, o_orderstatus, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderkey) AS n FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT cik, o_orderkey::VARCHAR AS accession, o_orderstatus AS form, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE END AS filing_date FROM r WHERE n <= 4"""
)
def filing_index(spark, sf):
    """Columnar blocks per company: the recent page of even orders, an overflow page of odd ones; every third date is malformed."""
    o = table(spark, sf, "orders").withColumn("page", (F.col("o_orderkey") % 2).cast("int"))
    date = F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("n/a")).otherwise(F.col("o_orderdate").cast("date").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderstatus").alias("form"), date.alias("date"))))
    blocks = o.groupBy(F.col("o_custkey").cast("string").alias("cik"), "page").agg(rows.alias("r"))
    pick = lambda f: F.transform("r", f)
    block = F.struct(
        pick(lambda x: x["o_orderkey"].cast("string")).alias("accessionNumber"), pick(lambda x: x["form"]).alias("form"), pick(lambda x: x["date"]).alias("filingDate"),
        pick(lambda x: F.lit("")).alias("reportDate"), pick(lambda x: F.lit("d")).alias("primaryDocument"),
    )
    raw = blocks.select("cik", "page", F.to_json(block).alias("json"))
    return tables.filing_rows(raw, ["F", "O"], 4).select("cik", "accession", "form", "filing_date")


_ENTRIES = """e AS (SELECT o_custkey::VARCHAR AS cik, CASE WHEN o_orderkey % 4 = 0 THEN 'Assets' ELSE 'Revenues' END AS tag, year(o_orderdate) AS fy, CASE WHEN o_orderstatus = 'F' THEN '10-K' ELSE '10-Q' END AS form,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate::DATE END AS s, (o_orderdate::DATE + CASE WHEN o_orderkey % 3 = 0 THEN 90 ELSE 364 END)::DATE AS d, o_orderkey AS accn FROM orders),
k AS (SELECT * FROM e WHERE form = '10-K' AND (s IS NULL OR d - s BETWEEN 340 AND 380)), ends AS (SELECT DISTINCT cik, d FROM k WHERE s IS NOT NULL)"""


def _company_facts(spark, sf):
    k = F.col("o_orderkey")
    end = F.date_add(F.col("o_orderdate").cast("date"), F.when(k % 3 == 0, 90).otherwise(364))
    entry = F.struct(
        F.year("o_orderdate").alias("fy"), F.lit("FY").alias("fp"), F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-Q").alias("form"), F.round("o_totalprice").cast("long").alias("val"),
        F.when(k % 4 != 0, F.col("o_orderdate").cast("date").cast("string")).alias("start"), end.cast("string").alias("end"), k.cast("string").alias("accn"),
    )
    tagged = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("cik"), F.when(k % 4 == 0, "Assets").otherwise("Revenues").alias("tag")).agg(F.collect_list(entry).alias("es"))
    tags = F.map_from_entries(F.collect_list(F.struct("tag", F.struct(F.create_map(F.lit("USD"), F.col("es")).alias("units")))))
    return tagged.groupBy("cik").agg(tags.alias("m")).select("cik", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), F.col("m")).alias("facts"))).alias("json"))


@query(
    "WITH " + _ENTRIES + """ SELECT cik, tag, accn::VARCHAR AS accession, (year(d) - (month(d) = 1 AND day(d) <= 7)::INT)::INT AS fiscal_year FROM k
WHERE s IS NOT NULL OR (cik, d) IN (SELECT cik, d FROM ends) OR cik NOT IN (SELECT cik FROM ends)"""
)
def annual_facts(spark, sf):
    return facts.annual(facts.exploded(_company_facts(spark, sf)), ["10-K"]).select("cik", "tag", "accession", "fiscal_year")


@query(
    "WITH " + _ENTRIES + """, a AS (SELECT cik, tag, accn, (year(d) - (month(d) = 1 AND day(d) <= 7)::INT)::INT AS fiscal_year FROM k WHERE s IS NOT NULL OR (cik, d) IN (SELECT cik, d FROM ends) OR cik NOT IN (SELECT cik FROM ends))
SELECT cik, tag, fiscal_year, min(accn::VARCHAR) AS accession FROM a GROUP BY 1, 2, 3"""
)
def derived_facts(spark, sf):
    return jobs.derived_facts(facts.exploded(_company_facts(spark, sf)), ["10-K"]).select("cik", "tag", "fiscal_year", "accession")


@query(
    r"""WITH f AS (SELECT doc_id % 40 AS filing_id, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1),
c AS (SELECT filing_id, i AS ordinal, trim(substr(text, i * 1792 + 1, 2048), E' \t\n\r\x0b\x0c') AS body FROM (SELECT filing_id, text, unnest(range(0, greatest(0, ceil((length(text) - 2048) / 1792.0))::BIGINT + 1))::INT AS i FROM f))
SELECT filing_id, 'fixed-512' AS strategy, ordinal, greatest(1, length(body) // 4)::INT AS token_est, md5(body) AS digest FROM c WHERE body <> ''"""
)
def index_build(spark, sf):
    sections = table(spark, sf, "documents").select((F.col("doc_id") % 40).alias("filing_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("ordinal"), F.lit(None).cast("string").alias("item"), F.lit(None).cast("string").alias("title"), F.col("text").alias("body"))
    return jobs.built_chunks(sections.filter("body IS NOT NULL"), "fixed", label="fixed-512").select("filing_id", "strategy", "ordinal", "token_est", F.md5("body").alias("digest"))


@query("SELECT o_custkey % 9 AS filing_id, o_orderpriority AS strategy, max(o_orderkey) AS id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F' GROUP BY 1, 2 UNION ALL SELECT o_custkey % 9, o_orderpriority, o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def index_rows(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 9).alias("filing_id"), F.col("o_orderpriority").alias("strategy"), F.lit(0).alias("ordinal"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    new = o.filter("strategy IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'").drop("o_orderstatus")
    return jobs.index_rows(o.drop("o_orderstatus"), new).select("filing_id", "strategy", "id")


@query("SELECT o_orderkey, ('0x' || substr(md5(o_custkey::VARCHAR || '|' || o_orderkey::VARCHAR), 1, 15))::BIGINT AS id FROM orders")
def stable_ids(spark, sf):
    return jobs.with_ids(table(spark, sf, "orders"), ["o_custkey", "o_orderkey"]).select("o_orderkey", "id")


@query("SELECT lang IS NULL AS held_out, count(*) AS examples, count(*) FILTER (WHERE doc_id % 3 = 0) AS positives, count(*) FILTER (WHERE doc_id % 3 <> 0) AS negatives, sum((doc_id % 3 = 0)::INT)::BIGINT AS facts, count(DISTINCT source) AS companies, count(DISTINCT doc_id % 50) AS accessions FROM documents GROUP BY 1")
def dataset_manifest(spark, sf):
    fact = F.struct(F.lit("net income").alias("concept"), F.lit(2023).alias("fiscal_year"), F.lit(1.0).alias("value"))
    rows = table(spark, sf, "documents").select(
        F.isnull("lang").alias("held_out"), F.col("doc_id").alias("passage_id"), F.col("source").alias("ticker"), (F.col("doc_id") % 50).alias("accession"), F.col("text").alias("body"),
        F.when(F.col("doc_id") % 3 == 0, F.array(fact)).otherwise(F.array().cast(extraction.FACTS)).alias("labels"),
    )
    return training.manifest(rows).drop("digest")


_DRAWN = "row_number() OVER (ORDER BY md5({key} || '29'), {key})::INT AS n"


@query(
    f"""WITH f AS (SELECT doc_id, doc_id::VARCHAR || '|net income|' || y::VARCHAR || '|1.0' AS key, y FROM documents, (SELECT unnest([2022, 2023]) AS y) WHERE doc_id % 3 = 0),
l AS (SELECT doc_id, y, {_DRAWN.format(key='key')} FROM f), m AS (SELECT doc_id, {_DRAWN.format(key='doc_id::VARCHAR')} FROM documents WHERE doc_id % 3 <> 0)
SELECT 'label' AS kind, n, doc_id, y::INT AS fiscal_year FROM l WHERE n <= 50 UNION ALL SELECT 'negative', n, doc_id, NULL FROM m WHERE n <= 10"""
)
def audit_sample(spark, sf):
    one = lambda y: F.struct(F.lit("net income").alias("concept"), F.lit(y).alias("fiscal_year"), F.lit(1.0).alias("value"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("passage_id"), F.col("source").alias("ticker"), F.when(F.col("doc_id") % 3 == 0, F.array(one(2022), one(2023))).otherwise(F.array().cast(extraction.FACTS)).alias("labels"))
    rows = rows.withColumn("passage_id", F.col("passage_id").cast("string"))
    return training.audit_sample(rows).select("kind", "n", F.col("passage_id").cast("long").alias("doc_id"), "fiscal_year")


@query("SELECT case_id, passed FROM (SELECT event_id AS case_id, value > 50 AS passed, row_number() OVER (PARTITION BY value > 50 ORDER BY md5(event_id::VARCHAR || '5'), event_id) AS n FROM events WHERE event_type <> 'error') WHERE n <= 20")
def label_sample(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("case_id"), F.when(F.col("event_type") != "error", F.col("value") > 50).alias("passed"))
    return training.label_sample(rows).select("case_id", "passed")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type <> 'error' AND user_id % 2 = 0)")
def pending_work(spark, sf):
    e = table(spark, sf, "events")
    done = e.filter("user_id % 2 = 0").select("event_id", F.when(F.col("event_type") == "error", "boom").alias("error"))
    return incremental.pending(e.select("event_id"), done, "event_id")


@query(
    """WITH RECURSIVE r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, true AS allowed, [event_id] AS held FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.event_id, r.n, len(list_filter(f.held, lambda h: r.event_id - h < 300)) < 2,
    CASE WHEN len(list_filter(f.held, lambda h: r.event_id - h < 300)) < 2 THEN list_append(list_filter(f.held, lambda h: r.event_id - h < 300), r.event_id) ELSE list_filter(f.held, lambda h: r.event_id - h < 300) END
  FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
SELECT user_id, event_id, allowed FROM f"""
)
def rate_limit(spark, sf):
    return incremental.rate_limited(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", 2, 300.0)


@query(
    r"""SELECT doc_id, regexp_matches(text, '(?i)ignore') OR regexp_matches(text, '(?i)\bthe\b') AS flagged, length(regexp_replace(regexp_replace(text, '(?i)ignore', '[quoted document text: \0]', 'g'), '(?i)\bthe\b', '[quoted document text: \0]', 'g')) > 500 AS cut FROM documents"""
)
def neutralised(spark, sf):
    out = text.neutralise(F.col("text"), ["(?i)ignore", r"(?i)\bthe\b"], 500)
    return table(spark, sf, "documents").select("doc_id", out.alias("o")).select("doc_id", "o.flagged", F.col("o.text").endswith("[truncated]").alias("cut"))


@query("SELECT o_custkey, len(list_filter(list(o_orderkey), lambda x: x % 7 = 0)) = len(list(o_orderkey)) AS ok FROM orders GROUP BY 1")
def citations(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("cited"), F.collect_list(F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey"))).alias("there"))
    return o.select("o_custkey", text.citations_ok(F.col("cited"), F.col("there")).alias("ok"))


@query("SELECT doc_id, '[' || doc_id::VARCHAR || '] ' || coalesce(lang, source) || ' FY' || CASE WHEN doc_id % 2 = 0 THEN '2023' ELSE '?' END || CASE WHEN doc_id % 3 = 0 THEN ' Item 7' ELSE '' END || chr(10) || text AS block FROM documents")
def block_texts(spark, sf):
    k = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id", retrieval.block_text(k, F.col("lang"), F.col("source"), F.when(k % 2 == 0, 2023), F.when(k % 3 == 0, "7"), F.col("text")).alias("block")
    )


@query()
def parse_health(spark, sf):
    return html.health(html.with_text(table(spark, sf, "pages")).select("page_id", "body"), ["page_id"])


@query(
    """WITH o AS (SELECT o_orderkey, round(o_totalprice)::BIGINT AS v FROM orders),
k AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'right' WHEN 1 THEN 'wrong_value' WHEN 2 THEN 'wrong_year' ELSE 'not_in_passage' END AS kind FROM o)
SELECT kind = 'right' AS fine, count(*) AS cases, count(*) FILTER (WHERE kind = 'wrong_value') AS wrong_value, count(*) FILTER (WHERE kind = 'wrong_year') AS wrong_year, count(*) FILTER (WHERE kind = 'not_in_passage') AS not_in_passage, count(*) FILTER (WHERE kind <> 'right') AS missed FROM k GROUP BY 1"""
)
def extraction_diagnosis(spark, sf):
    k, v = F.col("o_orderkey"), F.round("o_totalprice")
    fact = lambda concept, year, value: F.struct(F.lit(concept).alias("concept"), year.cast("int").alias("fiscal_year"), value.cast("double").alias("value"))
    said = F.when(k % 4 == 1, v * 1.5).when(k % 4 == 3, v * 7.77).otherwise(v)
    cases = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.lit("no figure at all").alias("passage"), F.array(fact("net income", F.when(k % 4 >= 2, 2022).otherwise(2023), said)).alias("predicted"),
        F.array(fact("net income", F.lit(2023), v)).alias("expected"), F.lit(0).alias("invalid"),
    )
    out = extraction.diagnose(cases)
    sums = [F.sum(c).alias(c) for c in ("wrong_value", "wrong_year", "not_in_passage", "missed")]
    return out.groupBy(((F.col("missed") + F.col("wrong_value")) == 0).alias("fine")).agg(F.count(F.lit(1)).alias("cases"), *sums)


@query(
    """WITH o AS (SELECT o_orderkey % 200 AS case_id, round(o_totalprice)::BIGINT AS v, o_orderkey FROM orders), f AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS hit FROM o GROUP BY 1)
SELECT case_id, hit AS tp, n AS n_predicted, n AS n_expected FROM f"""
)
def extraction_scores(spark, sf):
    k, v = F.col("o_orderkey"), F.round("o_totalprice").cast("double")
    fact = lambda value: F.collect_list(F.struct(F.lit("net income").alias("concept"), k.cast("int").alias("fiscal_year"), value.alias("value")))
    cases = table(spark, sf, "orders").groupBy((k % 200).alias("case_id")).agg(fact(F.when(k % 3 == 0, v).otherwise(v * 1.5)).alias("predicted"), fact(v).alias("expected"))
    out = extraction.scored(cases.withColumn("invalid", F.lit(0)))
    return out.select("case_id", *[F.col(c).cast("long").alias(c) for c in ("tp", "n_predicted", "n_expected")])


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def held_rows(spark, sf):
    return api.status({n: table(spark, sf, n) for n in ("orders", "nation")})


@query("SELECT item_id, 'Question: ' || text || chr(10) || 'Reference: r' || chr(10) || 'Candidate: ' || chr(10) || 'Does the candidate agree with the reference? Answer PASS or FAIL.' AS prompt FROM benchmark")
def judge_prompts(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", api.judge_prompt("v1", F.col("text"), F.lit("r"), F.lit(None).cast("string")).alias("prompt"))


@query()
def diverse_sample(spark, sf):
    """Greedy order of a bounded, seeded draw: the operator works on a few rows at the driver."""
    e = sampling.superset_stable(table(spark, sf, "events"), "event_id", 200, "3")
    rows = [r.asDict() for r in e.select(F.col("event_id").alias("case_id"), F.col("event_type").alias("kind"), F.col("user_id").alias("ticker")).collect()]
    return spark.createDataFrame([(i, r["case_id"], r["kind"], r["ticker"]) for i, r in enumerate(sampling.diverse_order(rows, 40))], "turn int, case_id long, kind string, ticker long")


@query(
    """WITH c AS (SELECT o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 1000 AND (o_orderstatus = 'F' OR true))
SELECT o_orderstatus AS status, count(*) AS n, min(k) AS least FROM (SELECT o_orderstatus, o_custkey % 7 AS k FROM c WHERE o_custkey <> 3) d GROUP BY 1"""
)
def sql_scan(spark, sf):
    """A parameterised statement with a named CTE, a derived table and ordinals."""
    table(spark, sf, "orders").createOrReplaceTempView("kelpie_orders")
    return tables.sql(
        spark,
        """WITH c AS (SELECT o_custkey, o_orderstatus, o_totalprice FROM kelpie_orders WHERE o_totalprice > :least AND (:status IS NULL OR o_orderstatus = :status))
        SELECT o_orderstatus AS status, count(*) AS n, min(k) AS least FROM (SELECT o_orderstatus, o_custkey % 7 AS k FROM c WHERE o_custkey <> :not_this) d GROUP BY 1 ORDER BY 1""",
        {"least": 1000, "status": None, "not_this": 3},
    )


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7")
def optional_filters(spark, sf):
    """Filters that are given hold; none, 0 and an empty text are no filter."""
    given = {"o_orderstatus": "F", "o_custkey": 7, "o_orderpriority": "", "o_shippriority": 0, "o_clerk": None}
    o = table(spark, sf, "orders")
    for c, v in given.items():
        o = o.filter(facts.optional(c, v))
    return o.select("o_orderkey")


@query("SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey::VARCHAR || '}' AS body FROM nation")
def json_encode(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", tables.jsonb("n_name", "n_regionkey").alias("body"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def shared_columns(spark, sf):
    return sinks.shared_columns(table(spark, sf, "customer"), ["c_name", "c_custkey", "generated"], F.col("c_acctbal") > 0).select("c_custkey", "c_name")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 2 = 0) AS embedded, coalesce(max(length(text) // 4), 0)::INT AS most_tokens, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE source = 'src1'")
def index_shape(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("strategy"), F.floor(F.length("text") / 4).cast("int").alias("token_est"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1.0))).alias("embedding"))
    return context.index_shape(rows, "src1")


@query(
    """WITH a AS (SELECT user_id, avg(value) > 50 AS p FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, avg(value) > 50 AS p FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (WHERE a.p AND b.p) AS kept, count(*) FILTER (WHERE NOT a.p AND b.p) AS fixed, count(*) FILTER (WHERE a.p AND NOT b.p) AS broken, count(*) FILTER (WHERE NOT a.p AND NOT b.p) AS failing FROM a JOIN b USING (user_id)"""
)
def run_transitions(spark, sf):
    side = lambda k: table(spark, sf, "events").filter(F.col("event_id") % 2 == k).groupBy("user_id").agg((F.avg("value") > 50).alias("passed"))
    return context.transitions(side(0), side(1), "user_id")


@query(
    """WITH h AS (SELECT item_id AS case_id, substr(sha256(text), 1, 12) AS answer_hash, true AS human_label, 'a' AS labeller FROM benchmark WHERE item_id % 2 = 0),
n AS (SELECT item_id AS case_id, substr(sha256(text), 1, 12) AS answer_hash, item_id % 3 = 0 AS human_label, 'b' AS labeller FROM benchmark WHERE item_id % 5 <> 0)
SELECT case_id, answer_hash, coalesce(n.human_label, h.human_label) AS human_label, coalesce(n.labeller, h.labeller) AS labeller FROM h FULL JOIN n USING (case_id, answer_hash)"""
)
def human_labels(spark, sf):
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), text.answer_hash(F.col("text")).alias("answer_hash"))
    held = rows.filter("case_id % 2 = 0").withColumn("human_label", F.lit(True)).withColumn("labeller", F.lit("a"))
    return sinks.upsert(held, rows.filter("case_id % 5 <> 0").withColumn("human_label", F.col("case_id") % 3 == 0).withColumn("labeller", F.lit("b")), ["case_id", "answer_hash"])


@query(
    """WITH g AS (SELECT n_nationkey AS cik, n_name, r_regionkey, 'nar-' || n_name || '-' || lower(r_name) AS case_id, lower(r_name) AS topic FROM nation, region),
s AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY md5(case_id || '7'), case_id) AS n FROM g)
SELECT case_id, 'How does ' || n_name || ' see ' || topic || ' in FY2023?' AS question, CASE WHEN case_id LIKE '%asia' THEN 'known' END AS expected FROM s WHERE n <= 3"""
)
def narrative_cases(spark, sf):
    companies = table(spark, sf, "nation").select(F.col("n_nationkey").alias("cik"), F.col("n_name").alias("ticker"), F.col("n_name").alias("name"), F.lit(2023).alias("fiscal_year"))
    topic = F.lower("r_name")
    seeds = table(spark, sf, "region").select(topic.alias("topic"), F.lit("7").alias("item"), F.concat(F.lit("How does {name} see "), topic, F.lit(" in FY{year}?")).alias("template"))
    references = companies.select(F.concat(F.lit("nar-"), "ticker", F.lit("-asia")).alias("case_id"), F.lit("known").alias("reference"))
    return golden.narrative_cases(companies, seeds, references).select("case_id", "question", "expected")
