"""Evaluation queries over projections of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywick.functions.text import backoff, excerpt, finish
from tallywick.operators import evaluation as op
from tallywick.plans.registry import query, table


@query("ratio_bootstrap")
def ratio_bootstrap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    groups = docs.groupBy("source").agg(F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("total"))
    return op.ratio_bootstrap(groups, "source", "hits", "total", draws=1000)


_LOAD = """WITH s AS (SELECT event_type AS layer, user_id % 3 AS rps, (event_id // 2) % 4 AS run, CASE WHEN event_id % 2 = 0 THEN 'proxy' ELSE 'mock' END AS target, value AS ms, NOT (user_id % 3 = 2 AND (event_id // 2) % 4 < 2 AND event_id % 40 < 8) AS ok FROM events),
g AS (SELECT layer, rps, run, target, list_sort(list(ms) FILTER (ok)) AS v, avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END) AS lost FROM s GROUP BY 1, 2, 3, 4),
q AS (SELECT *, v[1 + CAST(round_even(0.95 * (len(v) - 1), 0) AS BIGINT)] AS p FROM g WHERE len(v) > 0),
r AS (SELECT a.layer, a.rps, a.run, a.p - b.p AS d, a.lost < 0.01 AND b.lost < 0.01 AS clean FROM q a JOIN q b USING (layer, rps, run) WHERE a.target = 'proxy' AND b.target = 'mock')
SELECT layer, rps, count(*) AS runs, count(*) FILTER (clean) AS clean, round(avg(d) FILTER (clean), 6) AS overhead_ms, CASE WHEN count(*) FILTER (clean) = 0 THEN 'shedding' WHEN count(*) FILTER (clean) < count(*) THEN 'partly' ELSE 'clean' END AS kind FROM r GROUP BY 1, 2"""


@query("load_cells", _LOAD)
def load_cells(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    run = F.expr("(event_id div 2) % 4")
    ok = ~((F.col("user_id") % 3 == 2) & (run < 2) & (F.col("event_id") % 40 < 8))
    return op.load_cells(e.select(F.col("event_type").alias("layer"), (F.col("user_id") % 3).alias("rps"), run.alias("run"), F.when(F.col("event_id") % 2 == 0, "proxy").otherwise("mock").alias("target"), F.col("value").alias("ms"), ok.alias("ok")))


_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


@query("seal_plan", f"""SELECT CAST(event_id AS VARCHAR) AS call_uid FROM events WHERE (event_id % 3 <> 0 OR event_id % 12 = 0) AND (event_id % 5 <> 0 OR ts <= {_NOW} - INTERVAL 24 HOURS)""")
def seal_plan(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").cast("string").alias("call_uid"), F.col("event_type").alias("body"), F.when(F.col("event_id") % 5 == 0, "in_flight").alias("error_type"), F.col("ts").cast("timestamp").alias("ts"))
    sealed = e.filter("event_id % 3 = 0").select(F.col("event_id").cast("string").alias("call_uid"), F.when(F.col("event_id") % 12 == 0, "older").otherwise(F.col("event_type")).alias("body"), F.lit(1).alias("seq"))
    return op.to_seal(rows, sealed, F.expr(_NOW)).select("call_uid")


@query("batch_results", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'batch_missing' WHEN event_id % 11 = 0 THEN 'batch_expired' END AS error_type, CASE WHEN event_id % 7 <> 0 THEN event_id % 300 END AS output_tokens FROM events WHERE event_id % 2 = 0""")
def batch_results(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("call_uid"))
    results = e.filter("event_id % 7 <> 0").select(F.col("call_uid").alias("custom_id"), F.when(F.col("event_id") % 11 == 0, "expired").otherwise("succeeded").alias("outcome"), (F.col("event_id") % 300).alias("output_tokens"))
    return op.apply_batch(e.filter("event_id % 2 = 0"), results).select("event_id", "error_type", "output_tokens")


@query("work_plan", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40 WHERE d.doc_id % 3 <> 0")
def work_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id"))
    planned = docs.join(table(spark, sf_dir, "benchmark").select("item_id"), "item_id")
    return op.still_to_do(planned, docs.filter("doc_id % 3 = 0"), ["doc_id", "item_id"]).select("doc_id", "item_id")


@query("vendor_usage", """SELECT event_id, greatest(event_id % 500 - event_id % 90 - CASE WHEN event_id % 2 = 0 THEN 20 ELSE 0 END, 0) AS input_tokens, event_id % 70 + CASE WHEN event_id % 3 = 0 THEN 5 ELSE 0 END AS output_tokens, event_id % 90 AS cache_read_tokens, CAST(CASE WHEN event_id % 2 = 0 THEN 20 ELSE 0 END AS BIGINT) AS cache_write_tokens FROM events""")
def vendor_usage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.struct((F.col("event_id") % 500).alias("prompt_tokens"), (F.col("event_id") % 90).alias("cached_tokens"), F.when(F.col("event_id") % 2 == 0, 20).alias("cache_write_tokens"), (F.col("event_id") % 70).alias("completion_tokens"), F.when(F.col("event_id") % 3 == 0, 5).alias("thought_tokens")).alias("usage")))
    return e.select("event_id", body.alias("b")).select("event_id", *[c.alias(n) for n, c in op.usage(F.col("b")).items()])


@query("residency_of_models", "WITH m AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'us.model-1' WHEN 1 THEN 'global.model-1' WHEN 2 THEN 'model-1' ELSE 'apac.x' END AS model FROM customer) SELECT CASE WHEN model LIKE 'global.%' THEN 'global' WHEN model LIKE 'us.%' OR model LIKE 'apac.%' THEN 'geo' ELSE 'single-region' END AS residency, count(*) AS n FROM m GROUP BY 1")
def residency_of_models(spark, sf_dir):
    k = F.col("c_custkey") % 4
    model = F.when(k == 0, "us.model-1").when(k == 1, "global.model-1").when(k == 2, "model-1").otherwise("apac.x")
    return table(spark, sf_dir, "customer").groupBy(op.residency_of(model).alias("residency")).agg(F.count(F.lit(1)).alias("n"))


@query("finish_words", "WITH w AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'End_Turn' WHEN 1 THEN 'max_tokens' WHEN 2 THEN 'SAFETY' ELSE 'odd' END AS word FROM part) SELECT CASE lower(word) WHEN 'end_turn' THEN 'stop' WHEN 'max_tokens' THEN 'length' WHEN 'safety' THEN 'content_filter' ELSE lower(word) END AS finish, count(*) AS n FROM w GROUP BY 1")
def finish_words(spark, sf_dir):
    k = F.col("p_size") % 4
    word = F.when(k == 0, "End_Turn").when(k == 1, "max_tokens").when(k == 2, "SAFETY").otherwise("odd")
    return table(spark, sf_dir, "part").groupBy(finish(word).alias("finish")).agg(F.count(F.lit(1)).alias("n"))


@query("retry_delays", "SELECT l_linenumber AS attempt, least(30, 0.5 * pow(2, l_linenumber - 1)) AS delay, count(*) AS n FROM lineitem GROUP BY 1")
def retry_delays(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("attempt")).agg(F.count(F.lit(1)).alias("n")).withColumn("delay", backoff(F.col("attempt")))


@query("excerpts", "SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE substr(text, 1, 300) || ' ... ' || right(text, 300) END AS excerpt FROM documents")
def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", excerpt(F.col("text")).alias("excerpt"))
