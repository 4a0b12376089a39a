"""Merge, union, completeness and reconciliation queries. The events table stands in for two ledgers that overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywick.operators import merge as op
from tallywick.plans.registry import query, table
from tallywick.sources.ledger import LEDGER_SQL, ledger

_COLS = ["call_uid", "project", "error_type", "latency_ms", "event_id"]


def first(spark, sf_dir):
    """Ledger A: lacks some calls and holds every seventh in flight."""
    rows = ledger(spark, sf_dir).select(*_COLS).filter("event_id % 20 <> 5")
    flying = F.col("event_id") % 7 == 0
    return rows.withColumn("error_type", F.when(flying, "in_flight").otherwise(F.col("error_type"))).withColumn("latency_ms", F.when(~flying, F.col("latency_ms")))


def second(spark, sf_dir):
    """Ledger B: calls that A lacks or has in flight, and some that both have."""
    return ledger(spark, sf_dir).select(*_COLS).filter("event_id % 20 = 5 OR event_id % 7 = 0 OR event_id % 10 = 1")


_AB = f"""{LEDGER_SQL}, a AS (SELECT call_uid, project, CASE WHEN event_id % 7 = 0 THEN 'in_flight' ELSE error_type END AS error_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE latency_ms END AS latency_ms, event_id FROM ledger WHERE event_id % 20 <> 5),
b AS (SELECT call_uid, project, error_type, latency_ms, event_id FROM ledger WHERE event_id % 20 = 5 OR event_id % 7 = 0 OR event_id % 10 = 1)"""
_MERGED = f"""WITH {_AB}, m AS (SELECT coalesce(a.call_uid, b.call_uid) AS call_uid, CASE WHEN b.call_uid IS NULL THEN 'keep' WHEN a.call_uid IS NULL THEN 'insert' WHEN a.error_type = 'in_flight' AND coalesce(b.error_type, '') <> 'in_flight' THEN 'complete' ELSE 'skip' END AS action,
  a.error_type AS ae, b.error_type AS be, a.latency_ms AS al, b.latency_ms AS bl FROM a FULL JOIN b ON a.call_uid = b.call_uid)
"""


@query("merge_ledgers", _MERGED + "SELECT call_uid, action, CASE WHEN action IN ('insert', 'complete') THEN be ELSE ae END AS error_type, CASE WHEN action IN ('insert', 'complete') THEN bl ELSE al END AS latency_ms FROM m")
def merge_ledgers(spark, sf_dir):
    return op.merge(first(spark, sf_dir), second(spark, sf_dir), [F.col("event_id")]).select("call_uid", "action", "error_type", "latency_ms")


@query("merge_stats", _MERGED + "SELECT count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'complete') AS completed, count(*) FILTER (action = 'skip') AS skipped FROM m")
def merge_stats(spark, sf_dir):
    return op.merge_statistics(op.merge(first(spark, sf_dir), second(spark, sf_dir), [F.col("event_id")]))


@query("merge_again", "SELECT CAST(0 AS BIGINT) AS inserted, 0::BIGINT AS completed, count(*) AS skipped FROM (SELECT event_id FROM events WHERE event_id % 20 = 5 OR event_id % 7 = 0 OR event_id % 10 = 1)")
def merge_again(spark, sf_dir):
    b = second(spark, sf_dir)
    once = op.merge(first(spark, sf_dir), b, [F.col("event_id")]).drop("action")
    # Calls that B itself holds in flight are skipped the second time too: nothing is completed twice.
    return op.merge_statistics(op.merge(once, b, [F.col("event_id")]))


@query("union_completed", f"""WITH {_AB}, u AS (SELECT *, 0 AS priority FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY call_uid ORDER BY coalesce(error_type = 'in_flight', false), priority) AS n FROM u)
SELECT call_uid, project, error_type, latency_ms, priority FROM r WHERE n = 1""")
def union_completed(spark, sf_dir):
    a, b = first(spark, sf_dir), second(spark, sf_dir)
    return op.union_completed(a, b, a).select("call_uid", "project", "error_type", "latency_ms", "priority")


_DELIVERED = "delivered AS (SELECT 'a' AS source, call_uid FROM a UNION ALL SELECT 'b', call_uid FROM b UNION ALL SELECT 'a', call_uid FROM a)"


@query("ingest_rows", f"WITH {_AB}, {_DELIVERED} SELECT DISTINCT source, call_uid FROM delivered")
def ingest_rows(spark, sf_dir):
    a, b = (rows.select(F.lit(n).alias("source"), "call_uid") for n, rows in (("a", first(spark, sf_dir)), ("b", second(spark, sf_dir))))
    return op.insert_or_ignore(a, b.unionByName(a), ["source", "call_uid"])


@query("source_completeness", f"""WITH {_AB}, claims(source, claimed) AS (VALUES ('a', 9000::BIGINT), ('b', 2500::BIGINT), ('c', 10::BIGINT)), held AS (SELECT 'a' AS source, count(*) AS held FROM a UNION ALL SELECT 'b', count(*) FROM b)
SELECT source, claimed, coalesce(held, 0) AS held, coalesce(held, 0) - claimed AS difference FROM claims LEFT JOIN held USING (source)""")
def source_completeness(spark, sf_dir):
    claims = spark.createDataFrame([("a", 9000), ("b", 2500), ("c", 10)], "source string, claimed long")
    a, b = (rows.select(F.lit(n).alias("source"), "call_uid") for n, rows in (("a", first(spark, sf_dir)), ("b", second(spark, sf_dir))))
    return op.completeness(claims, a.unionByName(b))


@query("source_latest", f"WITH {LEDGER_SQL} SELECT project, max(ts_utc) AS last_utc, max_by(run_id, ts_utc || run_id) AS run_id FROM ledger GROUP BY 1")
def source_latest(spark, sf_dir):
    rows = ledger(spark, sf_dir).select("project", F.col("ts_utc").alias("last_utc"), "run_id").withColumn("at", F.concat("last_utc", "run_id"))
    return op.upsert_latest(rows, "project", "at").select("project", "last_utc", "run_id")


@query("reconcile_orders", """WITH ours AS (SELECT o_orderstatus AS status, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 4))) AS DOUBLE) AS ours FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
theirs AS (SELECT o_orderstatus AS status, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 4))) AS DOUBLE) AS theirs FROM orders GROUP BY 1)
SELECT coalesce(a.status, b.status) AS status, coalesce(ours, 0) AS ours, coalesce(theirs, 0) AS theirs, round(coalesce(ours, 0) - coalesce(theirs, 0), 2) AS difference, CASE WHEN coalesce(theirs, 0) <> 0 THEN round(100 * (coalesce(ours, 0) - theirs) / theirs, 4) END AS percent FROM ours a FULL JOIN theirs b ON a.status = b.status""")
def reconcile_orders(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    # Lines are summed per order before the join, so the large table is shuffled as partial sums only.
    per_order = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("s"))
    ours = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderstatus").alias("status")).agg(F.sum("s").cast("double").alias("ours"))
    theirs = orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double").alias("theirs"))
    return op.reconcile(ours, theirs, ["status"])
