"""Spend, residency and dashboard reports, and costing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywick.functions import pricing as fn
from tallywick.operators import pricing as op
from tallywick.operators import reports as rp
from tallywick.plans.registry import query
from tallywick.sources.ledger import LEDGER_SQL, ledger
from tallywick.sources.prices import PRICES_SQL, latest, prices


def costed(spark, sf_dir):
    return op.with_cost(ledger(spark, sf_dir), latest(prices(spark)))


_RATES = ["input", "output", "cache_read", "cache_write", "batch_multiplier", "above_tokens", "long_input", "long_output", "long_cache_read", "long_cache_write"]
_PICK = ", ".join(f"CASE WHEN a.vendor IS NOT NULL THEN a.{c} ELSE b.{c} END AS {c}" for c in _RATES)
_LONG = "input_tokens + cache_read_tokens + cache_write_tokens > above_tokens"


def _rate(c: str) -> str:
    return f"(CASE WHEN {_LONG} THEN long_{c} ELSE {c} END)"


def _part(n: str, c: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN {n} / CAST(1e6 AS DOUBLE) * coalesce({_rate(c)}, 0) ELSE 0 END)"


_SUM = f"(((CAST(0 AS DOUBLE) + {_part('input_tokens', 'input')}) + {_part('output_tokens', 'output')}) + {_part('cache_read_tokens', 'cache_read')}) + {_part('cache_write_tokens', 'cache_write')}"
COST_SQL = f"""CASE WHEN input IS NULL OR (input_tokens > 0 AND {_rate('input')} IS NULL) OR (output_tokens > 0 AND {_rate('output')} IS NULL)
  OR (cache_read_tokens > 0 AND {_rate('cache_read')} IS NULL) OR (cache_write_tokens > 0 AND {_rate('cache_write')} IS NULL) OR (batch AND batch_multiplier IS NULL) THEN NULL
  ELSE round_even(({_SUM}) * CASE WHEN batch THEN batch_multiplier ELSE 1 END, 10) END"""
COSTED_SQL = f"""{LEDGER_SQL}, {PRICES_SQL}, newest AS (SELECT * FROM prices WHERE list_date = (SELECT max(list_date) FROM prices)),
rated AS (SELECT l.*, coalesce(a.list_date, b.list_date) AS price_list, {_PICK} FROM ledger l
  LEFT JOIN newest a ON a.vendor = l.provider AND a.model = l.model_returned
  LEFT JOIN newest b ON b.vendor = l.provider AND b.model = l.model_requested),
priced AS (SELECT *, CASE WHEN cached OR provider = 'selfhost' THEN 0 WHEN streamed AND NOT usage_known THEN NULL ELSE {COST_SQL} END AS cost_usd FROM rated),
costed AS (SELECT *, cost_usd IS NOT NULL AS costed FROM priced)"""

_FAILED = "coalesce(error_type <> '', false)"
_STRICT = "(NOT costed AND error_type IS NULL AND coalesce(http_status BETWEEN 200 AND 299, false))"


def _report_sql(where: str) -> str:
    agg = f"count(*) AS calls, count(*) FILTER ({_FAILED}) AS errors, {{unc}} AS uncosted, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(20, 10))) FILTER (costed), 0) AS DOUBLE) AS cost_usd"
    return f"""WITH {COSTED_SQL}, r AS (SELECT * FROM costed WHERE {where})
SELECT substr(ts_utc, 1, 7) AS month, coalesce(env, '-') AS env, project, coalesce(data_class, 'undeclared') AS data_class, model_requested, {agg.format(unc=f"count(*) FILTER (NOT {_FAILED} AND NOT costed)")} FROM r GROUP BY 1, 2, 3, 4, 5
UNION ALL SELECT 'total', '', '', '', '', {agg.format(unc=f"count(*) FILTER ({_STRICT})")} FROM r"""


@query("ledger_report", _report_sql("true"))
def ledger_report(spark, sf_dir):
    return rp.spend_report(costed(spark, sf_dir))


@query("ledger_report_month", _report_sql("ts_utc LIKE '2024-01%'"))
def ledger_report_month(spark, sf_dir):
    return rp.spend_report(costed(spark, sf_dir).filter(rp.in_month("2024-01")))


@query("ledger_report_undeclared", _report_sql("data_class IS NULL"))
def ledger_report_undeclared(spark, sf_dir):
    return rp.spend_report(costed(spark, sf_dir).filter(rp.of_class(rp.UNDECLARED)))


_RESIDENCY = f"""WITH {LEDGER_SQL}, g AS (SELECT provider, coalesce(nullif(region, ''), '-') AS region, coalesce(residency, 'undeclared') AS residency, count(*) AS calls, count(*) FILTER (cached) AS cached,
  count(*) FILTER ({_FAILED}) AS errors, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, string_agg(DISTINCT model_requested, ',' ORDER BY model_requested) AS models FROM ledger GROUP BY 1, 2, 3),
r AS (SELECT *, CASE residency WHEN 'single-region' THEN 0 WHEN 'geo' THEN 1 WHEN 'global' THEN 2 ELSE 3 END AS reach, calls - cached AS sent FROM g)
"""


@query("residency_report", _RESIDENCY + "SELECT * FROM r")
def residency_report(spark, sf_dir):
    return rp.residency_report(ledger(spark, sf_dir))


@query("residency_violations", _RESIDENCY + "SELECT * FROM r WHERE reach > 1 AND sent > 0")
def residency_violations(spark, sf_dir):
    return rp.residency_violations(rp.residency_report(ledger(spark, sf_dir)), "geo")


def _dash_sql(keys: dict[str, str], where: str = "true") -> str:
    refused = "coalesce(error_type IN ('policy_refused', 'redaction_refused', 'injection_blocked'), false)"
    flying = "coalesce(error_type = 'in_flight', false)"
    cols = ", ".join(f"{sql} AS {k}" for k, sql in keys.items())
    n = ", ".join(map(str, range(1, len(keys) + 1)))

    def at(q: float) -> str:
        return f"list_extract(lat, 1 + CAST(round_even({q} * (len(lat) - 1), 0) AS BIGINT))"

    return f"""WITH {COSTED_SQL}, g AS (SELECT {cols}, count(*) AS calls, count(*) FILTER ({_FAILED} AND NOT {refused} AND NOT {flying}) AS errors, count(*) FILTER ({refused}) AS refused,
  count(*) FILTER ({flying}) AS in_flight, count(*) FILTER (cached) AS cached, count(*) FILTER ({_STRICT}) AS uncosted, CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(20, 10))) FILTER (costed), 0) AS DOUBLE) AS cost_usd,
  list_sort(list(latency_ms) FILTER (NOT {_FAILED} AND NOT cached AND latency_ms IS NOT NULL)) AS lat FROM costed WHERE {where} GROUP BY {n})
SELECT {", ".join(keys)}, calls, errors, refused, in_flight, cached, uncosted, cost_usd, {at(0.5)} AS p50_ms, {at(0.95)} AS p95_ms FROM g"""


@query("dashboard_by_project", _dash_sql({"project": "project"}))
def dashboard_by_project(spark, sf_dir):
    return rp.dashboard(costed(spark, sf_dir), ["project"])


@query("dashboard_by_model", _dash_sql({"provider": "provider", "model_requested": "model_requested"}))
def dashboard_by_model(spark, sf_dir):
    return rp.dashboard(costed(spark, sf_dir), ["provider", "model_requested"])


@query("dashboard_by_env_region", _dash_sql({"env": "coalesce(nullif(env, ''), '-')", "region": "coalesce(nullif(region, ''), '-')"}))
def dashboard_by_env_region(spark, sf_dir):
    return rp.dashboard(costed(spark, sf_dir), ["env", "region"])


@query("dashboard_by_day", _dash_sql({"day": "substr(ts_utc, 1, 10)"}, "ts_utc >= '2024-01-05'"))
def dashboard_by_day(spark, sf_dir):
    return rp.dashboard(costed(spark, sf_dir), ["day"], since="2024-01-05").orderBy(F.desc("day"))


@query("dashboard_cards", f"""WITH {COSTED_SQL} SELECT count(*) AS calls, min(substr(ts_utc, 1, 10)) AS first_day, count(DISTINCT project) AS projects, CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(20, 10))) FILTER (costed), 0) AS DOUBLE) AS cost_usd, mode(coalesce(env, '-') ORDER BY coalesce(env, '-')) AS usual_env FROM costed""")
def dashboard_cards(spark, sf_dir):
    rows = costed(spark, sf_dir)
    usual = F.mode(F.coalesce("env", F.lit("-")), True)
    return rows.agg(F.count(F.lit(1)).alias("calls"), F.min(F.substring("ts_utc", 1, 10)).alias("first_day"), F.count_distinct("project").alias("projects"), rp.usd(F.col("costed")).alias("cost_usd"), usual.alias("usual_env"))


_RUNS = f"WITH {COSTED_SQL}, g AS (SELECT run_id, CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(20, 10))) FILTER (costed), 0) AS DOUBLE) AS cost_usd FROM costed GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY cost_usd DESC, run_id) AS n FROM g WHERE cost_usd > 0)\n"


@query("top_runs_with_rest", _RUNS + "SELECT run_id, round(cost_usd, 4) AS cost_usd FROM o WHERE n <= 10 UNION ALL SELECT concat(CAST(count(*) AS VARCHAR), ' more'), round(sum(cost_usd), 4) FROM o WHERE n > 10 HAVING count(*) > 0")
def top_runs_with_rest(spark, sf_dir):
    runs = costed(spark, sf_dir).groupBy("run_id").agg(rp.usd(F.col("costed")).alias("cost_usd"))
    return rp.top_with_rest(runs, "run_id", "cost_usd", 10).withColumn("cost_usd", F.round("cost_usd", 4))


def _spend(name: str, keys: dict[str, str], where_sql: str = "true", where=None):
    cols = ", ".join(f"{sql} AS {k}" for k, sql in keys.items())
    by = ", ".join(map(str, range(1, len(keys) + 1)))

    @query(name, f"WITH {COSTED_SQL} SELECT {cols}, CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(20, 10))), 0) AS DOUBLE) AS spend_usd FROM costed WHERE {where_sql} GROUP BY {by}")
    def run(spark, sf_dir):
        rows = costed(spark, sf_dir)
        return rp.spend(rows if where is None else rows.filter(where()), *[F.expr(sql).alias(k) for k, sql in keys.items()])

    return run


_spend("spend_month", {"project": "project", "month": "substr(ts_utc, 1, 7)"})
_spend("spend_day", {"project": "project", "day": "substr(ts_utc, 1, 10)"}, "ts_utc >= '2024-01-10' AND ts_utc < '2024-01-15'", lambda: rp.in_days("2024-01-10", "2024-01-15"))
_spend("spend_run", {"run_id": "run_id"})
_spend("spend_rebuild", {"project": "project", "month": "substr(ts_utc, 1, 7)", "provider": "provider"})


@query("uncosted_calls", f"WITH {COSTED_SQL} SELECT provider, count(*) AS uncosted FROM costed WHERE {_STRICT} GROUP BY 1")
def uncosted_calls(spark, sf_dir):
    return costed(spark, sf_dir).filter(rp.uncosted()).groupBy("provider").agg(F.count(F.lit(1)).alias("uncosted"))


@query("cost_by_price_list", f"WITH {COSTED_SQL} SELECT price_list, provider, count(*) AS calls, CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(20, 10))), 0) AS DOUBLE) AS cost_usd FROM costed GROUP BY 1, 2")
def cost_by_price_list(spark, sf_dir):
    return costed(spark, sf_dir).groupBy("price_list", "provider").agg(F.count(F.lit(1)).alias("calls"), rp.usd().alias("cost_usd"))


@query("cost_per_call", f"WITH {COSTED_SQL} SELECT call_uid, round(cost_usd, 8) AS cost_usd, costed FROM costed")
def cost_per_call(spark, sf_dir):
    return costed(spark, sf_dir).select("call_uid", F.round("cost_usd", 8).alias("cost_usd"), "costed")


@query("cost_tiered", f"WITH {COSTED_SQL} SELECT provider, count(*) FILTER ({_LONG}) AS long_prompts, count(*) AS calls FROM rated WHERE above_tokens IS NOT NULL GROUP BY 1")
def cost_tiered(spark, sf_dir):
    rated = op.with_rates(ledger(spark, sf_dir), latest(prices(spark))).filter("above_tokens IS NOT NULL")
    return rated.groupBy("provider").agg(F.count(F.when(F.expr(_LONG), 1)).alias("long_prompts"), F.count(F.lit(1)).alias("calls"))


@query("cost_as_of", f"""WITH {LEDGER_SQL}, {PRICES_SQL}, best AS (SELECT l.call_uid, l.provider, max(p.list_date) AS list_date FROM ledger l LEFT JOIN prices p ON p.vendor = l.provider AND p.model = l.model_requested AND p.list_date <= substr(l.ts_utc, 1, 10) GROUP BY 1, 2)
SELECT list_date, provider, count(*) AS calls FROM best GROUP BY 1, 2""")
def cost_as_of(spark, sf_dir):
    return op.as_of(ledger(spark, sf_dir), prices(spark)).groupBy("list_date", "provider").agg(F.count(F.lit(1)).alias("calls"))


@query("cost_estimate", f"""WITH {COSTED_SQL}, e AS (SELECT call_uid, event_id % 2000 AS chars, rated.* EXCLUDE (call_uid) FROM rated WHERE input IS NOT NULL)
SELECT call_uid, round(round_even(chars / 3.5 / 1e6::DOUBLE * CASE WHEN chars / 3.5 * 2 > above_tokens THEN long_input ELSE input END + 1024 / 1e6::DOUBLE * CASE WHEN chars / 3.5 * 2 > above_tokens THEN long_output ELSE output END, 10), 8) AS estimate_usd FROM e""")
def cost_estimate(spark, sf_dir):
    rated = op.with_rates(ledger(spark, sf_dir), latest(prices(spark))).filter("input IS NOT NULL")
    return rated.select("call_uid", F.round(fn.estimate(F.col("event_id") % 2000, F.lit(1024)), 8).alias("estimate_usd"))


@query("price_check", f"""WITH {LEDGER_SQL}, {PRICES_SQL} SELECT DISTINCT provider, model_requested FROM ledger WHERE provider <> 'selfhost' AND NOT EXISTS (SELECT 1 FROM prices p WHERE p.list_date = (SELECT max(list_date) FROM prices) AND p.vendor = provider AND p.model = model_requested)""")
def price_check(spark, sf_dir):
    routes = ledger(spark, sf_dir).filter("provider <> 'selfhost'").select("provider", "model_requested").distinct()
    now = latest(prices(spark)).select(F.col("vendor").alias("provider"), F.col("model").alias("model_requested"))
    return routes.join(now, ["provider", "model_requested"], "left_anti")
