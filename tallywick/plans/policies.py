"""Policy grid and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywick.operators import policy as op
from tallywick.plans.registry import query
from tallywick.sources.ledger import LEDGER_SQL, ledger

# An example policy and its providers.
RULES = [
    ("public", None, None, None, None, True),
    ("internal", "global", None, ["vendor-a", "vendor-b", "selfhost"], None, True),
    ("personal", "geo", ["CA-Central-1"], None, "internal", False),
    ("sensitive", "single-region", ["ca-central-1"], ["selfhost"], "personal", False),
]
PROVIDERS = [("vendor-a", "geo", "ca-central-1"), ("vendor-b", "global", "us-east-1"), ("vendor-c", None, "ca-central-1"), ("selfhost", "single-region", "CA-CENTRAL-1"), ("vendor-d", "planetary", None)]
CLASSES = ["public", "internal", "personal", "sensitive", "secret", None]

# The same policy written out by hand, class by class, as an independent second formulation.
_ALLOWED = {
    "public": "true",
    "internal": "residency IN ('single-region', 'geo', 'global') AND provider IN ('vendor-a', 'vendor-b', 'selfhost')",
    "personal": "residency IN ('single-region', 'geo') AND lower(region) = 'ca-central-1'",
    "sensitive": "residency = 'single-region' AND lower(region) = 'ca-central-1' AND provider = 'selfhost'",
}


def _allowed(name: str) -> str:
    return " ".join(["CASE", *(f"WHEN {name} = '{k}' THEN coalesce({v}, false)" for k, v in _ALLOWED.items()), "ELSE false END"])


_DECIDED = f"""judged AS (SELECT *, coalesce(data_class, 'personal') AS effective_class, CASE WHEN redacted AND coalesce(data_class, 'personal') = 'personal' THEN 'internal' WHEN redacted AND data_class = 'sensitive' THEN 'personal' END AS judged_as FROM calls),
decided AS (SELECT *, {_allowed('coalesce(judged_as, effective_class)')} AS allowed FROM judged)"""
_CACHE = "allowed AND effective_class IN ('public', 'internal')"


def _rules(spark):
    return spark.createDataFrame(RULES, op.RULES)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in rows)


@query("policy_grid", f"""WITH p(provider, residency, region) AS (VALUES {_values(PROVIDERS)}), c(data_class) AS (VALUES {_values([(c,) for c in CLASSES])}), r(redacted) AS (VALUES (true), (false)),
calls AS (SELECT * FROM p, c, r), {_DECIDED} SELECT provider, data_class, redacted, effective_class, judged_as, allowed, {_CACHE} AS cache FROM decided""")
def policy_grid(spark, sf_dir):
    providers = spark.createDataFrame(PROVIDERS, "provider string, residency string, region string")
    classes = spark.createDataFrame([(c,) for c in CLASSES], "data_class string")
    grid = providers.crossJoin(classes).crossJoin(spark.createDataFrame([(True,), (False,)], "redacted boolean"))
    return op.decide(grid, _rules(spark)).select("provider", "data_class", "redacted", "effective_class", "judged_as", "allowed", "cache")


@query("policy_decisions", f"""WITH {LEDGER_SQL}, calls AS (SELECT call_uid, data_class, provider, residency, region, event_id % 3 = 0 AS redacted FROM ledger), {_DECIDED} SELECT effective_class, judged_as, allowed, count(*) AS calls, count(*) FILTER ({_CACHE}) AS cacheable FROM decided GROUP BY 1, 2, 3""")
def policy_decisions(spark, sf_dir):
    calls = ledger(spark, sf_dir).select("call_uid", "data_class", "provider", "residency", "region", (F.col("event_id") % 3 == 0).alias("redacted"))
    return op.decide(calls, _rules(spark)).groupBy("effective_class", "judged_as", "allowed").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("cache"), 1)).alias("cacheable"))


# Why a call is refused, class by class, in the order of the policy's limits.
_WIDER = {"internal": "global", "personal": "geo", "sensitive": "single-region"}
_KNOWN = {"internal": "'single-region', 'geo', 'global'", "personal": "'single-region', 'geo'", "sensitive": "'single-region'"}
_USE = {"internal": "'vendor-a', 'vendor-b', 'selfhost'", "sensitive": "'selfhost'"}
_WHY = " ".join(
    f"WHEN n = '{k}' AND residency IS NULL THEN n || ' data needs residency no wider than {_WIDER[k]}, none declared' WHEN n = '{k}' AND residency NOT IN ({_KNOWN[k]}) THEN n || ' data needs residency no wider than {_WIDER[k]}, declared ' || residency"
    + (f" WHEN n = '{k}' AND coalesce(lower(region), '') <> 'ca-central-1' THEN n || ' data may not be sent to region ' || coalesce(nullif(region, ''), 'unset')" if k != "internal" else "")
    + (f" WHEN n = '{k}' AND provider NOT IN ({_USE[k]}) THEN n || ' data may not use ' || provider" if k in _USE else "")
    for k in _WIDER
)


@query(
    "policy_reasons",
    f"""WITH {LEDGER_SQL}, calls AS (SELECT call_uid, data_class, provider, residency, region, event_id % 3 = 0 AS redacted FROM ledger), {_DECIDED}, named AS (SELECT *, coalesce(judged_as, effective_class) AS n FROM decided),
told AS (SELECT CASE WHEN effective_class NOT IN ('public', 'internal', 'personal', 'sensitive') THEN 'class ' || effective_class || ' is not in the policy' ELSE CASE WHEN judged_as IS NOT NULL THEN 'redacted ' || effective_class || ' data, judged as ' || judged_as || ': ' ELSE '' END || CASE {_WHY} ELSE 'within policy' END END AS reason FROM named)
SELECT reason, count(*) AS calls FROM told GROUP BY 1""",
)
def policy_reasons(spark, sf_dir):
    calls = ledger(spark, sf_dir).select("call_uid", "data_class", "provider", "residency", "region", (F.col("event_id") % 3 == 0).alias("redacted"))
    return op.decide(calls, _rules(spark)).groupBy("reason").agg(F.count(F.lit(1)).alias("calls"))


@query("policy_refusals", f"""WITH {LEDGER_SQL}, calls AS (SELECT call_uid, data_class, provider, residency, region, event_id % 3 = 0 AS redacted FROM ledger), {_DECIDED} SELECT call_uid, 'policy_refused' AS error_type, CAST(0 AS DOUBLE) AS cost_usd, true AS costed FROM decided WHERE NOT allowed""")
def policy_refusals(spark, sf_dir):
    calls = ledger(spark, sf_dir).select("call_uid", "data_class", "provider", "residency", "region", (F.col("event_id") % 3 == 0).alias("redacted"))
    return op.refusal_rows(op.decide(calls, _rules(spark))).select("call_uid", "error_type", "cost_usd", "costed")
