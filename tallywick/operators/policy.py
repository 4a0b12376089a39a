"""Policy: may a call with declared data go to this provider and region?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywick.operators.reports import RESIDENCIES, reach

RULES = "data_class string, max_residency string, regions array<string>, providers array<string>, redacted_as string, cache boolean"


def _judge(rule: str, name: Column) -> tuple[Column, Column]:
    """Whether one rule allows a call, and why not: residency declared, residency reach, region, provider, in that order."""
    r = lambda c: F.col(f"{rule}.{c}")
    limit, residency, region, provider = r("max_residency"), F.col("residency"), F.col("region"), F.col("provider")
    wide = ~residency.isin(RESIDENCIES) | (reach(residency) > reach(limit))
    outside = region.isNull() | ~F.exists(r("regions"), lambda x: F.lower(x) == F.lower(region))
    needs = F.concat(name, F.lit(" data needs residency no wider than "), limit)
    reason = (
        F.when(limit.isNotNull() & residency.isNull(), F.concat(needs, F.lit(", none declared")))
        .when(limit.isNotNull() & wide, F.concat(needs, F.lit(", declared "), residency))
        .when(r("regions").isNotNull() & outside, F.concat(name, F.lit(" data may not be sent to region "), F.coalesce(F.nullif(region, F.lit("")), F.lit("unset"))))
        .when(r("providers").isNotNull() & ~F.array_contains(r("providers"), provider), F.concat(name, F.lit(" data may not use "), provider))
    )
    return reason.isNull(), F.coalesce(reason, F.lit("within policy"))


def decide(calls: DataFrame, rules: DataFrame, undeclared: str = "personal") -> DataFrame:
    """Judge calls (data_class, provider, residency, region, redacted) by class rules; adds effective_class, judged_as,
    allowed, reason and cache. An undeclared class counts as ``undeclared``, an unlisted one is refused; redacted data is
    judged by its rule's ``redacted_as``, and cached only if both rules allow it. Rules are a row per class."""
    effective = F.coalesce("data_class", F.lit(undeclared))
    first = rules.select(F.col("data_class").alias("_own"), F.struct(*rules.columns).alias("rule"))
    other = rules.select(F.col("data_class").alias("_as"), F.struct(*rules.columns).alias("other"))
    joined = calls.withColumn("effective_class", effective).join(first, F.col("effective_class") == F.col("_own"), "left")
    joined = joined.join(other, F.col("redacted") & (F.col("rule.redacted_as") == F.col("_as")), "left")
    plain_ok, plain_why = _judge("rule", F.col("effective_class"))
    other_ok, other_why = _judge("other", F.col("rule.redacted_as"))
    listed, swapped = F.col("rule").isNotNull(), F.col("other").isNotNull()
    allowed = F.when(~listed, False).when(swapped, other_ok).otherwise(plain_ok)
    reason = F.when(~listed, F.concat(F.lit("class "), F.col("effective_class"), F.lit(" is not in the policy"))).when(swapped, F.concat(F.lit("redacted "), F.col("effective_class"), F.lit(" data, judged as "), F.col("rule.redacted_as"), F.lit(": "), other_why)).otherwise(plain_why)
    cache = F.when(~allowed, False).when(swapped, F.col("rule.cache") & F.col("other.cache")).otherwise(F.col("rule.cache"))
    return joined.select(*[calls[c] for c in calls.columns], "effective_class", F.when(swapped, F.col("rule.redacted_as")).alias("judged_as"), allowed.alias("allowed"), reason.alias("reason"), F.coalesce(cache, F.lit(False)).alias("cache"))


def refusal_rows(decided: DataFrame) -> DataFrame:
    """What a refused call leaves in the ledger: costed at nothing, never sent."""
    return decided.filter(~F.col("allowed")).select(*decided.columns, F.lit("policy_refused").alias("error_type"), F.lit(0.0).alias("cost_usd"), F.lit(True).alias("costed"), F.lit(None).cast("string").alias("request_sha256"))


def cache_skip_reason() -> Column:
    """Why a request is not eligible for the answer cache, first reason that holds; null if it is eligible."""
    return (
        F.when(~F.col("cache_on"), "off").when(~F.col("class_allows"), "class").when(F.col("flagged"), "flagged").when(F.coalesce(F.col("temperature") > 0, F.lit(False)), "temperature")
        .when(F.col("turns") > 1, "conversation").when(F.col("chars") > F.lit(8000), "long")
    )
