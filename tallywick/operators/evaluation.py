"""Evaluation of runs and samples: bootstraps, load cells, sealing plans, batch results, vendor answers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywick.operators.reports import ranked_quantiles


def _poisson(u: Column) -> Column:
    """A Poisson(1) count from a uniform number: how often a case is drawn in a resample of many cases."""
    out, upto = F.lit(0), 0.0
    for k in range(12):
        upto += math.exp(-1) / math.factorial(k)
        out = out + F.when(u >= upto, 1).otherwise(0)
    return out


def ratio_bootstrap(groups: DataFrame, key: str, hits: str, total: str, draws: int = 2000, seed: int = 1) -> DataFrame:
    """A 95 % interval of sum(hits) / sum(total) when whole groups are resampled: ratio, low, high.

    Each draw weighs each group by a Poisson count from a hash, so a draw is a sum over groups, taken where they are, and
    no group travels to the driver. Draws without any total are left out."""
    u = (F.xxhash64(F.col(key), F.col("draw"), F.lit(seed)).bitwiseAND((1 << 52) - 1)) / float(1 << 52)
    drawn = groups.select(key, hits, total, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("w", _poisson(u))
    per = drawn.groupBy("draw").agg((F.sum(F.col("w") * F.col(hits)) / F.nullif(F.sum(F.col("w") * F.col(total)), F.lit(0))).alias("r")).filter("r IS NOT NULL")
    whole = groups.agg((F.sum(hits) / F.sum(total)).alias("ratio"))
    return per.agg(F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high")).crossJoin(F.broadcast(whole)).select("ratio", "low", "high")


def load_cells(samples: DataFrame, q: float = 0.95) -> DataFrame:
    """Per layer and rate: the mean over runs of the proxy's quantile less the mock's, over runs that both have and that
    lost less than a hundredth of their requests; and a class for the cell."""
    keys = ["layer", "rps", "run", "target"]
    lost = samples.groupBy(*keys).agg(F.avg(F.when(F.col("ok"), 0.0).otherwise(1.0)).alias("lost"))
    at = ranked_quantiles(samples.filter("ok"), keys, "ms", {"v": q}).join(lost, keys)
    side = lambda t: at.filter(F.col("target") == t).select("layer", "rps", "run", F.col("v").alias(t), F.col("lost").alias(f"{t}_lost"))
    runs = side("proxy").join(side("mock"), ["layer", "rps", "run"])
    clean = (F.col("proxy_lost") < 0.01) & (F.col("mock_lost") < 0.01)
    out = runs.groupBy("layer", "rps").agg(F.count(F.lit(1)).alias("runs"), F.count(F.when(clean, 1)).alias("clean"), F.round(F.avg(F.when(clean, F.col("proxy") - F.col("mock"))), 6).alias("overhead_ms"))
    kind = F.when(F.col("clean") == 0, "shedding").when(F.col("clean") < F.col("runs"), "partly").otherwise("clean")
    return out.withColumn("kind", kind)


def to_seal(ledger: DataFrame, sealed: DataFrame, now: Column, settle_hours: int = 24) -> DataFrame:
    """Rows to be sealed: new, or changed since they were last sealed. One in flight waits until it is a day old."""
    last = sealed.groupBy("call_uid").agg(F.max_by("body", "seq").alias("sealed_body"))
    joined = ledger.join(last, "call_uid", "left")
    fresh = F.col("sealed_body").isNull() | (F.col("sealed_body") != F.col("body"))
    flying = F.coalesce(F.col("error_type") == "in_flight", F.lit(False))
    old = F.coalesce(F.col("ts") <= now - F.expr(f"INTERVAL {settle_hours} HOURS"), F.lit(True))
    return joined.filter(F.col("call_uid").isNotNull() & fresh & (~flying | old)).select(*ledger.columns)


def apply_batch(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Batch calls with their outcome: that of their own id, an error if it is one, batch_missing if there is none."""
    own = results.select(F.col("custom_id").alias("call_uid"), "outcome", "output_tokens")
    joined = rows.join(own, "call_uid", "left")
    error = F.when(F.col("outcome").isNull(), "batch_missing").when(F.col("outcome") != "succeeded", F.concat(F.lit("batch_"), F.col("outcome")))
    return joined.select(*[rows[c] for c in rows.columns], error.alias("error_type"), "output_tokens")


def still_to_do(planned: DataFrame, answered: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(answered.select(*keys), keys, "left_anti")


def usage(body: Column) -> dict[str, Column]:
    """Token counts of a vendor's answer: fresh input is the prompt less what was read from or written to a cache."""
    n = lambda path: F.get_json_object(body, path).cast("long")
    prompt, read, written = F.coalesce(n("$.usage.prompt_tokens"), n("$.usage.input_tokens")), F.coalesce(n("$.usage.cached_tokens"), F.lit(0)), F.coalesce(n("$.usage.cache_write_tokens"), F.lit(0))
    thoughts = F.coalesce(n("$.usage.thought_tokens"), F.lit(0))
    answer = F.coalesce(n("$.usage.completion_tokens"), n("$.usage.output_tokens"))
    return {"input_tokens": F.greatest(prompt - read - written, F.lit(0)), "output_tokens": answer + thoughts, "cache_read_tokens": read, "cache_write_tokens": written}


def residency_of(model: Column) -> Column:
    """Residency from a model id's prefix: a continent's profile, the global one, or the region itself."""
    prefix = F.regexp_extract(model, r"^([a-z]+)\.", 1)
    return F.when(prefix == "global", "global").when(prefix.isin("us", "eu", "apac", "ca"), "geo").otherwise("single-region")
