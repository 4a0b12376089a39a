"""Joining a ledger with price lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywick.functions import pricing as fn

_RATES = ["input", "output", "cache_read", "cache_write", "batch_multiplier", "above_tokens", "long_input", "long_output", "long_cache_read", "long_cache_write"]


def with_rates(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Each call with the rates of the model that was returned, else of the one asked for, else none; never guessed.
    A price list has a row per model, and the tables of one day's list are small; Spark broadcasts them by their size."""
    rates = F.struct("list_date", *_RATES)
    first = prices.select(F.col("vendor").alias("_v1"), F.col("model").alias("_m1"), rates.alias("_r1"))
    second = prices.select(F.col("vendor").alias("_v2"), F.col("model").alias("_m2"), rates.alias("_r2"))
    out = rows.join(first, (rows["provider"] == F.col("_v1")) & (rows["model_returned"] == F.col("_m1")), "left")
    out = out.join(second, (rows["provider"] == F.col("_v2")) & (rows["model_requested"] == F.col("_m2")), "left")
    chosen = F.coalesce("_r1", "_r2")
    return out.select(*[rows[c] for c in rows.columns], chosen.alias("_r")).select(*rows.columns, F.col("_r.list_date").alias("price_list"), *[F.col(f"_r.{c}").alias(c) for c in _RATES])


def with_cost(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """The ledger with cost_usd and costed: zero for a cache hit, none without usage or price; own machines are free."""
    rated = with_rates(rows, prices)
    free = F.col("cached") | (F.col("provider") == "selfhost")
    unknown = F.col("streamed") & ~F.col("usage_known")
    cost = F.when(free, 0.0).when(unknown, F.lit(None)).otherwise(fn.cost())
    return rated.withColumn("cost_usd", cost).withColumn("costed", F.col("cost_usd").isNotNull()).drop(*_RATES)


def as_of(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Each call with the list that was in force on its day: the newest not after it."""
    spans = prices.select("list_date").distinct()
    later = spans.select(F.col("list_date").alias("next"))
    spans = spans.join(later, F.col("next") > F.col("list_date"), "left").groupBy("list_date").agg(F.min("next").alias("until"))
    ranged = prices.join(spans, "list_date")
    day = F.substring("ts_utc", 1, 10)
    cond = (rows["provider"] == ranged["vendor"]) & (rows["model_requested"] == ranged["model"]) & (day >= ranged["list_date"]) & (F.col("until").isNull() | (day < F.col("until")))
    return rows.join(ranged, cond, "left").select(*[rows[c] for c in rows.columns], ranged["list_date"], *[ranged[c] for c in _RATES])
