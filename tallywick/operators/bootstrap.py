"""Intervals of medians, quantiles and means by drawing values again, without holding a group's values.

A value takes part in a draw as often as a Poisson variable of mean 1 says, made from a hash of its row's id, the draw and
the seed. So draws need no order and no knowledge of each other: a task adds up weights per draw and cell of a histogram,
those merge by addition, and a draw's quantile is read from its cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells of a histogram to each doubling of a value: a quantile is told to within a 180th of itself.
CELLS = 128
_BITS = 53


def poisson(u: Column) -> Column:
    """The Poisson variable of mean 1 that a number in [0, 1) stands for."""
    upto, p, steps = 0.0, math.exp(-1), []
    for k in range(1, 19):
        upto += p
        steps.append(upto)
        p /= k
    return sum((F.when(u >= s, 1).otherwise(0) for s in steps[1:]), F.when(u >= steps[0], 1).otherwise(0))


def uniform(*of: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.xxhash64(*of).bitwiseAND(F.lit((1 << _BITS) - 1)) / float(1 << _BITS)


def cell(value: Column) -> Column:
    """The cell of a value, and ``middle`` its value back: cells grow with values, zero has its own."""
    v = value.cast("double")
    far = F.floor(F.log2(F.abs(v)) * CELLS) + (1 << 20)
    return F.when(v == 0, F.lit(0).cast("long")).when(v < 0, -far).otherwise(far)


def middle(at: Column) -> Column:
    size = F.pow(F.lit(2.0), (F.abs(at) - (1 << 20) + 0.5) / CELLS)
    return F.when(at == 0, 0.0).when(at < 0, -size).otherwise(size)


def intervals(rows: DataFrame, keys: list[str], id_col: str, value: str, quantiles: dict[str, float], draws: int = 1000, seed: int = 20260922) -> DataFrame:
    """Per group, each named quantile and the mean, with 95 % intervals: keys, measure, n, estimate, low, high.

    ``id_col`` names a row; rows that share one are drawn together. Null values and NaN are left out; a group without
    values has no rows. Estimates of quantiles are cell middles, nearest rank; means are exact.
    """
    v = F.col(value).cast("double")
    held = rows.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, F.col(id_col).alias("_id"), v.alias("_v"), cell(v).alias("_cell"))
    drawn = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("_draw"))
    # draw 0 is the values as they are
    times = F.when(F.col("_draw") == 0, 1).otherwise(poisson(uniform(F.col("_id"), F.col("_draw"), F.lit(seed))))
    cells = drawn.withColumn("_w", times).filter("_w > 0").groupBy(*keys, "_draw", "_cell").agg(F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_v")).alias("_s"))
    of_draw = Window.partitionBy(*keys, "_draw")
    upto = F.sum("_w").over(of_draw.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = cells.withColumns({"_upto": upto, "_n": F.sum("_w").over(of_draw), "_all": F.sum("_s").over(of_draw)})
    rank = lambda q: F.bround(q * (F.col("_n") - 1), 0)
    told = [F.max(F.when((F.col("_upto") > rank(q)) & (F.col("_upto") - F.col("_w") <= rank(q)), middle(F.col("_cell")))).alias(name) for name, q in quantiles.items()]
    by_draw = cells.groupBy(*keys, "_draw").agg(*told, F.first(F.col("_all") / F.col("_n")).alias("mean"), F.first("_n").alias("_n"))
    names = [*quantiles, "mean"]
    long = by_draw.select(*keys, "_draw", "_n", F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("x")) for n in names])))
    first = F.col("_draw") == 0
    return long.groupBy(*keys, "measure").agg(F.max(F.when(first, F.col("_n"))).alias("n"), F.max(F.when(first, F.col("x"))).alias("estimate"), F.percentile(F.when(~first, F.col("x")), 0.025).alias("low"), F.percentile(F.when(~first, F.col("x")), 0.975).alias("high"))


def overhead_summary(calls: DataFrame, keys: list[str], id_col: str, value: str, draws: int = 1000) -> DataFrame:
    """What calls cost in time, one row per group: n, p50, p95 and mean, each with its interval."""
    told = intervals(calls, keys, id_col, value, {"p50": 0.5, "p95": 0.95}, draws)
    return told.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}") for m in ("p50", "p95", "mean") for c in ("estimate", "low", "high")])
