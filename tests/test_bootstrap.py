"""Bootstrap intervals against numpy's, and cells that tell small values apart."""

import numpy as np
from pyspark.sql import functions as F

from tallywick.operators import bootstrap, reports


def test_intervals_agree_with_resampling(spark):
    rng = np.random.default_rng(6)
    values = {"a": rng.lognormal(-6, 1, 300), "b": rng.normal(-1, 3, 200)}
    rows = [(k, i, float(v)) for k, own in values.items() for i, v in enumerate(own)] + [("a", 999, None), ("a", 998, float("nan")), ("none", 1, None)]
    found = bootstrap.intervals(spark.createDataFrame(rows, "k string, id long, v double"), ["k"], "id", "v", {"p50": 0.5, "p95": 0.95}, draws=400).collect()
    assert {r["k"] for r in found} == {"a", "b"}
    for r in found:
        own = values[r["k"]]
        draws = own[np.random.default_rng(1).integers(0, len(own), (4000, len(own)))]
        stat = {"p50": lambda x: np.quantile(x, 0.5, axis=-1), "p95": lambda x: np.quantile(x, 0.95, axis=-1), "mean": lambda x: x.mean(axis=-1)}[r["measure"]]
        low, high = np.quantile(stat(draws), [0.025, 0.975])
        assert r["n"] == len(own) and abs(r["estimate"] - stat(own)) < 0.1 * (high - low) + 0.01 * abs(stat(own))
        assert abs(r["low"] - low) < 0.3 * (high - low) and abs(r["high"] - high) < 0.3 * (high - low)


def test_poisson_of_hashes_has_mean_and_variance_one(spark):
    row = spark.range(200_000).select(bootstrap.poisson(bootstrap.uniform(F.col("id"), F.lit(1))).alias("n")).agg(F.avg("n"), F.var_pop("n")).first()
    assert abs(row[0] - 1) < 0.01 and abs(row[1] - 1) < 0.02


def test_overhead_summary(spark):
    rows = [("x", i, float(i % 100)) for i in range(1000)]
    one = bootstrap.overhead_summary(spark.createDataFrame(rows, "k string, id long, v double"), ["k"], "id", "v", draws=100).first()
    assert one["n"] == 1000 and one["p50_low"] <= one["p50_estimate"] <= one["p50_high"] and abs(one["mean_estimate"] - 49.5) < 1e-9


def test_small_values_have_cells_of_their_own(spark):
    values = [-2.0, -1e-6, 0.0, 1e-6, 2e-6, 1e-5, 6e-4, 0.5, 1e9, float("inf")]
    cells = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(reports._cell(F.col("v"))).collect()]
    assert cells == sorted(cells) and len(set(cells)) == len(values)
