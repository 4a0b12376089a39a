"""Replays at many thresholds against replays at one, and scopes kept apart."""

import numpy as np
from pyspark.sql import functions as F

from tallywick.operators import cache_eval as ce
from tallywick.operators.ordered import cache_replay

SCHEMA = "id long, scope string, question string, family long, storable boolean, marked boolean, cost_usd double, v array<double>"


def calls_of(spark, n=160, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(n):
        k = int(rng.integers(6))
        v = centres[k] + rng.normal(0, 0.5, 8)
        v /= np.linalg.norm(v)
        rows.append((i, "ab"[i % 2], f"q{int(rng.integers(50))}", k, bool(rng.random() < 0.9), bool(rng.random() < 0.9), None if i % 17 == 0 else float(i % 5), v.tolist()))
    return spark.createDataFrame(rows, SCHEMA)


def test_every_threshold_replays_as_if_alone(spark):
    calls, grid = calls_of(spark), [0.5, 0.8, 0.9, 0.99]
    for most in (None, 5):
        all_ = ce.by_threshold(ce.replay_grid(calls, "scope", ["id"], grid, most)).collect()
        for t in grid:
            one = {r["id"]: (r["outcome"], r["similarity"]) for r in cache_replay(calls, "scope", ["id"], t, most).collect()}
            assert {r["id"]: (r["outcome"], r["similarity"]) for r in all_ if r["threshold"] == t} == one


def test_summary_counts_pairs_and_money(spark):
    calls = calls_of(spark)
    rows = ce.by_threshold(ce.replay_grid(calls, "scope", ["id"], [0.8])).cache()
    one = ce.replay_summary(rows).first()
    own = rows.collect()
    hits = [r for r in own if r["outcome"] in ("exact", "semantic", "false")]
    pairs = {(r["question"], r["source"]): r["outcome"] == "false" for r in own if r["outcome"] in ("semantic", "false")}
    assert (one["calls"], one["hits"], one["pairs"], one["pairs_false"]) == (160, len(hits), len(pairs), sum(pairs.values()))
    assert one["saved_usd"] == sum(r["cost_usd"] or 0 for r in hits) and one["uncosted_hits"] == sum(r["cost_usd"] is None for r in hits)
    assert one["pairs_low"] <= one["pairs_false"] / one["pairs"] <= one["pairs_high"]
    assert sum(r["calls"] for r in ce.replay_summary(rows, ["scope"]).collect()) == 160
    written = ce.hit_rows(rows).collect()
    assert len(written) == len(hits) and {r["cost_usd"] for r in written} == {0.0}


def test_scopes_are_kept_apart(spark):
    v = [1.0, 0.0]
    calls = spark.createDataFrame([(1, "A", "how long", 1, True, True, 1.0, v), (2, "B", "how long", 1, True, True, 1.0, v), (3, "A", "how long", 1, True, True, 1.0, v)], SCHEMA)
    out = ce.replay_grid(calls, "scope", ["id"], [0.5])
    assert {r["id"]: r["outcome"] for r in ce.by_threshold(out).collect()} == {1: "miss", 2: "miss", 3: "exact"}
    assert ce.crossed_scopes(out, calls, "scope").count() == 0
    assert ce.crossed_scopes(out, calls.withColumn("scope", F.lit("other")), "scope").count() == 1


def test_the_odd_half_chooses(spark):
    v = lambda x: [x, (1 - x * x) ** 0.5]
    store = [(1, "s", "odd", v(1.0), 1), (2, "s", "even", v(1.0), 2)]
    asked = [(11, "s", "odd", "paraphrase", v(0.95), 1), (13, "s", "odd", "paraphrase", v(0.85), 9), (12, "s", "even", "paraphrase", v(0.97), 9), (14, "s", "even", "persona", v(0.97), 2)]
    out = ce.evaluate(spark.createDataFrame(asked, "id long, scope string, split string, kind string, v array<double>, family long"), spark.createDataFrame(store, "id long, scope string, split string, v array<double>, family long"), [0.8, 0.9, 0.96])
    rows = {(r["split"], r["kind"], r["threshold"]): r for r in out.collect()}
    assert {r["chosen"] for r in rows.values()} == {0.9}
    assert (rows["odd", "paraphrase", 0.8]["correct"], rows["odd", "paraphrase", 0.8]["wrong"]) == (1, 1)
    assert rows["even", "paraphrase", 0.9]["wrong"] == 1 and rows["even", "persona", 0.96]["correct"] == 1
