"""Coupled caps: a plain version, and the stream beside the batch."""

import datetime as dt
import random

import pytest

from tallywick.operators import caps

SCHEMA = "portfolio string, seq long, project string, run string, estimate double, at timestamp, project_monthly_usd double, project_daily_usd double, per_run_usd double, portfolio_monthly_usd double"


def made(n=300, seed=4):
    rng, at, rows = random.Random(seed), dt.datetime(2024, 1, 20), []
    for i in range(n):
        at += dt.timedelta(hours=rng.randrange(0, 5))
        project = rng.choice("xyz")
        portfolio = rng.choice("PQ")
        rows.append((portfolio, i, project, rng.choice([None, "r1", "r2", "r3"]), rng.choice([1.0, 2.0, 5.0, None]), at, {"x": 60.0, "y": 40.0, "z": 500.0}[project], 9.0 if project != "z" else None, 30.0 if project != "y" else None, 70.0 if portfolio == "P" else 150.0))
    return rows


def plain(rows):
    spent, out = {}, {}
    for p, seq, project, run, estimate, at, *limits in rows:
        keys = [("project", p, project, at.strftime("%Y-%m")), ("day", p, project, at.date()), ("run", p, project, run) if run else None, ("portfolio", p, at.strftime("%Y-%m"))]
        usd = estimate or 0.0
        out[seq] = next((k[0] for k, cap in zip(keys, limits) if k and cap is not None and spent.get(k, 0.0) + usd > cap), None)
        if out[seq] is None:
            for k in keys:
                spent[k] = spent.get(k, 0.0) + usd
    return out


def test_batch_equals_plain_version(spark):
    rows = made()
    found = caps.coupled_caps(spark.createDataFrame(rows, SCHEMA).repartition(4), "portfolio", ["at", "seq"]).collect()
    want = plain(rows)
    assert {r["seq"]: r["refused_by"] for r in found} == want
    assert set(want.values()) == {None, "project", "day", "run", "portfolio"}


@pytest.mark.parametrize("size", [60, 300])
def test_stream_equals_batch(spark, tmp_path, size):
    rows, key = made(), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i in range(0, len(rows), size):
            spark.createDataFrame(rows[i : i + size], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = caps.caps_stream(source).writeStream.outputMode("append").format("memory").queryName(f"caps_{size}").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        assert {r["seq"]: r["refused_by"] for r in spark.table(f"caps_{size}").collect()} == plain(rows)
    finally:
        spark.conf.set(key, before)
