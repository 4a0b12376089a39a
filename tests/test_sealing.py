"""A stream of ledger rows seals what a batch does, however it is cut; rows in flight settle after a day."""

import datetime as dt
import random

import pytest

from tallywick.operators import chain
from tallywick.streaming import sealing

SCHEMA = "chain long, call_uid string, began timestamp, error_type string, body string, arrived long, arrived_at timestamp"
T0 = dt.datetime(2024, 5, 1)


def run(spark, tmp_path, parts, name):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in parts:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = sealing.seal_stream(source).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.table(name).collect()))
    finally:
        spark.conf.set(key, before)


def changes(n=40):
    rng, rows, at = random.Random(3), [], 0
    for i in range(n):
        for error in ("in_flight", None) if i % 3 else (None,):
            rows.append((i % 2, f"u{i}", T0, error, f'{{"call":{i},"done":{"true" if error is None else "false"}}}', 0, T0))
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[3] is None and r[1] in {x[1] for x in rows if x[3]})  # flights before their ends
    for r in rows:
        at += 1
        yield (*r[:5], at, T0 + dt.timedelta(seconds=at))


@pytest.mark.parametrize("size", [7, 40])
def test_stream_seals_as_a_batch_does(spark, tmp_path, size):
    rows = list(changes()) + [(0, None, T0, None, "{}", 999, T0)]
    got = run(spark, tmp_path, [rows[i : i + size] for i in range(0, len(rows), size)], f"sealed_{size}")
    batch = chain.build(sealing.completed_in_order(spark.createDataFrame(rows, SCHEMA))).collect()
    for c in (0, 1):
        want = [(r["body"], r["record_hash"]) for r in sorted(batch, key=lambda r: r["seq"]) if r["chain"] == c]
        assert [(r[2], r[4]) for r in got if r[0] == c] == want
        assert [r[1] for r in got if r[0] == c] == list(range(1, len(want) + 1))


def test_a_row_in_flight_settles_after_a_day_and_is_sealed_again_when_it_ends(spark, tmp_path):
    day = dt.timedelta(hours=30)
    parts = [[(0, "a", T0, "in_flight", "a1", 1, T0), (0, "b", T0, "in_flight", "b1", 2, T0)], [(0, "b", T0, None, "b2", 3, T0 + dt.timedelta(minutes=5))], [(1, "z", T0 + day, None, "z", 4, T0 + day)], [(1, "y", T0 + day, None, "y", 4, T0 + day)], [(0, "a", T0, None, "a2", 5, T0 + day)]]
    got = run(spark, tmp_path, parts, "settled")
    assert [(r[1], r[2]) for r in got if r[0] == 0] == [(1, "b2"), (2, "a1"), (3, "a2")]
    assert all(b[3] == a[4] for a, b in zip(got[:2], got[1:3]))
