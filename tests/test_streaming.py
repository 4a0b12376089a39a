from tallywick.operators import ordered
from tallywick.streaming import state


def run(query_name, df, mode, spark):
    q = df.writeStream.outputMode(mode).format("memory").queryName(query_name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(query_name).collect()


def stream(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_quota_stream_equals_batch(spark, tmp_path):
    schema = "team string, at double, seq long"
    parts = [[(f"t{i % 2}", float(i), i) for i in range(a, a + 20)] for a in (0, 20, 40)]
    got = {(r["team"], r["seq"]): r["allowed"] for r in run("quota", state.sliding_quota(stream(spark, tmp_path, parts, schema), 3, 10.0), "append", spark)}
    batch = ordered.sliding_quota(spark.createDataFrame([r for p in parts for r in p], schema), "team", "at", "seq", 3, 10.0)
    assert got == {(r["team"], r["seq"]): r["allowed"] for r in batch.collect()}


def test_events_across_batches(spark, tmp_path):
    parts = [[(1, 0, "data: a\n\nda"), (2, 0, "data: x")], [(1, 1, "ta: b\n\n"), (2, 1, "y\r\n\r\n")]]
    got = sorted((r["stream_id"], r["data"]) for r in run("events_in", state.decode_stream(stream(spark, tmp_path, parts, "stream_id long, seq long, body string")), "append", spark))
    assert got == [(1, "a"), (1, "b"), (2, "xy")]


def test_a_stream_ends_with_its_last_event(spark, tmp_path):
    euro = "data: €\n\n".encode()
    parts = [[(1, 0, euro[:7]), (2, 0, b"data\n\ndata:  x\rdata: y\r\n: note\r\n")], [(1, 1, euro[7:] + b"data: end"), (2, 1, b"\r\n")], [(1, 2, None)]]
    got = sorted((r["stream_id"], r["data"]) for r in run("events_end", state.decode_stream(stream(spark, tmp_path, parts, "stream_id long, seq long, body binary")), "append", spark))
    assert got == [(1, "end"), (1, "€"), (2, ""), (2, " x\rdata: y")]
    rows = [(s, q, b, 10 * q) for part in parts for s, q, b in part if b is not None] + [(3, 0, b"data: a\ndata: b", 7)]
    batch = ordered.decode_events(spark.createDataFrame(rows, "stream_id long, seq long, body binary, arrival_ms long")).collect()
    assert sorted(map(tuple, batch)) == [(1, 0, "€", 10), (1, 1, "end", 10), (2, 0, "", 0), (2, 1, " x\rdata: y", 10), (3, 0, "a\nb", 7)]


def test_maintained_spend_equals_recomputed(spark, tmp_path):
    schema = "project string, ts_utc string, cost_usd double"
    parts = [[(f"p{i % 3}", f"2024-0{1 + i % 2}-05", i / 7) for i in range(a, a + 15)] for a in (0, 15)]
    got = sorted(map(tuple, run("spend", state.maintained_spend(stream(spark, tmp_path, parts, schema)), "complete", spark)))
    assert got == sorted(map(tuple, state.maintained_spend(spark.createDataFrame([r for p in parts for r in p], schema)).collect()))
