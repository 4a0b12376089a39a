"""The ordered and maintained operators over unbounded input, in Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallywick.operators.ordered import EventDecoder


def maintained_spend(calls: DataFrame) -> DataFrame:
    """Spend by project and month, kept up to date: run it in update or complete mode."""
    cost = F.col("cost_usd").cast("decimal(20,10)")
    return calls.groupBy("project", F.substring("ts_utc", 1, 7).alias("month")).agg(F.sum(cost).cast("double").alias("spend_usd"))


def windowed_events(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events by type and event-time window, with a bound on how late they may come."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))


def sliding_quota(requests: DataFrame, limit: int, window: float = 60.0) -> DataFrame:
    """Requests (team, at, seq) against a sliding quota; the state of a team is the times of its allowed requests in the
    window. Rows of a batch come in any order and are put into that of at and seq."""

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["at", "seq"])
        allowed = []
        for now in rows["at"]:
            held = [t for t in held if t > now - window]
            allowed.append(len(held) < limit)
            if allowed[-1]:
                held.append(float(now))
        state.update((held,))
        yield pd.DataFrame({"team": [key[0]] * len(rows), "seq": rows["seq"].to_numpy(), "allowed": allowed})

    return requests.groupBy("team").applyInPandasWithState(judge, "team string, seq long, allowed boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def decode_stream(chunks: DataFrame) -> DataFrame:
    """Events of streams whose chunks (stream_id, seq, body as text or binary) arrive over many batches. The state is what
    is not decoded yet; a chunk without a body ends its stream, whose last event then counts and whose state is dropped."""

    def decode(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        decoder, data, over = EventDecoder(state.get[0] if state.exists else b""), [], False
        for body in pd.concat(list(parts)).sort_values("seq")["body"]:
            over = body is None
            data += decoder.finish() if over else decoder.feed(body)
        if not over:
            state.update((decoder.held,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"stream_id": [key[0]] * len(data), "data": data})

    raw = chunks.withColumn("body", F.col("body").cast("binary"))
    return raw.groupBy("stream_id").applyInPandasWithState(decode, "stream_id long, data string", "held binary", "append", GroupStateTimeout.NoTimeout)


def into_merge(apply: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler that hands each batch to a merge once: of rows that repeat a call in a batch, one stays."""

    def handle(batch: DataFrame, epoch: int) -> None:
        apply(batch.dropDuplicates(["call_uid"]), epoch)

    return handle
