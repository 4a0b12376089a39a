"""Sealing as a stream: rows of a ledger join their chain as they complete, or once they have been in flight for a day."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallywick.operators.chain import GENESIS

IN_FLIGHT = "in_flight"
SEALED = "chain long, seq long, body string, prev_hash string, record_hash string, call_uid string"


class Sealer(StatefulProcessor):
    """The state of a chain: its head, and the rows that are in flight, each with when it settles. A timer stands for each
    of those; what is sealed is no longer held, so the state is the calls in flight and one hash."""

    def __init__(self, settle_ms: int):
        self.settle_ms = settle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "seq long, hash string")
        self.flying = handle.getMapState("flying", "call_uid string", "body string, due long")

    def _sealed(self, chain: int, rows: list[tuple[str, str]]) -> pd.DataFrame:
        """Link bodies behind the head, and move it."""
        seq, prev = self.head.get() if self.head.exists() else (0, GENESIS)
        out = []
        for uid, body in rows:
            own = hashlib.sha256(bytes.fromhex(prev) + body.encode()).hexdigest()
            seq += 1
            out.append((chain, seq, body, prev, own, uid))
            prev = own
        if out:
            self.head.update((seq, prev))
        return pd.DataFrame(out, columns=["chain", "seq", "body", "prev_hash", "record_hash", "call_uid"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = []
        for row in pd.concat(list(rows)).sort_values("arrived").itertuples(index=False):
            due = int(row.began.value // 1_000_000) + self.settle_ms
            if row.error_type == IN_FLIGHT and due > timerValues.getCurrentWatermarkInMs():
                self.flying.updateValue((row.call_uid,), (row.body, due))
                self.handle.registerTimer(due)
                continue
            if self.flying.containsKey((row.call_uid,)):
                self.flying.removeKey((row.call_uid,))
            done.append((row.call_uid, row.body))
        yield self._sealed(key[0], done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((value[1], uid[0], value[0]) for uid, value in self.flying.iterator() if value[1] <= at)
        for _, uid, _ in due:
            self.flying.removeKey((uid,))
        yield self._sealed(key[0], [(uid, body) for _, uid, body in due])

    def close(self) -> None:
        pass


def seal_stream(changes: DataFrame, settle_hours: int = 24, late: str = "1 hour") -> DataFrame:
    """Records of chains from a stream of a ledger's rows (chain, call_uid, began, error_type, body, arrived long,
    arrived_at timestamp), one for each row that has completed, in the order in which they arrived.

    A row in flight waits; its completed version takes its place. One that is still in flight ``settle_hours`` after it
    began, by the watermark over arrived_at, is sealed as it stands, and again once it completes. How the rows are cut
    into batches changes nothing of what completed rows become, as their order is that of ``arrived``. Rows without a
    call_uid are left out. The session needs the RocksDB state store.
    """
    own = changes.filter("call_uid IS NOT NULL").withWatermark("arrived_at", late)
    return own.groupBy("chain").transformWithStateInPandas(Sealer(settle_hours * 3_600_000), SEALED, "Append", "EventTime")


def completed_in_order(changes: DataFrame) -> DataFrame:
    """The same rows in one batch, as chain.build() takes them: chain, seq, body of what is not in flight."""
    done = changes.filter(F.col("call_uid").isNotNull() & ~F.coalesce(F.col("error_type") == IN_FLIGHT, F.lit(False)))
    return done.select("chain", F.col("arrived").alias("seq"), "body")
