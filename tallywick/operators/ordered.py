"""Operators whose result depends on the order of a key's rows: sliding quotas, spend caps, cache replay, event streams.

Each streams sorted rows through Python once and holds a small state per key, never a key's rows: Spark sorts, spilling
as needed, and a partition may hold many keys.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_by_key(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable, added: list[T.StructField]) -> DataFrame:
    """Rows of each key in order, each with what ``step(state, row)`` returns for it; ``start`` makes a key's state."""
    names = [f.name for f in added]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (own := getattr(row, key)) != at:
                    at, state = own, start()
                out.append(step(state, row))
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    ordered = rows.repartition(key).sortWithinPartitions(key, *order)
    return ordered.mapInPandas(run, T.StructType([*rows.schema.fields, *added]))


def sliding_quota(requests: DataFrame, key: str, at: str, tie: str, limit: int, window: float = 60.0) -> DataFrame:
    """allowed and retry_after (seconds) of each request: at most ``limit`` allowed ones in any ``window`` seconds. A refused
    request does not count. ``at`` is a time in seconds."""

    def step(held: deque, row) -> tuple[bool, float | None]:
        now = getattr(row, at)
        while held and held[0] <= now - window:
            held.popleft()
        if len(held) >= limit:
            return False, held[0] + window - now
        held.append(now)
        return True, None

    return fold_by_key(requests, key, [at, tie], deque, step, [T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.DoubleType())])


def cap_admission(calls: DataFrame, key: str, at: str, caps: dict[str, float], portfolio: float) -> DataFrame:
    """Which cap, if any, refuses each call (project, estimate): its project's or the portfolio's, strictly exceeded. A
    refused call spends nothing, so a running sum would be wrong; all projects of a key share its portfolio."""

    def step(spent: dict, row) -> tuple[str | None]:
        own, whole = spent.get(row.project, 0.0), spent.get(None, 0.0)
        refused = "project" if own + row.estimate > caps.get(row.project, np.inf) else "portfolio" if whole + row.estimate > portfolio else None
        if refused is None:
            spent[row.project], spent[None] = own + row.estimate, whole + row.estimate
        return (refused,)

    return fold_by_key(calls, key, [at], dict, step, [T.StructField("refused_by", T.StringType())])


class _Replay:
    def __init__(self):
        self.first: dict[str, int] = {}
        self.table, self.family, self.n = np.zeros((16, 0)), [], 0

    def nearest(self, v: np.ndarray) -> tuple[int, float]:
        if not self.n:
            return -1, -1.0
        sims = np.round(self.table[: self.n] @ v, 9)
        best = int(sims.argmax())
        return best, float(sims[best])

    def store(self, question: str, v: np.ndarray, family: int) -> None:
        if self.table.shape[1] == 0:
            self.table = np.zeros((16, len(v)))
        if self.n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.n] = v
        self.first.setdefault(question, self.n)
        self.family.append(family)
        self.n += 1


def cache_replay(calls: DataFrame, scope: str, order: list[str], threshold: float, most: int | None = None) -> DataFrame:
    """Calls (question, family, storable, marked, v) of a scope in order, as a cache would have served them: outcome is
    exact, semantic, false (another family), miss, or out (unmarked: neither looked up nor stored). Only a storable miss is
    stored, up to ``most`` entries a scope, which is the cache's own size; among equals the earliest entry wins."""

    def step(cache: _Replay, row) -> tuple[str, float | None]:
        if not row.marked:
            return "out", None
        v = np.asarray(row.v, np.float64)
        if row.question in cache.first:
            return "exact", 1.0
        best, sim = cache.nearest(v)
        if best >= 0 and sim >= threshold:
            return ("semantic" if cache.family[best] == row.family else "false"), sim
        if row.storable and (most is None or cache.n < most):
            cache.store(row.question, v, row.family)
        return "miss", (sim if best >= 0 else None)

    return fold_by_key(calls, scope, order, _Replay, step, [T.StructField("outcome", T.StringType()), T.StructField("similarity", T.DoubleType())])


#: Where a blank line ends an event, and the data lines of one; a line ends at LF or CRLF.
_BLANK = re.compile(rb"(?:\A|(?<=\n))\r?\n")
_DATA = re.compile(rb"^data(?:: ?([^\n]*?))?\r?(?:\n|\Z)", re.M)


class EventDecoder:
    """Server-sent events from bytes that arrive in pieces: what blank lines part are events, and what is behind the last
    of them waits.

    Comments and other fields say nothing; several data lines are one event's; a field without a colon has no value.
    Bytes that are no UTF-8 become replacement characters, once their event is whole, so a character may be split.
    """

    def __init__(self, held: bytes = b""):
        self.held = held

    @staticmethod
    def _told(block: bytes) -> list[str]:
        values = [m[1] or b"" for m in _DATA.finditer(block)]
        return ["\n".join(v.decode("utf-8", "replace") for v in values)] if values else []

    def feed(self, piece: bytes) -> list[str]:
        """The data of the events that this piece completes."""
        *blocks, self.held = _BLANK.split(self.held + piece)
        return [data for block in blocks for data in self._told(block)]

    def finish(self) -> list[str]:
        """The stream is over: what it holds is its last event, though no blank line came."""
        last, self.held = self.held, b""
        return self._told(last)


def decode_events(chunks: DataFrame) -> DataFrame:
    """Events of streams that came as chunks (stream_id, seq, body as text or binary, arrival_ms): stream_id, n, data,
    arrival_ms. A stream's last event counts when the stream is over, as of its last chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, decoder, n, last, rows = None, None, 0, None, []

        def put(events: list[str]) -> None:
            nonlocal n
            for data in events:
                rows.append((at, n, data, last))
                n += 1

        for batch in batches:
            for stream_id, body, arrival in zip(batch["stream_id"], batch["body"], batch["arrival_ms"], strict=True):
                if decoder is None or stream_id != at:
                    if decoder is not None:
                        put(decoder.finish())
                    at, decoder, n = stream_id, EventDecoder(), 0
                last = arrival
                put(decoder.feed(body or b""))
            yield pd.DataFrame(rows, columns=["stream_id", "n", "data", "arrival_ms"])
            rows = []
        if decoder is not None:
            put(decoder.finish())
            yield pd.DataFrame(rows, columns=["stream_id", "n", "data", "arrival_ms"])

    ordered = chunks.select("stream_id", "seq", F.col("body").cast("binary").alias("body"), "arrival_ms").repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return ordered.mapInPandas(run, "stream_id long, n long, data string, arrival_ms long")


def assemble(events: DataFrame) -> DataFrame:
    """Text, first-token latency, last usage and end of each stream. Deltas without content, role or reasoning alone, do not
    count as a first token; the last usage block wins."""
    parsed = events.filter("data <> '[DONE]'").select("stream_id", "n", "arrival_ms", F.get_json_object("data", "$.delta").alias("delta"), F.get_json_object("data", "$.usage").cast("long").alias("usage"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.coalesce(F.col("delta"), F.lit("")) != "", F.struct("n", "delta")))), lambda e: e["delta"]), "")
    done = events.groupBy("stream_id").agg(F.max(F.col("data") == "[DONE]").alias("done"))
    out = parsed.groupBy("stream_id").agg(text.alias("text"), F.min(F.when(F.coalesce(F.col("delta"), F.lit("")) != "", F.col("arrival_ms"))).alias("first_token_ms"), F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("n"))).alias("usage"))
    return out.join(done, "stream_id")
