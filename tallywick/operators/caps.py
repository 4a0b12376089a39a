"""Spend caps that hold together: a project's month, its day, its run, and the month of the portfolio that projects share.

A call is admitted if it fits under all of them, and only then spends, so each decision depends on those before it. Calls
of a portfolio are one key; its state is a number per window that is open and per run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallywick.operators.ordered import fold_by_key

#: The caps of a call, in the order in which a refusal names them: name, window, and the column that has it (null: none).
SCOPES = [("project", "month", "project_monthly_usd"), ("day", "day", "project_daily_usd"), ("run", "run", "per_run_usd"), ("portfolio", "month", "portfolio_monthly_usd")]
CALL = ["project", "run", "estimate", *[c for *_, c in SCOPES]]


def windows(calls: DataFrame, at: str) -> DataFrame:
    """calls with the month and day (UTC) that their caps count in."""
    return calls.withColumns({"month": F.date_format(at, "yyyy-MM"), "day": F.date_format(at, "yyyy-MM-dd")})


def _key(scope: str, window: str, row) -> tuple[str, str, str] | None:
    of = getattr(row, window)
    if of is None or (isinstance(of, float) and of != of):
        return None
    return scope, "" if scope == "portfolio" else str(row.project), str(of)


def admit(row, spent: Callable[[tuple], float], spend: Callable[[tuple, float], None]) -> str | None:
    """The first cap that a call would take past, strictly; if none, what it spends is noted for all of its windows."""
    keys = [(_key(scope, window, row), getattr(row, column)) for scope, window, column in SCOPES]
    for (scope, *_), (key, cap) in zip(SCOPES, keys, strict=True):
        if key is not None and cap is not None and cap == cap and spent(key) + row.estimate > cap:
            return scope
    for key, _ in keys:
        if key is not None:
            spend(key, row.estimate)
    return None


class _Open:
    """What is spent of the windows that are open: calls come in order, so a later month or day closes those before."""

    def __init__(self):
        self.spent: dict[tuple, float] = {}
        self.now: tuple[str, str] = ("", "")

    def step(self, row) -> tuple[str | None]:
        if (row.month, row.day) != self.now:
            self.now = row.month, row.day
            self.spent = {k: v for k, v in self.spent.items() if k[0] == "run" or k[2] in self.now}

        def spend(key: tuple, usd: float) -> None:
            self.spent[key] = self.spent.get(key, 0.0) + usd

        return (admit(row, lambda k: self.spent.get(k, 0.0), spend),)


def coupled_caps(calls: DataFrame, key: str, order: list[str], at: str = "at") -> DataFrame:
    """calls (project, run, estimate, a timestamp ``at`` and the caps' columns) with ``refused_by``: the first cap that
    each would take past in its order, or null. ``key`` names the portfolio. A null run has no cap of its own, and a null
    cap is none. Without an estimate a call asks for nothing and is admitted."""
    rows = windows(calls, at).withColumn("estimate", F.coalesce("estimate", F.lit(0.0)))
    told = fold_by_key(rows, key, order, _Open, lambda state, row: state.step(row), [T.StructField("refused_by", T.StringType())])
    return told.drop("month", "day")


class CapKeeper(StatefulProcessor):
    """The same over a stream: a portfolio's windows are a map, and a timer at the end of each month or day drops its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getMapState("spent", "scope string, project string, of string", "usd double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "seq"])

        def spent(k: tuple) -> float:
            return self.spent.getValue(k)[0] if self.spent.containsKey(k) else 0.0

        def spend(k: tuple, usd: float) -> None:
            if not self.spent.containsKey(k) and k[0] != "run":
                self.handle.registerTimer(_ends(k[2]))
            self.spent.updateValue(k, (spent(k) + usd,))

        refused = [admit(row, spent, spend) for row in batch.itertuples(index=False)]
        yield pd.DataFrame({"portfolio": [key[0]] * len(batch), "seq": batch["seq"].to_numpy(), "refused_by": refused})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        for k in [tuple(k) for k, _ in self.spent.iterator()]:
            if k[0] != "run" and _ends(k[2]) <= at:
                self.spent.removeKey(k)
        yield pd.DataFrame({"portfolio": pd.Series(dtype="str"), "seq": pd.Series(dtype="int64"), "refused_by": pd.Series(dtype="str")})

    def close(self) -> None:
        pass


def _ends(window: str) -> int:
    """When a month or day is over, in milliseconds."""
    start = pd.Timestamp(window + "-01" if len(window) == 7 else window)
    return int((start + (pd.DateOffset(months=1) if len(window) == 7 else pd.DateOffset(days=1))).value // 1_000_000)


def caps_stream(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """portfolio, seq, refused_by of a stream of calls (portfolio, seq, project, run, estimate, at and the caps' columns),
    which come in the order of their time but for rows of one batch. The session needs the RocksDB state store."""
    rows = windows(calls.withWatermark("at", late), "at").withColumn("estimate", F.coalesce("estimate", F.lit(0.0)))
    return rows.groupBy("portfolio").transformWithStateInPandas(CapKeeper(), "portfolio string, seq long, refused_by string", "Append", "EventTime")
