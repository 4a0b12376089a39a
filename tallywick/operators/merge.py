"""Merging ledgers: idempotent merge, union that prefers completed calls, upserts, completeness, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IN_FLIGHT = "in_flight"


def _flying(col: Column) -> Column:
    return F.coalesce(col == IN_FLIGHT, F.lit(False))


def check_source(source: DataFrame, held: DataFrame) -> None:
    """A source with an unknown column, or a row without a key, is refused as a whole."""
    if extra := sorted(set(source.columns) - set(held.columns)):
        raise ValueError(f"the source has columns this ledger does not know: {', '.join(extra)}")
    if not source.filter("call_uid IS NULL").isEmpty():
        raise ValueError("the source has rows without call_uid")


def one_per_call(source: DataFrame, order: list[Column]) -> DataFrame:
    """One row per call: the first, unless it is in flight and a later copy is not. A minimum per key, so that copies are
    aggregated before the shuffle instead of being sorted by a window."""
    rank = F.struct(_flying(F.col("error_type")).alias("f"), *[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*source.columns).alias("row"))
    return source.groupBy("call_uid").agg(F.min(rank).alias("best")).select("best.row.*")


def classify(held: DataFrame, source: DataFrame) -> DataFrame:
    """Each call of either side with what a merge does: insert, complete, skip, or keep (not in the source)."""
    h, s = held.alias("h"), source.alias("s")
    both = h.join(s, "call_uid", "full_outer")
    none_held, none_given = F.col("h._held").isNull(), F.col("s._given").isNull()
    action = F.when(none_given, "keep").when(none_held, "insert").when(_flying(F.col("h.error_type")) & ~_flying(F.col("s.error_type")), "complete").otherwise("skip")
    return both.withColumn("action", action)


def merge(held: DataFrame, source: DataFrame, order: list[Column]) -> DataFrame:
    """The ledger after a merge by call_uid, with the action per row. Merging the same source again only skips."""
    check_source(source, held)
    columns = [c for c in held.columns if c != "call_uid"]
    given = one_per_call(source.select("call_uid", *[F.col(c) if c in source.columns else F.lit(None).cast(held.schema[c].dataType).alias(c) for c in columns]), order)
    both = classify(held.withColumn("_held", F.lit(1)), given.withColumn("_given", F.lit(1)))
    new = F.col("action").isin("insert", "complete")
    return both.select("call_uid", *[F.when(new, F.col(f"s.{c}")).otherwise(F.col(f"h.{c}")).alias(c) for c in columns], "action")


def merge_statistics(merged: DataFrame) -> DataFrame:
    n = lambda a: F.count(F.when(F.col("action") == a, 1))
    return merged.agg(n("insert").alias("inserted"), n("complete").alias("completed"), n("skip").alias("skipped"))


def union_completed(*ledgers: DataFrame) -> DataFrame:
    """Ledgers as one: per call, a completed copy before one in flight, then the earlier ledger's."""
    out = None
    for i, rows in enumerate(ledgers):
        rows = rows.withColumn("priority", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return one_per_call(out, [F.col("priority")])


def insert_or_ignore(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key is not held are added; the first copy of a key stays."""
    fresh = new.dropDuplicates(keys).join(held.select(*keys), keys, "left_anti")
    return held.unionByName(fresh)


def upsert_latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key, the latest."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), at).alias("r")).select(key, "r.*")


def completeness(claimed: DataFrame, delivered: DataFrame) -> DataFrame:
    """Per source, how many rows it claims and how many are held."""
    held = delivered.groupBy("source").agg(F.count(F.lit(1)).alias("held"))
    return claimed.join(held, "source", "left").select("source", "claimed", F.coalesce("held", F.lit(0)).alias("held"), (F.coalesce("held", F.lit(0)) - F.col("claimed")).alias("difference"))


def reconcile(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Two sums side by side by keys, either of which may be missing, with difference and percent."""
    both = ours.join(theirs, keys, "full_outer")
    a, b = F.coalesce("ours", F.lit(0.0)), F.coalesce("theirs", F.lit(0.0))
    return both.select(*keys, a.alias("ours"), b.alias("theirs"), F.round(a - b, 2).alias("difference"), F.when(b != 0, F.round(100 * (a - b) / b, 4)).alias("percent"))
