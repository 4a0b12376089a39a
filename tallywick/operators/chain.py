"""Hash chains over ledger rows: building, verifying, tampering, anchors, and the cross-check with the ledger."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

GENESIS = "0" * 64


def link(prev: Column, body: Column) -> Column:
    """SHA-256 over the previous hash's 32 bytes and the body."""
    return F.sha2(F.concat(F.unhex(prev), body.cast("binary")), 256)


@F.pandas_udf(T.StringType())
def canonical_json(rows: pd.Series) -> pd.Series:
    """JSON with sorted keys, no spaces and ASCII escapes; null where the input is no JSON object or holds NaN."""

    def one(text: str | None) -> str | None:
        try:
            value = json.loads(text, parse_constant=lambda _: 1 / 0)
            return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False) if isinstance(value, dict) else None
        except (TypeError, ValueError, ZeroDivisionError):
            return None

    return rows.map(one)


def dealt(key: str) -> Column:
    """What to deal rows out by, so that a key's rows meet in one task. By the column itself Spark 4.1 would leave the
    exchange out above a union whose sides are dealt by it, while adaptive execution merges each side's partitions apart."""
    return F.xxhash64(key)


def build(bodies: DataFrame) -> DataFrame:
    """Link the bodies (chain, seq, body) of each chain in order of seq. A chain is a fold and so one task's work, but it
    streams through that task: rows are sorted by Spark, spilling as needed, and only the last hash is held."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, prev = None, GENESIS
        for batch in batches:
            before, own = [], []
            for chain, body in zip(batch["chain"], batch["body"], strict=True):
                prev = prev if chain == at else GENESIS
                before.append(prev)
                at, prev = chain, hashlib.sha256(bytes.fromhex(prev) + body.encode()).hexdigest()
                own.append(prev)
            yield batch.assign(prev_hash=before, record_hash=own)

    ordered = bodies.select("chain", "seq", "body").repartition(dealt("chain")).sortWithinPartitions("chain", "seq")
    return ordered.mapInPandas(fold, "chain long, seq long, body string, prev_hash string, record_hash string")


#: Records of a chain that one task orders; a longer chain is verified as several such stretches.
STRETCH = 65_536


def verify(records: DataFrame, bodies: bool = True) -> DataFrame:
    """Every break: chain, seq, kind. A record must follow the one before it in the log (``sequence``), carry that one's
    *stored* hash (``link``), have the hash of its body (``hash``), and hold canonical JSON (``body``, where asked for).

    The log's order is that of seq; of records that repeat a seq, each is held against the one before it, so a repetition
    breaks the sequence. So does a gap, which breaks the link too. One edit makes at most two breaks, as the stored hash
    is followed. Chains are cut into stretches; a stretch's first record is held against the last of those before it,
    found from one row per stretch, so a chain with a third of all records is many tasks' work.
    """
    own = records.withColumn("stretch", F.floor(F.col("seq") / STRETCH))
    here = F.struct("seq", "record_hash")
    lasts = own.groupBy("chain", "stretch").agg(F.max(here).alias("last"))
    carried = lasts.select("chain", "stretch", F.lag("last").over(Window.partitionBy("chain").orderBy("stretch")).alias("carried"))
    before = F.lag(here).over(Window.partitionBy("chain", "stretch").orderBy("seq", "record_hash"))
    joined = own.withColumn("before", before).join(carried, ["chain", "stretch"]).withColumn("before", F.coalesce("before", "carried"))
    kinds = [
        F.when(F.col("seq") != F.coalesce(F.col("before.seq"), F.lit(0)) + 1, "sequence"),
        F.when(F.col("prev_hash") != F.coalesce(F.col("before.record_hash"), F.lit(GENESIS)), "link"),
        F.when(F.col("record_hash") != link(F.col("prev_hash"), F.col("body")), "hash"),
    ]
    if bodies:
        kinds.append(F.when(~canonical_json("body").eqNullSafe(F.col("body")), "body"))
    return joined.select("chain", "seq", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


def heads(records: DataFrame) -> DataFrame:
    """The newest record of each chain: what an anchor publishes."""
    return records.groupBy("chain").agg(F.max("seq").alias("seq"), F.max_by("record_hash", "seq").alias("head"))


def append(records: DataFrame, bodies: DataFrame) -> DataFrame:
    """New bodies (chain, seq from 1, body) linked after each chain's head: only those are hashed, the log is not walked."""
    told = heads(records).withColumnRenamed("seq", "base")
    new = bodies.join(told, "chain", "left").select("chain", (F.col("seq") + F.coalesce("base", F.lit(0))).alias("seq"), "body", F.coalesce("head", F.lit(GENESIS)).alias("head"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, prev = None, GENESIS
        for batch in batches:
            before, own = [], []
            for chain, body, head in zip(batch["chain"], batch["body"], batch["head"], strict=True):
                prev = prev if chain == at else head
                before.append(prev)
                at, prev = chain, hashlib.sha256(bytes.fromhex(prev) + body.encode()).hexdigest()
                own.append(prev)
            yield batch.drop(columns="head").assign(prev_hash=before, record_hash=own)

    ordered = new.repartition(dealt("chain")).sortWithinPartitions("chain", "seq")
    return ordered.mapInPandas(fold, "chain long, seq long, body string, prev_hash string, record_hash string")


def importable(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """Chains that may be imported: those whole and unbroken from their first record, of which nothing is held yet."""
    broken = verify(incoming).select("chain").distinct()
    return incoming.select("chain").distinct().join(broken, "chain", "left_anti").join(held.select("chain"), "chain", "left_anti")


def check_anchors(records: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors that the chain does not honour: past its end (truncated), or another hash there (anchor). An anchor at 0
    is the genesis and says nothing."""
    ends = records.groupBy("chain").agg(F.max("seq").alias("last"))
    at = anchors.filter("seq > 0").join(records.select("chain", "seq", "record_hash"), ["chain", "seq"], "left").join(ends, "chain", "left")
    kind = F.when(F.col("seq") > F.coalesce("last", F.lit(0)), "truncated").when(F.col("record_hash").isNull() | (F.col("record_hash") != F.col("head")), "anchor")
    return at.select("chain", "seq", kind.alias("kind")).filter("kind IS NOT NULL")


def against_ledger(sealed: DataFrame, ledger: DataFrame) -> DataFrame:
    """The latest sealed body of each call against the ledger: unsealed, resealable, ledger_changed or ledger_missing.

    Both sides have call_uid, body and error_type. A call sealed in flight and completed since may be sealed again."""
    s = sealed.groupBy("call_uid").agg(F.max_by(F.struct("body", "error_type"), "seq").alias("s"))
    l = ledger.filter("call_uid IS NOT NULL").select("call_uid", F.struct("body", "error_type").alias("l"))  # noqa: E741
    both = s.join(l, "call_uid", "full_outer")
    settled = F.coalesce(F.col("s.error_type") == "in_flight", F.lit(False)) & F.coalesce(F.col("l.error_type") != "in_flight", F.lit(True))
    state = F.when(F.col("s").isNull(), "unsealed").when(F.col("l").isNull(), "ledger_missing").when(F.col("s.body") == F.col("l.body"), "sealed").when(settled, "resealable").otherwise("ledger_changed")
    return both.select("call_uid", state.alias("state"))

#: Ways to tamper with a chain whose hashes are all made anew after it, in the log alone (edit) or in log and ledger.
REWRITES = ("edit", "edit_both", "delete_both", "insert_both", "swap_both", "truncate_both", "replace_both")


def rewritten(bodies: DataFrame, targets: DataFrame) -> DataFrame:
    """Bodies (chain, seq, body) as a forger leaves them, of whom ``build`` then makes an unbroken chain.

    targets (chain, kind, at): at is the record that is edited, deleted, swapped with the next one, followed by a forged
    one, or the last one left. Each is arithmetic on numbers and bodies, so only the chain's new hashes are a fold.
    """
    own = bodies.join(targets, "chain")
    here = lambda *kinds: F.col("kind").isin(*kinds)
    after, at = F.col("seq") > F.col("at"), F.col("seq") == F.col("at")
    forged = F.concat(F.lit('{"forged":'), F.col("seq").cast("string"), F.lit("}"))
    gone = (here("delete_both") & at) | (here("truncate_both") & after)
    longest = bodies.groupBy("chain").agg(F.max("seq").alias("_last"))
    swaps = here("swap_both") & (F.col("at") < F.col("_last"))
    seq = (
        F.when(here("delete_both") & after, F.col("seq") - 1)
        .when(here("insert_both") & after, F.col("seq") + 1)
        .when(swaps & at, F.col("seq") + 1)
        .when(swaps & (F.col("seq") == F.col("at") + 1), F.col("seq") - 1)
        .otherwise(F.col("seq"))
    )
    body = F.when((here("edit", "edit_both") & at) | here("replace_both"), forged).otherwise(F.col("body"))
    kept = own.join(longest, "chain").filter(~gone).select("chain", seq.alias("_seq"), body.alias("_body")).toDF("chain", "seq", "body")
    new = targets.filter(here("insert_both")).select("chain", (F.col("at") + 1).alias("seq"), F.concat(F.lit('{"forged":'), F.col("at").cast("string"), F.lit("}")).alias("body"))
    return kept.unionByName(new)


def tamper_measure(bodies: DataFrame, targets: DataFrame, every: int = 20) -> DataFrame:
    """Per kind of tampering: chains, and those found by the chain itself, by anchors published before at each ``every``-th
    record, and by the ledger, which the kinds named both have changed too."""
    anchors = build(bodies).filter(F.col("seq") % every == 0).select("chain", "seq", F.col("record_hash").alias("head"))
    forged = rewritten(bodies, targets)
    log = build(forged)
    found = lambda df, name: df.select("chain").distinct().withColumn(name, F.lit(1))
    ledger = forged.join(targets.filter(F.col("kind") != "edit"), "chain", "left_semi").unionByName(bodies.join(targets.filter(F.col("kind") == "edit"), "chain", "left_semi"))
    differs = forged.toDF("chain", "seq", "sealed").join(ledger, ["chain", "seq"], "full").filter(~F.col("sealed").eqNullSafe(F.col("body")))
    all_of = targets.join(found(verify(log), "_c"), "chain", "left").join(found(check_anchors(log, anchors), "_a"), "chain", "left").join(found(differs, "_l"), "chain", "left")
    return all_of.groupBy("kind").agg(F.count(F.lit(1)).alias("chains"), F.count("_c").alias("by_chain"), F.count("_a").alias("by_anchor"), F.count("_l").alias("by_ledger"))
