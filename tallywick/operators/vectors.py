"""Similarity lookups over stored vectors: exact hits, the nearest stored vector, and threshold curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    """The inner product in doubles; of unit vectors, the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, t: s + t)


def _nearest(queries: pd.DataFrame, store: pd.DataFrame, others: bool = False) -> pd.DataFrame:
    out = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
    if len(queries) and len(store):
        store = store.sort_values("id")
        table, ids = np.stack(store["v"].tolist()).astype(np.float64), store["id"].to_numpy(np.int64)
        found = []
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            # Rounded, so that the choice among equal similarities does not depend on how a block was multiplied.
            sims = np.round(np.stack(part["v"].tolist()).astype(np.float64) @ table.T, 9)
            own = part["id"].to_numpy(np.int64)
            if others:
                sims[own[:, None] == ids] = -np.inf
            best = sims.argmax(axis=1)
            found.append(pd.DataFrame({"query_id": own, "vec_id": ids[best], "similarity": sims[np.arange(len(part)), best]}).query("similarity > -inf"))
        out = pd.concat(found)
    return out


def nearest(queries: DataFrame, store: DataFrame, rows: int | None = None, others: bool = False) -> DataFrame:
    """The most similar stored vector of each query, the smallest id among equals: query_id, vec_id, similarity.

    Queries and store (id, scope, v) meet block by block within a scope; a block pair is one matrix product, and each
    query's best of all blocks wins. No task holds more than a block of either. With ``others``, the store's vector of the
    query's own id doesn't count."""
    n = store.count() if rows is None else rows
    blocks = max(1, -(-n // BLOCK))
    left = queries.select("id", "scope", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("qb")).withColumn("sb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = store.select("id", "scope", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("sb")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["scope", "qb", "sb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda q, s: _nearest(q, s, others), "query_id long, vec_id long, similarity double")
    best = found.groupBy("query_id").agg(F.min(F.struct((-F.col("similarity")).alias("neg"), "vec_id")).alias("b"))
    return best.select("query_id", F.col("b.vec_id").alias("vec_id"), (-F.col("b.neg")).alias("similarity"))


def curve(judged: DataFrame, low: int = 70, high: int = 99) -> DataFrame:
    """Per threshold from low to high hundredths: queries, hits that are right (``correct``), hits that are not, and rates.

    Each similarity is counted once, in the highest threshold that it reaches; a running sum over the thirty thresholds
    does the rest, so queries are not multiplied by the grid."""
    step = F.least(F.floor(F.col("similarity") * 100 + 1e-9).cast("int"), F.lit(high))
    counted = judged.groupBy(step.alias("step")).agg(F.count(F.when(F.col("correct"), 1)).alias("right"), F.count(F.when(~F.col("correct"), 1)).alias("wrong"))
    grid = judged.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("step"))
    upward = Window.orderBy(F.desc("step"))
    total = judged.agg(F.count(F.lit(1)).alias("queries"))
    held = grid.join(counted.filter(F.col("step") >= low), "step", "left").na.fill(0)
    held = held.select("step", F.sum("right").over(upward).alias("correct"), F.sum("wrong").over(upward).alias("wrong"))
    hits = F.col("correct") + F.col("wrong")
    return held.crossJoin(F.broadcast(total)).select(F.round(F.col("step") / 100, 2).alias("threshold"), "queries", "correct", "wrong", F.round(F.col("correct") / F.col("queries"), 9).alias("hit_rate"), F.when(hits > 0, F.round(F.col("wrong") / hits, 9)).alias("false_rate"))


def smallest_threshold(points: DataFrame, most_false: float = 0.02) -> DataFrame:
    """The lowest threshold with some hit and a false share of at most most_false; null if there is none."""
    return points.filter(((F.col("correct") + F.col("wrong")) > 0) & (F.col("false_rate") <= most_false)).agg(F.min("threshold").alias("threshold"))


def exact_hits(queries: DataFrame, store: DataFrame) -> DataFrame:
    """Queries whose scope and question hash are stored, with the first stored entry."""
    first = store.groupBy("scope", "question_hash").agg(F.min("id").alias("hit_id"))
    return queries.join(first, ["scope", "question_hash"])


def earlier_hits(asked: DataFrame) -> DataFrame:
    """Every question (id, scope, question_hash) with the first asking of it in its scope, if that is an earlier one: hit_id."""
    first = asked.groupBy("scope", "question_hash").agg(F.min("id").alias("first_id"))
    return asked.join(first, ["scope", "question_hash"], "left").withColumn("hit_id", F.when(F.col("first_id") < F.col("id"), F.col("first_id"))).drop("first_id")


def _pair_sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(left) and len(right):
        for other, part in right.groupby("label"):
            table, ids = np.stack(part["v"].tolist()).astype(np.float64), part["id"].to_numpy()
            for label, own in left.groupby("label"):
                for at in range(0, len(own), 256):
                    some = own.iloc[at : at + 256]
                    # Billionths as whole numbers, so that sums don't depend on the order of blocks.
                    sims = np.rint(np.stack(some["v"].tolist()).astype(np.float64) @ table.T * 1e9).astype(np.int64)
                    pair = some["id"].to_numpy()[:, None] != ids
                    out.append((label, other, int(pair.sum()), int(sims[pair].sum())))
    return pd.DataFrame(out, columns=["label", "other_label", "pairs", "billionths"])


def pair_matrix(vectors: DataFrame, rows: int | None = None) -> DataFrame:
    """Every vector (id, label, v) against every other one, summed by both labels: label, other_label, pairs, mean_similarity."""
    n = vectors.count() if rows is None else rows
    blocks = max(1, -(-n // BLOCK))
    all_blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    own = vectors.select("id", "label", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("own"))
    left, right = own.withColumnRenamed("own", "lb").withColumn("rb", all_blocks), own.withColumnRenamed("own", "rb").withColumn("lb", all_blocks)
    sums = left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInPandas(_pair_sums, "label int, other_label int, pairs long, billionths long")
    per = sums.groupBy("label", "other_label").agg(F.sum("pairs").alias("pairs"), F.sum(F.col("billionths").cast("decimal(38,0)")).alias("b")).filter("pairs > 0")
    return per.select("label", "other_label", "pairs", F.round(F.col("b").cast("double") / F.col("pairs") / 1e9, 6).alias("mean_similarity"))
