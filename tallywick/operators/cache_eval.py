"""Evaluating similarity caches: replays at many thresholds in one pass, their summary, and thresholds chosen on one half."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallywick.functions.statistics import wilson
from tallywick.operators.ordered import fold_by_key
from tallywick.operators.vectors import nearest

OUTCOME = T.StructType([T.StructField("threshold", T.DoubleType()), T.StructField("outcome", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("source", T.LongType())])


class _Caches:
    """The caches of a scope, one per threshold, over shared entries: an entry is held once, with a flag for each cache
    that stored it, so a call's similarity to an entry is computed once however many caches hold it."""

    def __init__(self, n: int):
        self.table, self.held = np.zeros((16, 0)), np.zeros((16, n), bool)
        self.family, self.source, self.n = [], [], 0
        self.exact: dict[str, np.ndarray] = {}

    def similarities(self, v: np.ndarray) -> np.ndarray:
        # Rounded, so that the choice among equal similarities does not depend on how many entries there are.
        return np.round(self.table[: self.n] @ v, 9) if self.n else np.zeros(0)

    def store(self, question: str, v: np.ndarray, family, source: int, caches: np.ndarray) -> None:
        if self.table.shape[1] == 0:
            self.table = np.zeros((16, len(v)))
        if self.n == len(self.table):
            self.table, self.held = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.held, np.zeros_like(self.held)])
        self.table[self.n], self.held[self.n] = v, caches
        known = self.exact.setdefault(question, np.full(len(caches), -1))
        known[caches & (known < 0)] = self.n
        self.family.append(family)
        self.source.append(source)
        self.n += 1


def replay_grid(calls: DataFrame, scope: str, order: list[str], thresholds: list[float], most: int | None = None) -> DataFrame:
    """Calls (id, question, family, storable, marked, v) with ``outcomes``: for each threshold what a cache of its own, in
    order, would have done, as cache_replay does for one: exact, semantic, false, miss or out, with the similarity and the
    stored call that it came from. Of equal similarities the earliest entry wins. A threshold's cache holds up to ``most``
    entries a scope, which is the cache's own size; what a replay holds is that, not the calls."""
    grid = np.array(thresholds, np.float64)

    def step(caches: _Caches, row) -> tuple[list]:
        if not row.marked:
            return ([(float(t), "out", None, None) for t in grid],)
        v, n = np.asarray(row.v, np.float64), caches.n
        sims = caches.similarities(v)
        same = caches.exact.get(row.question, np.full(len(grid), -1))
        out, missed = [], np.zeros(len(grid), bool)
        for k, t in enumerate(grid):
            if same[k] >= 0:
                out.append((float(t), "exact", 1.0, caches.source[same[k]]))
                continue
            own = np.where(caches.held[:n, k], sims, -np.inf)
            best = int(own.argmax()) if n else -1
            sim = float(own[best]) if n and own[best] > -np.inf else None
            if sim is not None and sim >= t:
                out.append((float(t), "semantic" if caches.family[best] == row.family else "false", sim, caches.source[best]))
            else:
                out.append((float(t), "miss", sim, None))
                missed[k] = row.storable and (most is None or caches.held[:n, k].sum() < most)
        if missed.any():
            caches.store(row.question, v, row.family, int(row.id), missed)
        return (out,)

    return fold_by_key(calls, scope, order, lambda: _Caches(len(grid)), step, [T.StructField("outcomes", T.ArrayType(OUTCOME))])


def by_threshold(replayed: DataFrame) -> DataFrame:
    """A row per call and threshold: the call's columns, threshold, outcome, similarity, source."""
    return replayed.select(*[c for c in replayed.columns if c != "outcomes"], F.inline("outcomes"))


def replay_summary(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of each threshold, and of each group of ``by``: calls, lookups, hits of each kind, what they cost and saved, distinct
    pairs of a question and the stored one that a similarity hit joined, how many of them are false, and hits whose cost is
    not known. outcomes has question, cost_usd and what by_threshold gives. Sums of money are decimals."""
    keys = ["threshold", *(by or [])]
    kind, cost = F.col("outcome"), F.coalesce(F.col("cost_usd").cast("decimal(20,10)"), F.lit(0))
    similar, hit = kind.isin("semantic", "false"), kind.isin("exact", "semantic", "false")
    money = lambda when: F.round(F.sum(F.when(when, cost).otherwise(0)), 6).cast("double")
    count = lambda when: F.count(F.when(when, 1))
    sums = outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), count(kind != "out").alias("looked_up"), count(hit).alias("hits"), count(kind == "exact").alias("exact_hits"), count(similar).alias("semantic_hits"), count(kind == "false").alias("semantic_false"),
        money(F.lit(True)).alias("spend_usd"), money(hit).alias("saved_usd"), money(similar).alias("saved_semantic_usd"), count(hit & F.col("cost_usd").isNull()).alias("uncosted_hits"),
    )
    pairs = outcomes.filter(similar).groupBy(*keys, "question", "source").agg(F.max(F.when(kind == "false", 1).otherwise(0)).alias("false"))
    pairs = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.sum("false").alias("pairs_false"))
    joined = sums.join(pairs, keys, "left").na.fill(0, ["pairs", "pairs_false"])
    low, high = wilson(F.col("pairs_false"), F.col("pairs"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return joined.withColumns({"hit_rate": rate("hits", "looked_up"), "false_of_semantic": rate("semantic_false", "semantic_hits"), "saved_share": rate("saved_usd", "spend_usd"), "pairs_low": F.when(F.col("pairs") > 0, F.round(low, 6)), "pairs_high": F.when(F.col("pairs") > 0, F.round(high, 6))})


def hit_rows(outcomes: DataFrame) -> DataFrame:
    """What the ledger gets for each hit: the call's id, no cost, ``cached``, the similarity to six places and the id of the
    call whose answer was given."""
    hit = outcomes.filter(F.col("outcome").isin("exact", "semantic", "false"))
    return hit.select(F.col("id").alias("call_id"), "threshold", F.lit(0.0).alias("cost_usd"), F.lit("cached").alias("served"), F.round("similarity", 6).alias("cache_similarity"), F.col("source").alias("source_id"))


def curves(judged: DataFrame, by: list[str], grid: list[float]) -> DataFrame:
    """Per group and threshold: queries, hits that are right and wrong, and their rates. judged has by, similarity and
    correct. A query counts once, at the highest threshold that it reaches, and a running sum does the rest."""
    steps = F.array(*[F.lit(t) for t in sorted(grid)])
    reached = F.size(F.filter(steps, lambda t: t <= F.col("similarity") + 1e-9))
    counted = judged.withColumn("_step", reached).groupBy(*by, "_step").agg(F.count(F.when(F.col("correct"), 1)).alias("right"), F.count(F.when(~F.col("correct"), 1)).alias("off"), F.count(F.lit(1)).alias("n"))
    grids = counted.groupBy(*by).agg(F.sum("n").alias("queries")).select(*by, "queries", F.posexplode(steps).alias("_at", "threshold")).withColumn("_step", F.col("_at") + 1)
    upward = Window.partitionBy(*by).orderBy(F.desc("_step"))
    held = grids.join(counted.drop("n"), [*by, "_step"], "left").na.fill(0, ["right", "off"])
    held = held.select(*by, "threshold", "queries", F.sum("right").over(upward).alias("correct"), F.sum("off").over(upward).alias("wrong"))
    hits = F.col("correct") + F.col("wrong")
    return held.withColumns({"hit_rate": F.round(F.col("correct") / F.col("queries"), 6), "false_rate": F.when(hits > 0, F.round(F.col("wrong") / hits, 6))})


def chosen(points: DataFrame, by: list[str], most_false: float = 0.02) -> DataFrame:
    """The smallest threshold of each group whose hits are wrong at most so often; null where none qualifies."""
    able = F.when((F.col("correct") + F.col("wrong") > 0) & (F.col("wrong") <= F.lit(most_false) * (F.col("correct") + F.col("wrong"))), F.col("threshold"))
    return points.groupBy(*by).agg(F.min(able).alias("chosen"))


def evaluate(queries: DataFrame, store: DataFrame, grid: list[float], most_false: float = 0.02, choose_kind: str = "paraphrase") -> DataFrame:
    """A cache judged by scope, half (``odd`` or ``even`` ids) and kind of query: every threshold's counts and rates, and
    the one chosen for the scope on the odd half's paraphrases alone, null where none qualifies.

    queries has id, scope, split, kind, v, family; store id, scope, split, v, family. A query meets the store of its own
    scope and half; it is right where the nearest entry is of its family.
    """
    place = F.concat_ws("\u001f", "scope", "split")
    asked = queries.select("id", "kind", "family", "split", F.col("scope").alias("own_scope"), place.alias("scope"), "v")
    kept = store.select("id", place.alias("scope"), "v", F.col("family").alias("stored_family"))
    numbered = asked.withColumn("qid", F.xxhash64("id", "kind", "scope"))
    near = nearest(numbered.select(F.col("qid").alias("id"), "scope", "v"), kept)
    judged = near.join(numbered.select(F.col("qid").alias("query_id"), "kind", "family", "split", F.col("own_scope").alias("scope")), "query_id").join(kept.select(F.col("id").alias("vec_id"), "stored_family"), "vec_id")
    points = curves(judged.withColumn("correct", F.col("family") == F.col("stored_family")), ["scope", "split", "kind"], grid)
    told = chosen(points.filter((F.col("split") == "odd") & (F.col("kind") == choose_kind)), ["scope"], most_false)
    return points.join(told, "scope", "left")


def half(id_col: Column) -> Column:
    return F.when(F.pmod(id_col, F.lit(2)) == 1, "odd").otherwise("even")


def crossed_scopes(replayed: DataFrame, calls: DataFrame, scope: str) -> DataFrame:
    """Hits whose stored call is of another scope: none, if scopes are kept apart."""
    stored = calls.select(F.col("id").alias("source"), F.col(scope).alias("_stored_scope"))
    hits = by_threshold(replayed).filter("source IS NOT NULL").join(stored, "source")
    return hits.filter(F.col(scope) != F.col("_stored_scope")).select("id", "threshold", "source")
