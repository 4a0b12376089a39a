"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over exact block quotas."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywick.llm.common import WORD, bounded, cut, shuffle_parts

#: No document is taken more often than this.
MAX_EPOCHS = 3
#: Words of an output shard, about 400 MB of text, and the shards there are at least.
SHARD_WORDS = 1 << 26
MIN_SHARDS = 64
#: Words of a block: a shard is drawn as so many blocks, unless they would be smaller or larger than these bounds.
BLOCKS_PER_SHARD = 1024
BLOCK_WORDS = (4096, 65_536)
#: The driver splits quotas down to so many nodes; below each, the tree goes on in tasks.
TOP_NODES = 512
#: The top of the tree has a number per node and group of sources. A source with at least its share of the draws is a
#: group of its own; the others are pooled, and each pool's draws are parted among its sources in tasks.
TOP_CELLS = 1 << 21
#: Blocks of a source, from the one that its target cuts, whose documents may be taken to meet it.
EDGE_BLOCKS = 16
#: Passes over those documents between two looks at whether another one is needed.
PASSES = 4
#: Draws that are listed at a time.
DRAWS = 4096
#: Blocks whose words are summed in one window.
CHUNK = 2048
SALTS = 64
#: A prime above any number of blocks: block * _PRIME mod n permutes the blocks 0 to n - 1.
_PRIME = (1 << 31) - 1


def split_quotas(quotas: np.ndarray, shards: int, seed: int, nodes: int | None = None) -> np.ndarray:
    """Exact block quotas per node (rows) and group of sources (columns). Each node of a binary tree hands its left half a
    multivariate hypergeometric draw of its blocks, so every node's mix is that of blocks dealt at random, and the
    columns still sum to the quotas. Without ``nodes`` the tree ends at the shards; else it ends there, and a node has
    blocks in proportion to its shards."""
    nodes = nodes or shards
    out = np.zeros((nodes, len(quotas)), np.int64)
    edge = [k * shards // nodes for k in range(nodes + 1)]

    def part(here: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = here
            return
        mid = (low + high) // 2
        total = int(here.sum())
        take = total * (edge[mid] - edge[low]) // (edge[high] - edge[low])
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(here, take, method="marginals") if 0 < take else np.zeros_like(here)
        part(left, low, mid)
        part(here - left, mid, high)

    part(quotas.astype(np.int64), 0, nodes)
    return out


def _source_key(source: Column) -> Column:
    """A source as a text that is never null, and sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def ranked_sources(by_source: DataFrame) -> DataFrame:
    """by_source with ``rank``, its place by code point from 0: ranges of sources, their counts, and places within each."""
    parts = shuffle_parts(by_source.sparkSession)
    ranged = cut(by_source.repartitionByRange(parts, "source").withColumn("range", F.spark_partition_id()), "ranged")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("range").orderBy("source")) - 1
    return ranged.withColumn("own", own).join(F.broadcast(counts), "range").withColumn("rank", (F.col("ahead") + F.col("own")).cast("long")).drop("range", "own", "ahead")


def capped_targets(sources: DataFrame, cap: float = MAX_EPOCHS) -> DataFrame:
    """Adds ``target``: all sizes shared by ``weight``; a target stops at cap times its source's size, and the excess is
    reshared by weight. Words per weight rise with each round, which is one sum over the sources, until none is above."""
    first = sources.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weight")).first()
    total, share, closed = first["all"] or 0, 0.0, -1
    open_weight, left = first["weight"] or 0.0, float(total)
    while True:
        share = left / open_weight if open_weight else share
        over = F.col("weight") * share > cap * F.col("source_size")
        now = sources.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("source_size"))).alias("size"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if now["n"] == closed or not now["weight"]:
            return sources.withColumn("target", F.least(cap * F.col("source_size").cast("double"), F.col("weight") * F.lit(share)))
        closed, open_weight, left = now["n"], now["weight"], max(total - cap * (now["size"] or 0), 0.0)


def _at_most(upto: Column, x: Column, most: int) -> Column:
    """How many entries of a sorted array of at most ``most`` are at most x, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])

    def step(low: Column, by: Column) -> Column:
        return F.when((low + by <= F.size(upto)) & (F.get(upto, low + by - 1) <= x), low + by).otherwise(low)

    return F.aggregate(steps, F.lit(0), step)


class Plan:
    """How sources are cut into blocks, how many of them are taken, and how shards draw them.

    ``sources`` has a row per source: source, source_size, target, blocks (of the source), whole (times that all its
    blocks are taken), edge (the permuted place of the block that the target cuts; -1: none), quota (blocks drawn),
    shards (those that draw from it) and upto (its draws that go to the shards before each and to it). ``changes`` has the
    documents about the edges whose number of copies differs from what their block's place says: source, place.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], shards: int | None, block_words: int | None, seed: int):
        self.seed, self.columns = seed, (id_col, text_col, source_col)
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
        rows = docs.select(F.col(id_col).alias("doc_id"), _source_key(F.col(source_col)).alias("source"), self.place().alias("place"), size.alias("size"))
        self.rows = cut(rows, "sizes")
        by_source = self.rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int"))
        ranked = cut(ranked_sources(by_source).withColumn("weight", weight), "ranked")
        about = ranked.agg(F.count(F.lit(1)).alias("n"), F.sum("source_size").alias("words")).first()
        words = about["words"] or 0
        self.shards = shards or max(MIN_SHARDS, -(-words // SHARD_WORDS))
        self.block_words = block_words or min(max(words // (self.shards * BLOCKS_PER_SHARD), BLOCK_WORDS[0]), BLOCK_WORDS[1])
        targets = capped_targets(ranked).withColumns({"blocks": F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / self.block_words))})
        whole = F.when(F.col("source_size") > 0, F.least(F.lit(MAX_EPOCHS), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
        targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        targets = cut(targets, "targets")
        edges = self._edges(targets)
        sources = targets.join(edges, "source", "left").withColumn("edge", F.coalesce("edge", F.lit(-1).cast("long")))
        sources = sources.withColumn("quota", F.col("whole") * F.col("blocks") + F.col("edge") + 1)
        planned = cut(sources.drop("weight"), "quotas")
        self.sources = cut(planned.drop("rank").join(self._split(planned), "source", "left"), "sources")
        self.changes = cut(self._changes(), "changes")

    def _split(self, planned: DataFrame) -> DataFrame:
        """The tree: source, shards, upto. Its top splits the quotas of groups among nodes, in the driver. What a node has
        of a pool of sources is then parted among them, and below a node its draws go on to its shards, each by the order of
        a seeded hash: cutting draws in random order is what a multivariate hypergeometric draw of their sources counts."""
        nodes = min(self.shards, TOP_NODES)
        most = TOP_CELLS // nodes
        total = planned.agg(F.sum("quota")).first()[0] or 0
        alone = (planned["quota"] * (most // 2) >= total) | F.lit(planned.count() <= most)
        grouped = planned.filter("quota > 0").select("source", "quota", F.when(alone, F.concat(F.lit("="), "source")).otherwise(F.pmod("rank", F.lit(most // 2)).cast("string")).alias("group"), alone.alias("alone"))
        drawn = sorted((r["group"], r["drawn"]) for r in grouped.groupBy("group").agg(F.sum("quota").alias("drawn")).collect())
        upto = np.cumsum(split_quotas(np.array([q for _, q in drawn], np.int64), self.shards, self.seed, nodes), axis=0) if drawn else np.zeros((nodes, 0), np.int64)
        top = planned.sparkSession.createDataFrame([(g, upto[:, i].tolist()) for i, (g, _) in enumerate(drawn)], "group string, upto array<long>")

        chunks = grouped.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / DRAWS)))).repartition("source", "chunk")
        last = F.least((F.col("chunk") + 1) * DRAWS, "quota") - 1
        draws = chunks.select("source", "group", "alone", F.explode(F.sequence(F.col("chunk") * DRAWS, last)).alias("draw"))
        order = lambda salt: [F.xxhash64("source", "draw", F.lit(self.seed), F.lit(salt)), "source", "draw"]
        pooled = F.row_number().over(Window.partitionBy("group").orderBy(*order("pool"))) - 1
        ranked = draws.filter("alone").withColumn("place", F.col("draw")).union(draws.filter("NOT alone").withColumn("place", pooled.cast("long")))
        at = ranked.join(F.broadcast(top), "group").select("source", "draw", _at_most(F.col("upto"), F.col("place"), nodes).cast("long").alias("node"))
        within = Window.partitionBy("node")
        # node k has the shards from k * shards / nodes on, and its draws are cut into as many equal parts
        low, high = F.floor(F.col("node") * self.shards / nodes), F.floor((F.col("node") + 1) * self.shards / nodes)
        at = at.withColumns({"nth": F.row_number().over(within.orderBy(*order("node"))) - 1, "all": F.count(F.lit(1)).over(within)})
        counts = at.groupBy("source", (low + F.floor(F.col("nth") * (high - low) / F.col("all"))).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
        sums = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("shard")))
        lists = sums.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "upto"))).alias("list"))
        return lists.select("source", F.col("list.shard").alias("shards"), F.col("list.upto").alias("upto"))

    def place(self) -> Column:
        """A document's place in the order of its source: a hash of what it is."""
        id_col, text_col, _ = self.columns
        return F.xxhash64(F.col(id_col), F.col(text_col), F.lit(self.seed))

    def _edges(self, targets: DataFrame) -> DataFrame:
        """Where each source's rest ends: the last permuted place whose block begins before it, and the words ahead of it."""
        cutting = targets.filter("rest > 0").select("source", "blocks", "rest")
        sums = self._with(self.rows.filter("size > 0"), cutting).withColumn("spot", _spot()).groupBy("source", "spot", "rest").agg(F.sum("size").alias("held"))
        sums = cut(sums.withColumn("chunk", F.floor(F.col("spot") / CHUNK)), "blocks")
        ahead = lambda *by: F.coalesce(F.sum("held").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
        chunks = sums.groupBy("source", "chunk", "rest").agg(F.sum("held").alias("held")).withColumn("base", ahead("source", "chunk"))
        last = chunks.filter("base < rest").groupBy("source").agg(F.max_by(F.struct("chunk", "base"), "chunk").alias("last")).select("source", "last.*")
        begun = sums.join(last, ["source", "chunk"]).withColumn("base", F.col("base") + ahead("source", "chunk", "spot"))
        return begun.filter("base < rest").groupBy("source").agg(F.max("spot").alias("edge"), F.max_by("base", "spot").alias("ahead"))

    def _with(self, df: DataFrame, plan: DataFrame) -> DataFrame:
        """df with the columns of its source's row of plan; plan goes to the tasks where it is small, else is salted."""
        whole = bounded(plan, text_bytes=256 + (12 * self.shards if "upto" in plan.columns else 0))
        if whole is not plan:
            return df.join(whole, "source")
        salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return df.withColumn("_salt", F.pmod("place", F.lit(SALTS)).cast("int")).join(salted, ["source", "_salt"]).drop("_salt")

    def _changes(self) -> DataFrame:
        """Documents of the blocks from the edge on that are taken once more, so that the target is met.

        In the order of their places, documents are taken while they go into what is missing; then, of those that are
        not too large for what is missing now, again, until none is left that would go into it. At last the document whose
        size fits best what is missing is added, if that comes nearer. So what a target misses, or has too much, is at
        most half the smallest document of those blocks that was not taken.
        """
        plan = self.sources.filter("edge >= 0").select("source", "blocks", "edge", F.col("rest") - F.col("ahead"))
        plan = plan.toDF("source", "blocks", "edge", "room")
        near = self._with(self.rows.filter("size > 0"), plan).withColumn("spot", _spot()).filter(f"spot >= edge AND spot < edge + {EDGE_BLOCKS}")
        rows = near.groupBy("source", "place").agg(F.sum("size").alias("size"), F.first("room").alias("room"))
        rows = cut(rows.withColumns({"more": F.lit(False), "gap": F.col("room")}), "edges")
        of_source = Window.partitionBy("source")
        upto = of_source.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        able = ~F.col("more") & (F.col("size") <= F.col("gap"))
        while not rows.filter(able).isEmpty():
            for _ in range(PASSES):
                rows = rows.withColumn("filled", F.sum(F.when(able, F.col("size"))).over(upto))
                rows = rows.withColumn("more", F.col("more") | (able & (F.col("filled") <= F.col("gap"))))
                rows = rows.withColumn("gap", F.col("room") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0)).over(of_source))
            rows = cut(rows.drop("filled"), "edges")
        miss = F.abs(F.col("gap") - F.col("size"))
        best = F.min(F.when(~F.col("more") & (miss < F.col("gap")), F.struct(miss.alias("miss"), "place"))).over(of_source)
        rows = rows.withColumn("best", best)
        return rows.filter(F.col("more") | (F.col("best.place") == F.col("place"))).select(F.col("source").alias("_source"), F.col("place").alias("_place"))

    def drawn(self, df: DataFrame) -> DataFrame:
        """df, which has source and place, with the columns of its source and ``shards``: of each copy that is taken, the
        shard that draws its block. Copy e of a document lies in the block's draw e of its source; the source's draws are
        permuted, and each shard draws as many of them as the tree gave it, from where the shard before it ended."""
        plan = self.sources.select("source", "source_size", "target", "blocks", "whole", "edge", "quota", F.col("shards").alias("_shards"), "upto")
        own = self._with(df, plan)
        changes = bounded(self.changes, text_bytes=256)
        own = own.join(changes, (own["source"] == changes["_source"]) & (own["place"] == changes["_place"]), "left")
        spot = _spot()
        copies = F.col("whole") + F.when((spot < F.col("edge")) | F.col("_place").isNotNull(), 1).otherwise(0)

        def shard(e: Column) -> Column:
            draw = F.least(e * F.col("blocks") + spot, F.col("quota") - 1)
            return F.get("_shards", _at_most(F.col("upto"), F.pmod(draw * _PRIME, F.col("quota")), self.shards))

        epochs = F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))
        return own.withColumn("shards", F.transform(epochs, shard)).drop("whole", "edge", "quota", "_shards", "upto", "_source", "_place")


def _spot() -> Column:
    """The permuted place of a document's block: blocks are classes of its source's documents by their place."""
    block = F.pmod(F.shiftrightunsigned("place", 16), F.col("blocks"))
    return F.pmod(block * _PRIME, F.col("blocks"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    shards: int | None = None,
    block_words: int | None = None,
    seed: int = 7,
) -> DataFrame:
    """Decide how often each document is taken, and into which output shards, so that sources meet their targets.

    Sources weigh ``weights``, repeating by code point, null last, and share all words up to three times their own. A
    source's documents are dealt by a hash into blocks of about ``block_words``, and its blocks are permuted. Its quota is
    the number of blocks whose words make up its target: all of them as often as they go into it, then the first of the
    permuted order, up to the block that the target cuts. The tree splits the quotas exactly among the shards, and each
    shard draws its part as the next of the permuted blocks, so that draws are disjoint. A document is taken as often as
    its block is drawn; of the block that the target cuts, and of the next few if it has not enough that fit, documents
    are taken, in the order of their hashes, that together come as near the target as they can.

    Returns doc_id, size, source_size, target, taken, and shards (the shard of each copy). Sizes count words; a null
    text has none, and a null source is a source of its own. A document without words is taken with its block and adds
    nothing. Rows that repeat an id are documents of their own, except that rows equal in id and text are taken alike.
    Where no document has a word, every target is 0. An empty table gives no rows; further columns of docs play no part.
    Any number of sources and shards is planned exactly. Reruns agree: every order comes from hashes of ids and texts, every
    draw from ``seed``. Shards grow in number with the words; a source's target is missed by half of one document at most,
    the smallest untaken one of the blocks about its edge. Documents are joined with rows of their sources alone.
    """
    plan = Plan(docs, id_col, text_col, source_col, weights, shards, block_words, seed)
    return plan.drawn(plan.rows).select("doc_id", "size", "source_size", "target", (F.size("shards") * F.col("size")).cast("long").alias("taken"), "shards")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), shards: int | None = None, block_words: int | None = None, seed: int = 7) -> DataFrame:
    """The mix itself: each document once per copy, with all columns of docs, sent to its shard and shuffled within it.

    A row finds its block by itself, so documents are shuffled once, to their shards. Repeated rows, null ids, null
    sources and texts are treated as mix() does. An empty table stays empty.
    """
    plan = Plan(docs, id_col, text_col, source_col, weights, shards, block_words, seed)
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), _source_key(docs[source_col]).alias("source"), plan.place().alias("place"))
    drawn = plan.drawn(held).select("_row", "place", F.posexplode("shards").alias("_epoch", "_shard"))
    parts = drawn.repartition(plan.shards, "_shard").sortWithinPartitions("_shard", F.xxhash64("place", "_epoch", F.lit(seed)))
    return parts.select("_row.*")
