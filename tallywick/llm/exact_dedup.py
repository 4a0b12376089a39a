"""Exact deduplication by a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywick.llm.common import bounded, cut, shuffle_parts

#: What two equal texts agree in: a SHA-256 digest, verified at every merge by an independent hash and the length.
KEY = ["digest", "check", "check_len"]
#: Runs that one merge takes: two binomial rounds, of pairs and of pairs of pairs, are done as one four-way merge.
FAN_IN = 4


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row per document: id, code points, digest of the text without ASCII white space, and what verifies it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_points"), F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").alias("bare"))
    return bare.select("doc_id", "n_points", F.unhex(F.sha2("bare", 256)).alias("digest"), F.xxhash64("bare").alias("check"), F.octet_length("bare").alias("check_len"))


def _merged(entries: DataFrame, node: Column, nodes: int) -> DataFrame:
    """Send the entries to their nodes, sort each node's runs by digest into one, and keep the best entry of each digest.

    The node is the partition, so the aggregate needs no further exchange: it reads the sorted run once.
    """
    sent = entries.withColumn("node", node).repartition(nodes, "node").sortWithinPartitions("node", *KEY)
    return sent.groupBy("node", *KEY).agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def _digit(of: Column, place: int, fan_in: int) -> Column:
    return F.pmod(F.floor(of / fan_in**place), F.lit(fan_in))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """Groups of texts that are equal once ASCII white space is deleted.

    Documents are dealt by a hash of their id to as many nodes as a power of ``fan_in`` gives, at least one per shuffle
    partition. Each node sorts its entries by digest into a run and keeps the best of each digest. Then nodes exchange
    runs in rounds: in round r the ``fan_in`` nodes whose numbers differ in digit r alone part their digests among
    themselves by that digit of the digest's own home, and each merges what it gets, so that every merge is of sorted
    runs and keeps the smallest verified entry and the count. After the last round each digest is at its home, and no
    node ever holds more than its share of the digests. A digest that a third of all rows have meets at most ``fan_in``
    entries in any merge. The winners then go to the first runs, of which a digest has one entry per node at most, and
    from there to the rows of that run.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per row of docs. The row with the most code points
    stays, then the one with the smallest id; a null id comes last. Null texts count as empty; empty texts form one
    group. Rows that repeat an id and a text are the same document: all of them are kept. An empty table gives no rows;
    other columns of docs, whatever their names, play no part.
    """
    parts, rounds = shuffle_parts(docs.sparkSession), 1
    while fan_in**rounds < parts:
        rounds += 1
    nodes = fan_in**rounds
    start = F.pmod(F.xxhash64("doc_id", "n_points", "check"), F.lit(nodes))
    rows = cut(signatures(docs, id_col, text_col).withColumn("run", start), "digests")

    best = F.struct((-F.col("n_points")).alias("neg"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    runs = cut(_merged(rows.select(*KEY, "run", best.alias("best"), F.lit(1).cast("long").alias("size")), F.col("run"), nodes), "runs")
    home = F.pmod(F.xxhash64("digest"), F.lit(nodes))
    merged = runs
    for r in range(rounds):
        swapped = F.col("node") + (_digit(home, r, fan_in) - _digit(F.col("node"), r, fan_in)) * fan_in**r
        merged = _merged(merged, swapped.cast("long"), nodes)

    won = runs.select(*KEY, F.col("node").alias("run")).join(merged.select(*KEY, "best", "size").filter("size > 1"), KEY)
    out = rows.join(won, [*KEY, "run"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("size").isNull() | F.col("doc_id").eqNullSafe(F.col("best.id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of equal texts, with all columns of docs.

    Only what goes is looked up, by id and a hash of the text, and sent to the documents where it is small; so they are
    not shuffled then, and once otherwise. Of rows that repeat an id and a text up to white space, and stay, one stays.
    Null ids are one id here, null texts count as empty, and an empty table stays empty.
    """
    own = [docs[c] for c in docs.columns]
    groups = exact_groups(docs).filter("group_size > 1").groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    odd = cut(groups.filter("NOT kept OR n > 1").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha"), "kept", "n"), "copies")
    gone, repeated = odd.filter("NOT kept").select("_id", "_sha"), odd.filter("kept").select("_id", "_sha")
    sha = F.unhex(F.sha2(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), r"[\x20\x09-\x0D]+", ""), 256))

    def among(some: DataFrame):
        return docs["doc_id"].eqNullSafe(some["_id"]) & (sha == some["_sha"])

    gone, repeated = bounded(gone, text_bytes=48), bounded(repeated, text_bytes=48)
    if repeated.isEmpty():
        return docs.join(gone, among(gone), "left_anti")
    twice = docs.join(repeated, among(repeated), "left_semi").withColumn("_same", sha).dropDuplicates(["doc_id", "_same"]).select(*docs.columns)
    both = bounded(odd.select("_id", "_sha"), text_bytes=48)
    return docs.join(both, among(both), "left_anti").select(*own).unionByName(twice)
