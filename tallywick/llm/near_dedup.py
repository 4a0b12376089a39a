"""Near-duplicate detection by MinHash bands, odd sketches and confirmation on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywick.llm.common import bounded, cut, give_back, mix, word_chunks

WIDTH = 5
BANDS, ROWS = 32, 4
#: MinHash values of a text: the first BANDS * ROWS make its bands, and all are folded into its odd sketch.
SAMPLES = 256
SKETCH_WORDS = 16
SKETCH_BITS = 64 * SKETCH_WORDS
#: Links are confirmed when 100 * intersection >= SHARE * union.
SHARE = 75
#: A candidate is dropped by its sketch only if its estimated similarity is below this. For a pair of similarity 0.75 the
#: estimate has a standard error of 0.027 from 256 samples and 0.012 from folding them, so this lies four of them below.
SKETCH_FLOOR = 0.62

_rng = np.random.default_rng(20240607)
_MULT = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_GRAM = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_SAMPLE = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The distinct 5-word shingles of a text's word hashes, sorted; with fewer words, the whole sequence as one."""
    n = len(words)
    if n == 0:
        return words
    if n < WIDTH:
        with np.errstate(over="ignore"):
            return mix(np.array([(words * _GRAM[:n]).sum() + np.uint64(n)], np.uint64))
    grams = words[: n - WIDTH + 1] * _GRAM[0]
    for i in range(1, WIDTH):
        grams = grams + words[i : n - WIDTH + 1 + i] * _GRAM[i]
    return np.unique(mix(grams + np.uint64(WIDTH)))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The shingle set of each text, in order; a text whose words come in several chunks is put together first."""
    held: list[np.ndarray] = []
    at = 0
    for chunk in word_chunks(texts):
        hashes = chunk.hashes()
        bounds = np.searchsorted(chunk.doc, np.arange(chunk.doc[0], chunk.doc[-1] + 2)) if len(chunk.doc) else []
        for k in range(len(bounds) - 1):
            i = int(chunk.doc[0]) + k
            if i > at:
                yield shingle_set(np.concatenate(held) if held else np.zeros(0, np.uint64))
                yield from (np.zeros(0, np.uint64) for _ in range(at + 1, i))
                held, at = [], i
            held.append(hashes[bounds[k] : bounds[k + 1]])
    if texts:
        yield shingle_set(np.concatenate(held) if held else np.zeros(0, np.uint64))
        yield from (np.zeros(0, np.uint64) for _ in range(at + 1, len(texts)))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES MinHash values (32 bits in uint64) of each non-empty set, 1024 shingles at a time."""
    out = np.empty((len(sets), SAMPLES), np.uint64)
    for i, own in enumerate(sets):
        best = None
        for at in range(0, len(own), 1024):
            low = ((own[at : at + 1024, None] * _MULT + _ADD) >> np.uint64(32)).min(axis=0)
            best = low if best is None else np.minimum(best, low)
        out[i] = best
    return out


def odd_sketches(low: np.ndarray) -> np.ndarray:
    """Fold each row of MinHash samples into a parity bitmap: every sample flips one of SKETCH_BITS bits."""
    n = len(low)
    bit = (mix(low * np.uint64(0x9E3779B97F4A7C15) + _SAMPLE) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount((bit + np.arange(n)[:, None] * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1, bitorder="little").view("<i8")


def max_differing_bits(floor: float = SKETCH_FLOOR) -> int:
    """The XOR population count of two sketches whose similarity is estimated as floor. Two sample sets that differ in
    d = 2 * SAMPLES * (1 - floor) values leave, on average, half of (1 - (1 - 2/bits)^d) of the bits odd."""
    d = 2 * SAMPLES * (1 - floor)
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** d))


SIGNATURE = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.iloc[at : at + 256]
            sets = list(shingle_sets(part["text"].tolist()))
            full = [s for s in sets if len(s)]
            low = minhashes(full)
            band = mix((low[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS) * _BAND).sum(axis=2, dtype=np.uint64) + _SALT) if full else np.zeros((0, BANDS), np.uint64)
            sketch = odd_sketches(low) if full else np.zeros((0, SKETCH_WORDS), np.int64)
            rows, k = [], 0
            for doc_id, s in zip(part["doc_id"].tolist(), sets, strict=True):
                doc_id = None if doc_id is None or doc_id != doc_id else int(doc_id)
                if len(s):
                    d1, d2 = np.bitwise_xor.reduce(s), mix(s).sum(dtype=np.uint64)
                    rows.append((doc_id, len(s), int(np.int64(d1.astype(np.int64))), int(np.int64(d2.astype(np.int64))), _signed(band[k]), sketch[k]))
                    k += 1
                else:
                    rows.append((doc_id, 0, None, None, None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"]).astype({"doc_id": "Int64", "d1": "Int64", "d2": "Int64"})
    give_back()


COMPARED = "a long, b long, common long, linked boolean, outside array<long>"
#: Texts that are compared with one copy of their common partner's text; a partner of more is sent once for each so many.
PARTNERS = 512


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (a, salt, b, text), of which those without b bring a's text: each b on its full shingle set against
    a's that came before: how many they share, whether that links them, and what b has outside a."""
    one = np.zeros(0, np.uint64)
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.iloc[at : at + 64]
            rows = []
            for a, b, two in zip(part["a"], part["b"], shingle_sets(part["text"].tolist()), strict=True):
                if pd.isna(b):
                    one = two
                    continue
                outside = two[~np.isin(two, one, assume_unique=True)]
                both = len(two) - len(outside)
                rows.append((a, int(b), both, 100 * both >= SHARE * (len(one) + len(outside)), _signed(outside)))
            yield pd.DataFrame(rows, columns=["a", "b", "common", "linked", "outside"])
    give_back()


def _sketches_near(a: str, b: str) -> Column:
    """What the signatures alone say: sizes whose ratio reaches SHARE, and odd sketches that differ in few enough bits."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    differing = [F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH_WORDS)]
    return (100 * F.least(n, m) >= SHARE * F.greatest(n, m)) & (sum(differing[1:], differing[0]) <= max_differing_bits())


def _close(a: str, b: str) -> Column:
    """What rules no link out: an upper bound on the intersection, and sizes and sketches."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    most = F.least(F.col(f"{a}.common"), F.col(f"{b}.common")) + F.least(F.col(f"{a}.beyond"), F.col(f"{b}.beyond"))
    return (100 * most >= SHARE * (n + m - most)) & _sketches_near(a, b)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node, root (the smallest node of its component), for nodes with an edge.

    Alternates the large-star and small-star steps until every component is a star around its smallest node. No step
    gathers a node's neighbours: each is a minimum per node, aggregated before the shuffle, and a join with it.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).filter("x <> y").distinct(), "edges")
    while True:
        files = 1 + now.count() // 500_000
        both = now.union(now.select("y", "x")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        small = large.groupBy("x").agg(F.min("y").alias("m"))
        hung = large.join(small, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y")
        now = cut(hung.union(small.select("x", F.col("m").alias("y"))).distinct().coalesce(files), "edges")
        n = now.agg(F.count(F.lit(1)).alias("all"), F.count_distinct("x").alias("leaves")).first()
        if n["all"] == n["leaves"] and now.join(now.select(F.col("y").alias("x")).distinct(), "x", "left_semi").isEmpty():
            return now.select(F.col("x").alias("node"), F.col("y").alias("root")).union(now.select("y", "y").distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents linked by similar 5-word shingle sets, and their connected components.

    Texts with equal sets form a class, so copies are never paired. Classes that share a band of MinHash values meet in
    a bucket. First each is a candidate with the most central class of its bucket, the one whose buckets are largest, and
    links make components. Then, where a bucket still holds several components, every pair across them is a candidate,
    once, however many buckets it shares, unless what both have in common with their centre, plus what each has beyond it
    that any other member has too, bounds their intersection too low. That bound must reach 3/7 of both sizes' sum, so
    6/7 of the smaller set's own size and 3/4 of the larger's: members below the one cannot be the smaller of a pair, and
    those below the other are in none, which leaves them out before any pair is formed. So of texts that share 50 to 70 %
    with each other and nothing more, none is left. Every candidate of either kind must pass the odd sketches, whose XOR
    population count estimates the similarity, and is then confirmed on full sets. So a large group of near copies costs
    one comparison for each of its texts, and few pairs. A text is sent to its comparisons once for each partner that it
    has there, a common partner once for each PARTNERS of them.

    32 bands of 4 values miss a pair of similarity 0.75 with probability 5e-6, the sketches with about 2e-5, and closer
    pairs with far less.

    Returns doc_id, n_shingles, component_id, kept, one row per row of docs. Null, empty and blank texts have an empty
    set and are linked with nothing. Rows that repeat an id are in one component and equally kept. A null id joins no
    component: its component_id is null and it is kept. An empty table gives no rows; further columns play no part.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(given.mapInPandas(_sign, SIGNATURE), "signatures")

    able = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(able.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "classes")
    copies = able.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).filter("doc_id <> rep").select("doc_id").distinct()
    reps = able.join(bounded(cut(copies, "copies")), "doc_id", "left_anti").withColumnRenamed("doc_id", "rep")

    keyed = reps.select("rep", F.explode("bands").alias("key"))
    buckets = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "buckets")
    members = cut(keyed.join(bounded(buckets), "key").select("key", "rep", "held"), "members")
    central = members.groupBy("rep").agg((-F.sum("held")).alias("far"))
    ranked = members.select("key", "rep").join(central, "rep")
    first = cut(ranked.groupBy("key").agg(F.min(F.struct("far", "rep")).alias("first")).select("key", F.col("first.rep").alias("first")), "centres")
    marks = reps.join(bounded(cut(members.select("rep").distinct(), "reps")), "rep", "left_semi")
    marks = cut(marks.select("rep", "n_shingles", "bands", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_WORDS)]), "sketches")

    star = members.join(first, "key").filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    sketch = marks.drop("bands")
    banded = star.join(sketch.alias("l"), F.col("a") == F.col("l.rep")).join(sketch.alias("r"), F.col("b") == F.col("r.rep"))
    star = cut(banded.select("a", "b", _sketches_near("l", "r").alias("near")), "pairs")
    # Members too far from their centre for a link are compared with it as well: bounds hold only if every member has them.
    stars = cut(_compared(star.select("a", "b"), given), "stars")
    links = stars.filter("linked").join(star.filter("near"), ["a", "b"], "left_semi").select("a", "b")
    roots = components(links)

    # Of what a class has beyond its centre, the part that another of the centre's classes has too.
    lone = stars.select("a", "b", F.explode("outside").alias("gram")).groupBy("a", "gram").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b")).filter("n = 1")
    lone = lone.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lone"))
    bounds = stars.select("a", "b", "common", F.size("outside").alias("beyond")).join(lone, ["a", "b"], "left")
    bounds = cut(bounds.select(F.col("a").alias("first"), F.col("b").alias("rep"), "common", (F.col("beyond") - F.coalesce("lone", F.lit(0))).alias("beyond")), "bounds")

    # Pairs across the components that a bucket still holds, each in the least of the buckets that it shares.
    rooted = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    rooted = cut(rooted, "rooted")
    open_ = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    open_ = cut(open_.join(first, "key"), "open")
    left = rooted.join(bounded(open_), "key").join(bounds, ["first", "rep"], "left").join(marks, "rep")
    left = left.withColumns({"common": F.coalesce("common", "n_shingles"), "beyond": F.coalesce("beyond", F.lit(0))})
    left = cut(left.filter("4 * (common + beyond) >= 3 * n_shingles"), "open-members")
    smaller = cut(left.filter("7 * (common + beyond) >= 6 * n_shingles"), "smaller-members")
    order = (F.col("l.n_shingles") < F.col("r.n_shingles")) | ((F.col("l.n_shingles") == F.col("r.n_shingles")) & (F.col("l.rep") < F.col("r.rep")))
    apart = order & (F.col("l.root") != F.col("r.root")) & _close("l", "r")
    once = F.array_min(F.array_intersect("l.bands", "r.bands")) == F.col("l.key")
    across = smaller.alias("l").join(left.alias("r"), (F.col("l.key") == F.col("r.key")) & apart & once)
    across = across.select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b")).join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = cut(_compared(cut(across, "pairs"), given).filter("linked").select("a", "b"), "links")
    roots = components(links.union(more)) if not more.isEmpty() else roots

    roots = cut(roots, "roots")
    several = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("root", "rep").alias("by_set"))
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(cut(several, "classes"), ["d1", "d2"], "left")
    out = out.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("by_set", "root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _compared(pairs: DataFrame, given: DataFrame) -> DataFrame:
    """Pairs (a, b) compared on the shingle sets of their whole texts; only texts in some pair are moved.

    The partners of an a are dealt into parts; each is one sorted run that a's text leads and that streams by it.
    """
    wanted = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")
    texts = cut(given.join(bounded(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), "texts")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    dealt = cut(pairs.join(bounded(parts), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt")), "dealt")
    heads = dealt.select("a", "salt").distinct().join(texts.toDF("a", "text"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    partners = dealt.join(texts.toDF("b", "text"), "b").select("a", "salt", "b", "text")
    runs = heads.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return runs.mapInPandas(_compare, COMPARED)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, with all columns of docs: the one with the smallest id.

    Only the ids that go are looked up, and sent to the documents where they are few enough, so that documents are not
    shuffled then, and once otherwise. Rows that repeat an id stay or go together. A null id, and a null, empty or blank
    text, is no copy of anything and stays; an empty table stays empty.
    """
    gone = cut(near_groups(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone_id")).distinct(), "gone")
    return docs.join(bounded(gone), docs["doc_id"] == F.col("_gone_id"), "left_anti")
