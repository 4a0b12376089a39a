"""Exact top-k inner-product search over a bit-sliced index: for each slice of each attribute, a bitmap over the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywick.llm.common import cut

SCALE = 256
K = 5
#: Queries and rows that meet in one task. Rows are sent once per block of queries, queries once per block of rows.
QUERY_BLOCK = 4096
ROW_BLOCK = 16_384
#: Most significant slices of an attribute that the index holds; what the others may add is bounded, and resolved exactly.
SLICES = 6


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of every component as a double; null for a vector that is null or holds a null, NaN or infinity."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(embedding.isNotNull() & fine, F.transform(x, lambda v: F.floor(v * SCALE).cast("long")))


def signed_digits(n: int) -> list[tuple[int, int]]:
    """n as a sum of sign * 2^place with no two places adjacent, which is the fewest digits: (place, sign)."""
    out, place = [], 0
    while n:
        if n & 1:
            sign = 2 - (n & 3)
            out.append((place, sign))
            n -= sign
        n >>= 1
        place += 1
    return out


class SliceIndex:
    """A block of rows as bitmaps: slice s of attribute d has a bit per row, set where bit s of the row's value is.

    Values are offset to be non-negative and quantised to SLICES slices by leaving out ``drop`` lower bits. Each slice is
    held with its complement, which stands for a negative coefficient. A bitmap has one 64-bit word per 64 rows.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, slices: int = SLICES):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids = rows[order], ids[order]
        n, dims = rows.shape
        self.low = int(rows.min()) if rows.size else 0
        offset = (self.rows - self.low).astype(np.uint64)
        bits = max(1, int(offset.max()).bit_length() if rows.size else 1)
        self.drop = max(0, bits - slices)
        self.bits = bits - self.drop
        self.words = -(-n // 64)
        kept = np.zeros((dims, self.words * 64), np.uint64)
        kept[:, :n] = (offset >> np.uint64(self.drop)).T
        planes = [np.packbits(((kept >> np.uint64(s)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for s in range(self.bits)]
        #: By sign, slice and attribute.
        self.planes = np.stack([np.stack(planes), ~np.stack(planes)])
        self.present = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view(np.uint64)

    def added(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the sum, over attributes, of the query's value times the quantised value, least significant first, and
        what is to be added to it. A product is a slice shifted by each digit of the query's value; slices of one weight
        are added three at a time, leaving one of that weight and one carry."""
        weights: dict[int, list[tuple[int, int, int]]] = {}
        fixed = 0
        for d, value in enumerate(query.tolist()):
            for place, sign in signed_digits(value):
                for s in range(self.bits):
                    weights.setdefault(place + s, []).append((0 if sign > 0 else 1, s, d))
                if sign < 0:
                    fixed -= ((1 << self.bits) - 1) << place
        out: list[np.ndarray] = []
        carried = np.zeros((0, self.words), np.uint64)
        w = 0
        while w <= max(weights, default=-1) or len(carried):
            own = weights.get(w)
            heap = carried
            if own:
                g, s, d = np.array(own).T
                heap = np.concatenate([carried, self.planes[g, s, d]])
            carries = []
            while len(heap) > 2:
                m = len(heap) // 3
                a, b, c = heap[:m], heap[m : 2 * m], heap[2 * m : 3 * m]
                half = a ^ b
                carries.append((a & b) | (half & c))
                heap = np.concatenate([half ^ c, heap[3 * m :]])
            if len(heap) == 2:
                carries.append((heap[0] & heap[1])[None])
                heap = (heap[0] ^ heap[1])[None]
            out.append(heap[0] if len(heap) else np.zeros(self.words, np.uint64))
            carried = np.concatenate(carries) if carries else np.zeros((0, self.words), np.uint64)
            w += 1
        return out, fixed

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than own, ties to smaller ids."""
        allowed = self.present.copy()
        for at in range(int(np.searchsorted(self.ids, own)), int(np.searchsorted(self.ids, own, side="right"))):
            allowed[at // 64] &= ~np.uint64(1 << at % 64)
        slices, _ = self.added(query)
        able = allowed
        if int(np.bitwise_count(allowed).sum()) > k:
            # The k-th largest sum, a bit at a time from the most significant slice downward.
            sure, open_, bound, have = np.zeros_like(allowed), allowed, 0, 0
            for w in range(len(slices) - 1, -1, -1):
                on = open_ & slices[w]
                n = int(np.bitwise_count(on).sum())
                if have + n >= k:
                    open_, bound = on, bound | 1 << w
                else:
                    sure, have, open_ = sure | on, have + n, open_ & ~slices[w]
            # A row's true score lies between its sum and its sum and what the slices left out can add.
            slack = int(np.abs(query).sum()) * ((1 << self.drop) - 1) >> self.drop
            able = allowed & self.at_least(slices, bound - slack - 1)
        which = np.flatnonzero(np.unpackbits(able.view(np.uint8), bitorder="little"))
        score = self.rows[which] @ query
        best = np.lexsort((self.ids[which], -score))[:k]
        return self.ids[which][best], score[best]

    def at_least(self, slices: list[np.ndarray], bound: int) -> np.ndarray:
        """Rows whose sum is at least bound."""
        above, equal = np.zeros(self.words, np.uint64), ~np.zeros(self.words, np.uint64)
        if bound <= 0:
            return equal
        for w in range(len(slices) - 1, -1, -1):
            if bound >> w & 1:
                equal = equal & slices[w]
            else:
                above |= equal & slices[w]
                equal = equal & ~slices[w]
        return above | equal


def _searcher(k: int):
    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            index = SliceIndex(np.stack(rows["v"].tolist()).astype(np.int64), rows["id"].to_numpy(np.int64))
            for own, v in zip(queries["id"].tolist(), queries["v"], strict=True):
                best, score = index.top(np.asarray(v, np.int64), own, k)
                out["query_id"] += [own] * len(best)
                out["vec_id"] += best.tolist()
                out["score"] += score.tolist()
        return pd.DataFrame(out).astype("int64")

    return search


def _up_to(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k highest integer inner products over all other rows: query_id, rank, vec_id, score.

    Rows are dealt into blocks and queries into blocks; every pair of blocks is one task's work. It builds the block's
    index, adds the slices that a query's digits select, finds the k-th best sum from the most significant slice
    downward, and scores exactly the rows whose sum comes as near to it as the quantisation leaves open. The best k of
    each block are ranked. So no task holds more than a block of either.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Vectors are
    compared with those of the same length only. Rows that repeat an id are candidates each; a query's own id never is.
    With fewer than k candidates a query has all of them; an empty table gives no rows; further columns play no part.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v"), is_query.alias("asks"))
    rows = cut(rows.filter("id IS NOT NULL AND v IS NOT NULL").withColumn("dims", F.size("v")), "vectors")
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("asks"), 1)).alias("asked")).first()
    row_blocks, query_blocks = max(1, -(-n["all"] // ROW_BLOCK)), max(1, -(-n["asked"] // QUERY_BLOCK))
    dealt = F.xxhash64("id")
    queries = rows.filter("asks").dropDuplicates(["id"]).select("id", "v", "dims", F.pmod(dealt, F.lit(query_blocks)).alias("qb"), F.explode(_up_to(row_blocks)).alias("rb"))
    spread = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(row_blocks))
    candidates = rows.select("id", "v", "dims", F.explode(_up_to(query_blocks)).alias("qb"), spread.alias("rb"))
    found = queries.groupBy("qb", "rb", "dims").cogroup(candidates.groupBy("qb", "rb", "dims")).applyInPandas(_searcher(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
