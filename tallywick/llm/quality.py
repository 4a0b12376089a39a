"""Quality: a generalised additive model with pairwise interactions, of cyclically boosted shallow trees."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywick.llm.common import crc_mod, cut, give_back, mix, word_chunks

FEATURES = [
    "log_words",
    "mean_word",
    "longest_word",
    "upper_share",
    "digit_share",
    "sign_share",
    "wide_share",
    "signed_words",
    "lone_signs",
    "distinct_words",
    "repeated_next",
    "lines_per_word",
    "distinct_pairs",
    "capital_words",
    "top_sign_share",
    "short_words",
]
BINS = 64
PAIR_BINS = 16
PAIRS = 8
ROUNDS, PAIR_ROUNDS = 240, 120
RATE = 0.08
LEAVES = 4
MIN_LEAF = 8
#: The bound on what the model is fitted to: so many labelled rows, the first by a hash of their id.
MAX_TRAIN_ROWS = 20_000
CUT = 0.7


def text_features(texts: list[str | None]) -> np.ndarray:
    """The features of each whole text, from its words and bytes; zeros for null, empty and blank texts."""
    n = len(texts)
    words, chars, longest, upper, digit, sign, wide, signed, lone, next_same, lines, capital, short = (np.zeros(n) for _ in range(13))
    signs = np.zeros((n, 256))
    seen: list[list[np.ndarray]] = [[] for _ in range(n)]
    last: dict[int, int] = {}
    for chunk in word_chunks(texts, lower=False):
        if not len(chunk.start):
            continue
        data, doc, length = chunk.data, chunk.doc, chunk.end - chunk.start
        add = lambda into, values, at=doc: into.__iadd__(np.bincount(at, weights=values, minlength=n))
        inside = np.repeat(doc, length)
        ends = np.cumsum(length)
        letters = data[np.arange(ends[-1]) + np.repeat(chunk.start - (ends - length), length)]
        kind = _KIND[letters]
        add(words, np.ones(len(doc)))
        add(chars, length)
        np.maximum.at(longest, doc, length)
        for k, into in ((1, upper), (2, digit), (3, sign), (4, wide)):
            add(into, (kind == k).astype(float), inside)
        at = np.flatnonzero(kind == 3)
        np.add.at(signs, (inside[at], letters[at]), 1)
        tail = _KIND[data[chunk.end - 1]] == 3
        common = np.isin(data[chunk.end - 1], _STOPS)
        add(signed, (tail & ~common).astype(float))
        add(lone, (length == 1) & tail)
        add(capital, _KIND[data[chunk.start]] == 1)
        add(short, length <= 2)
        h = chunk.hashes()
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])
        same[0] = last.get(int(doc[0])) == int(h[0])
        add(next_same, same)
        last = {int(doc[-1]): int(h[-1])}
        gap = np.searchsorted(np.flatnonzero(data == 10), chunk.start)
        add(lines, np.concatenate([[0], np.diff(gap) > 0]))
        for i, own in zip(*_runs(doc), strict=True):
            seen[i].append(h[own])
    out = np.zeros((n, len(FEATURES)))
    for i, parts in enumerate(seen):
        if parts:
            h = np.concatenate(parts) if len(parts) > 1 else parts[0]
            out[i, 9] = len(np.unique(h)) / len(h)
            pairs = mix(h[1:] * np.uint64(3) + h[:-1])
            out[i, 12] = len(np.unique(pairs)) / max(1, len(pairs)) if len(pairs) else 1
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    columns = [np.log1p(words), chars / w, np.log1p(longest), upper / c, digit / c, sign / c, wide / c, signed / w, lone / w, out[:, 9].copy(), next_same / w, lines / w, out[:, 12].copy(), capital / w, signs.max(axis=1) / np.maximum(1, signs.sum(axis=1)), short / w]
    return np.stack(columns, axis=1)


def _runs(doc: np.ndarray) -> tuple[list[int], list[slice]]:
    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
    return doc[edge[:-1]].tolist(), [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]


_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_KIND[128:] = 4
_STOPS = np.frombuffer(b".,;:!?\"')", np.uint8)


def boost_leaf_values(gradient: np.ndarray, hessian: np.ndarray, count: np.ndarray, leaves: int = LEAVES, least: int = MIN_LEAF) -> np.ndarray:
    """The values of a tree over ordered bins with up to ``leaves`` leaves, split where the gain is greatest."""
    g, h, n = (np.concatenate([[0], np.cumsum(x)]) for x in (gradient, hessian, count))

    def best(low: int, high: int) -> tuple[float, int]:
        at = np.arange(low + 1, high)
        if not len(at):
            return 0.0, -1
        gain = (g[at] - g[low]) ** 2 / (h[at] - h[low] + 1) + (g[high] - g[at]) ** 2 / (h[high] - h[at] + 1) - (g[high] - g[low]) ** 2 / (h[high] - h[low] + 1)
        gain[(n[at] - n[low] < least) | (n[high] - n[at] < least)] = 0
        k = int(gain.argmax())
        return float(gain[k]), int(at[k])

    open_ = [(0, len(gradient), *best(0, len(gradient)))]
    while len(open_) < leaves:
        k = max(range(len(open_)), key=lambda i: open_[i][2])
        low, high, gain, at = open_[k]
        if gain <= 1e-9:
            break
        open_[k : k + 1] = [(low, at, *best(low, at)), (at, high, *best(at, high))]
    value = np.zeros(len(gradient))
    for low, high, _, _ in open_:
        value[low:high] = (g[high] - g[low]) / (h[high] - h[low] + 1)
    return value


def _grid_values(gradient: np.ndarray, hessian: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A shallow tree over a grid: the better first axis in two, then each half along the other axis in two."""
    best = None
    for flip in (False, True):
        g, h, n = (x.T if flip else x for x in (gradient, hessian, count))
        first = boost_leaf_values(g.sum(1), h.sum(1), n.sum(1), leaves=2)
        edge = int(np.argmax(first != first[0])) if (first != first[0]).any() else len(first)
        value, gain = np.zeros(g.shape), 0.0
        for half in (slice(0, edge), slice(edge, len(first))):
            if half.start == half.stop:
                continue
            own = boost_leaf_values(g[half].sum(0), h[half].sum(0), n[half].sum(0), leaves=2)
            value[half] = own
            gain += float((own * g[half].sum(0)).sum())
        if best is None or gain > best[0]:
            best = gain, value.T if flip else value
    return best[1]


class Additive:
    """Edges of the bins, one lookup table per feature, and one per pair of features: a score is a sum of lookups."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.single = np.zeros((len(edges), BINS))
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        total = self.base + self.single[np.arange(bins.shape[1]), bins].sum(axis=1)
        coarse = bins * PAIR_BINS // BINS
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            total = total + grid[coarse[:, a], coarse[:, b]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.bins(x)), -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Additive:
    """Boost each feature in turn, round after round, at a small rate; then, on what is left, the pairs whose grids explain most.

    With no rows, or rows of one label only, the model scores as that label (no rows: 1).
    """
    if not len(y) or y.min() == y.max():
        return Additive([np.zeros(0)] * len(FEATURES), 4.0 if not len(y) or y[0] == 1 else -4.0)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    model = Additive(edges, float(np.log(y.mean() / (1 - y.mean()))))
    bins = model.bins(x)
    logit = np.full(len(y), model.base)
    counts = [np.bincount(bins[:, k], minlength=BINS) for k in range(x.shape[1])]
    for _ in range(ROUNDS):
        for k in range(x.shape[1]):
            p = 1 / (1 + np.exp(-logit))
            b = bins[:, k]
            step = RATE * boost_leaf_values(np.bincount(b, y - p, BINS), np.bincount(b, p * (1 - p), BINS), counts[k])
            model.single[k] += step
            logit += step[b]
    coarse = bins * PAIR_BINS // BINS
    p = 1 / (1 + np.exp(-logit))

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[:, a] * PAIR_BINS + coarse[:, b], values, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    gains = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            g = grid(a, b, y - p)
            gains.append((float((_grid_values(g, grid(a, b, p * (1 - p)), grid(a, b, np.ones(len(y)))) * g).sum()), a, b))
    model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    model.grids = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    held = [grid(a, b, np.ones(len(y))) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-logit))
            step = RATE * _grid_values(grid(a, b, y - p), grid(a, b, p * (1 - p)), held[k])
            model.grids[k] += step
            logit += step[coarse[:, a], coarse[:, b]]
    return model


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.iloc[at : at + 512]
            yield pd.DataFrame({"doc_id": part["doc_id"], "x": list(text_features(part["text"].tolist()))})
    give_back()


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the features of each whole text."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInPandas(_measure, T.StructType([own.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def fit(measured: DataFrame, labels: DataFrame) -> Additive:
    """Train on labels.quality, from up to MAX_TRAIN_ROWS rows whose crc32(doc_id as text) mod 4 is not 2."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.filter(crc_mod(F.col("doc_id"), 4) != 2).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN_ROWS)
    # Of rows that repeat an id, the features that come first in order.
    rows = measured.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows], float))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, from the whole text alone.

    Texts are read once, for their features; those, sixteen numbers a text, are kept in the shared folder for training
    and scoring. Null, empty and blank texts have all features zero and are scored like any other. Repeated rows score
    alike. With no usable labels, or labels of one value, every text scores as that value (none: good). An empty table
    gives no rows; further columns of either table play no part.
    """
    measured = cut(features(docs), "features")
    packed = zlib.compress(pickle.dumps(fit(measured, labels)), 1)
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = pickle.loads(zlib.decompress(shared.value))
        for xs in parts:
            yield pd.Series(model.scores(np.stack(xs.tolist()))) if len(xs) else pd.Series([], dtype=float)

    own = measured.select("doc_id", score("x").alias("score"))
    return own.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
