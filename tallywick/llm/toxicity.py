"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy, with thresholds by language."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywick.llm.common import bound_batches, bounded, crc_mod, cut, give_back, mix, word_chunks

#: Rows of the embedding table: words and word beginnings are hashed into it.
BUCKETS = 1 << 16
DIM = 12
#: Filters per width: a filter of width w looks at w words in a row.
FILTERS = {1: 8, 2: 4, 3: 4}
#: A word is embedded as the sum of its own row and that of its first letters, so that unseen endings are no blind spot.
PREFIX = 4
#: Bounds on what the model is fitted to, for the driver's memory: so many labelled rows of either label, in the order of
#: a hash of their id, and of these as many as have so many characters together. Their texts are fitted to whole.
MAX_TRAIN_ROWS = 2000
MAX_TRAIN_CHARS = 64 << 20
#: Every so many-th labelled row, by a hash of its id, is never fitted to: all of these rows calibrate the thresholds.
CALIBRATE_MOD = 5
#: Scored logits are counted in bins of this width, per language and label, between these bounds.
BIN, LOGIT_BOUND = 0.05, 40.0
#: Toxic rows of a language after which its own threshold counts as much as that of all languages.
SHRINK = 5
#: Only buckets that so many training texts have are learned: what a single text has says nothing about others.
MIN_TEXTS = 3
#: How far a bucket's log-odds move where its embedding starts, and how many texts at the base rate smooth them.
LEAN = 0.2
PRIOR_TEXTS = 2.0
EPOCHS = 8
#: With few rows there are more epochs, so that there are as many steps as this at least.
MIN_STEPS = 300
SEED = 11

# Frequent function words, by which a text's language is guessed. The table's lang column is not used.
FUNCTION_WORDS = {
    "en": "the of and to in that is with for was on are by from it",
    "fr": "le la les des et un une du que qui dans pour est sur au",
    "de": "der die das und ist nicht mit den von ein zu auf für sich dem",
    "es": "el los las y que en una del por con para se al como su",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def _hash_text(word: str) -> int:
    return next(word_chunks([word])).hashes()[0]


def _language_table() -> dict[int, int]:
    """Hash of a function word to a bit per language that has it."""
    out: dict[int, int] = {}
    for k, words in enumerate(FUNCTION_WORDS.values()):
        for w in words.split():
            h = int(_hash_text(w))
            out[h] = out.get(h, 0) | 1 << k
    return out


class Features:
    """Per word of some texts: bucket of the word, bucket of its beginning; per text: bounds, and hits per language."""

    def __init__(self, texts: list[str | None]):
        word, start, doc = [], [], []
        table = _language_table()
        keys = np.array(sorted(table), np.uint64)
        bits = np.array([table[int(k)] for k in keys], np.int64)
        self.hits = np.zeros((len(texts), len(FUNCTION_WORDS)), np.int64)
        for chunk in word_chunks(texts):
            if not len(chunk.start):
                continue
            # Letters alone: signs at either end of a word are left out where there are letters.
            first, last = _trim(chunk)
            h = chunk.hashes(first, last)
            word.append((h % np.uint64(BUCKETS)).astype(np.int32))
            head = mix(chunk.hashes(first, np.minimum(last, first + PREFIX)) + np.uint64(1))
            start.append((head % np.uint64(BUCKETS)).astype(np.int32))
            doc.append(chunk.doc)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = np.flatnonzero(keys[at] == h)
            for k in range(len(FUNCTION_WORDS)):
                np.add.at(self.hits[:, k], chunk.doc[known[(bits[at[known]] >> k & 1) > 0]], 1)
        self.word = np.concatenate(word) if word else np.zeros(0, np.int32)
        self.head = np.concatenate(start) if start else np.zeros(0, np.int32)
        self.doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)

    def languages(self) -> np.ndarray:
        return np.where(self.hits.sum(axis=1) > 0, self.hits.argmax(axis=1), len(FUNCTION_WORDS))


_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _trim(chunk) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word without signs at its ends; a word of signs alone stays as it is."""
    first, last = chunk.start.copy(), chunk.end.copy()
    sign = np.concatenate([_SIGN[chunk.data], [False]])
    for _ in range(4):
        last -= sign[last - 1] & (last - first > 1)
        first += sign[first] & (last - first > 1)
    return first, last


class Model:
    """Weights of the classifier; ``tables`` holds, for each width and place in a window, what each bucket adds to each filter."""

    def __init__(self, embedding: np.ndarray, filters: dict[int, np.ndarray], bias: dict[int, np.ndarray], out: np.ndarray, out_bias: float):
        self.tables = {w: [(embedding @ f[j]).astype(np.float32) for j in range(w)] for w, f in filters.items()}
        self.bias, self.out, self.out_bias = bias, out, out_bias
        self.threshold = np.zeros(len(LANGUAGES))

    def pooled(self, feats: Features, n: int) -> np.ndarray:
        """Max over all windows of each text, per filter, after a ReLU; 0 for texts without a window."""
        return np.concatenate([self._pool(feats, n, w) for w in FILTERS], axis=1)

    def _pool(self, feats: Features, n: int, w: int) -> np.ndarray:
        out = np.zeros((n, FILTERS[w]), np.float32)
        step = 1 << 16
        for at in range(0, len(feats.word) - w + 1, step):
            m = min(step, len(feats.word) - w + 1 - at)
            total = self.bias[w].astype(np.float32)
            for j in range(w):
                table = self.tables[w][j]
                total = total + table[feats.word[at + j : at + j + m]] + table[feats.head[at + j : at + j + m]]
            doc = feats.doc[at : at + m]
            if w > 1:
                whole = doc == feats.doc[at + w - 1 : at + w - 1 + m]
                total, doc = total[whole], doc[whole]
            if len(doc):
                edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                own = doc[edge]
                out[own] = np.maximum(out[own], np.maximum.reduceat(total, edge, axis=0))
        return out

    def logits(self, feats: Features, n: int) -> np.ndarray:
        return self.pooled(feats, n) @ self.out + self.out_bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities whose threshold, calibrated by guessed language, lies at 0.5."""
        out = np.empty(len(texts))
        for part in _parts(texts):
            own = texts[part]
            feats = Features(own)
            out[part] = self.logits(feats, len(own)) - self.threshold[feats.languages()]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _parts(texts: list[str | None], most: int = 2_000_000) -> Iterator[slice]:
    """Slices of texts with about that many characters each."""
    low, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text or "") > most:
            yield slice(low, i)
            low, held = i, 0
        held += len(text or "") + 1
    if low < len(texts):
        yield slice(low, len(texts))


def train(texts: list[str | None], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, hold: bool = True) -> Model:
    """Fit embeddings, filters and output by Adam on the cross-entropy; first thresholds on every fifth text, held back, or
    with ``hold`` off on the texts themselves, for a caller that sets thresholds by others.

    A bucket starts at the smoothed log-odds of its texts' labels, in the first component that the filters lean on, so
    that what tells the labels apart wins the maxima from the start: only the window that wins a filter's maximum gets its
    gradient, and what all texts share would else keep it. Buckets that are not learned stay zero and add nothing.
    """
    rng = np.random.default_rng(seed)
    emb = np.zeros((BUCKETS, DIM))
    filters = {w: rng.normal(0, 0.5, (w, DIM, f)) for w, f in FILTERS.items()}
    bias = {w: np.full(f, 0.01) for w, f in FILTERS.items()}
    out = np.abs(rng.normal(0.5, 0.1, sum(FILTERS.values()))) * np.where(np.arange(sum(FILTERS.values())) % 4 == 3, -1, 1)
    out_bias = np.array([-2.0])
    held = np.arange(len(texts)) % 5 == 4 if hold and len(texts) >= 50 else np.zeros(len(texts), bool)
    fit = np.flatnonzero(~held)
    model = Model(emb, filters, bias, out, float(out_bias[0]))
    if not len(fit) or len(set(labels.tolist())) < 2:
        model.out_bias = -8.0 if not len(labels) or labels.max() == 0 else 8.0
        return model
    params = {"emb": emb, "out": out, "out_bias": out_bias} | {f"f{w}": filters[w] for w in FILTERS} | {f"b{w}": bias[w] for w in FILTERS}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    weight = np.where(labels == 1, min(3.0, (labels == 0).sum() / max(1, (labels == 1).sum())), 1.0)
    size = 32
    every = [Features([texts[i]]) for i in range(len(texts))]
    texts_with, toxic_with = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for i in fit:
        own = np.unique(np.concatenate([every[i].word, every[i].head]))
        texts_with[own] += 1
        toxic_with[own] += labels[i]
    learned = texts_with >= MIN_TEXTS
    emb[learned] = rng.normal(0, 0.02, (int(learned.sum()), DIM))
    emb[learned, 0] += LEAN * _log_odds(texts_with, toxic_with, float(labels[fit].mean()))[learned]
    signs, at = np.sign(out), 0
    for w, f in FILTERS.items():
        filters[w][:, 0] = np.abs(filters[w][:, 0]) * signs[at : at + f]
        at += f
    epochs = max(epochs, -(-MIN_STEPS // -(-len(fit) // size)))
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(fit)
        for at in range(0, len(order), size):
            batch = order[at : at + size]
            grads = _gradients([every[i] for i in batch], labels[batch], weight[batch], params)
            for k, g in grads.items():
                rows = slice(None)
                if k == "emb":
                    rows, g = g[0][learned[g[0]]], g[1][learned[g[0]]]
                first[k][rows] = 0.9 * first[k][rows] + 0.1 * g
                second[k][rows] = 0.99 * second[k][rows] + 0.01 * g * g
                params[k][rows] -= rate * first[k][rows] / (np.sqrt(second[k][rows]) + 1e-6)
    model = Model(emb, filters, bias, out, float(out_bias[0]))
    _calibrate(model, every, labels, held)
    return model


def _log_odds(texts_with: np.ndarray, toxic_with: np.ndarray, base: float) -> np.ndarray:
    """Log-odds of each bucket's texts against the base rate, as if PRIOR_TEXTS more texts at that rate had it."""
    if not 0 < base < 1:
        return np.zeros(len(texts_with))
    clean_with = texts_with - toxic_with
    return np.log((toxic_with + PRIOR_TEXTS * base) / (clean_with + PRIOR_TEXTS * (1 - base))) - np.log(base / (1 - base))


def _gradients(feats: list[Features], labels: np.ndarray, weight: np.ndarray, params: dict) -> dict:
    word = np.concatenate([f.word for f in feats])
    head = np.concatenate([f.head for f in feats])
    doc = np.repeat(np.arange(len(feats)), [len(f.word) for f in feats])
    x = (params["emb"][word] + params["emb"][head]).astype(np.float32)
    pools, wins = [], []
    for w, f in FILTERS.items():
        pool, win = np.zeros((len(feats), f)), np.full((len(feats), f), -1)
        m = len(word) - w + 1
        if m > 0:
            total = sum(x[j : j + m] @ params[f"f{w}"][j].astype(np.float32) for j in range(w)) + params[f"b{w}"].astype(np.float32)
            whole = np.flatnonzero(doc[:m] == doc[w - 1 : w - 1 + m])
            own = doc[:m][whole]
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else []
            for low, high in zip(edge, [*edge[1:], len(own)], strict=True):
                best = total[whole[low:high]].argmax(axis=0)
                win[own[low]] = whole[low + best]
                pool[own[low]] = np.maximum(total[whole[low + best], np.arange(f)], 0)
        pools.append(pool)
        wins.append(win)
    pooled = np.concatenate(pools, axis=1)
    p = 1 / (1 + np.exp(-np.clip(pooled @ params["out"] + params["out_bias"][0], -30, 30)))
    err = (p - labels) * weight / len(labels)
    grads = {"out": pooled.T @ err + 1e-4 * params["out"], "out_bias": np.array([err.sum()])}
    rows, deltas, at = [], [], 0
    for (w, f), pool, win in zip(FILTERS.items(), pools, wins, strict=True):
        back = err[:, None] * params["out"][at : at + f] * (pool > 0)
        at += f
        d, k = np.nonzero((win >= 0) & (back != 0))
        g = np.zeros_like(params[f"f{w}"])
        bias = np.zeros_like(params[f"b{w}"])
        np.add.at(bias, k, back[d, k])
        for j in range(w):
            place = win[d, k] + j
            np.add.at(g[j].T, k, x[place] * back[d, k][:, None])
            delta = params[f"f{w}"][j].T[k] * back[d, k][:, None]
            rows += [word[place], head[place]]
            deltas += [delta, delta]
        grads[f"f{w}"], grads[f"b{w}"] = g + 1e-4 * params[f"f{w}"], bias
    rows, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    g = np.zeros((len(rows), DIM))
    np.add.at(g, inverse, np.concatenate(deltas))
    grads["emb"] = (rows, g)
    return grads


def _calibrate(model: Model, every: list[Features], labels: np.ndarray, held: np.ndarray) -> None:
    """Thresholds from the held-back texts, or from all where those have one label only."""
    use = np.flatnonzero(held) if held.any() and len(set(labels[held].tolist())) == 2 else np.arange(len(labels))
    logits = np.array([model.logits(every[i], 1)[0] for i in use])
    lang = np.array([every[i].languages()[0] for i in use])
    set_thresholds(model, lang, logits, labels[use], np.ones(len(use), np.int64))


def set_thresholds(model: Model, lang: np.ndarray, logits: np.ndarray, labels: np.ndarray, count: np.ndarray) -> None:
    """Per guessed language, the logit that separates its texts best, drawn to that of all languages by SHRINK toxic
    texts' worth; texts come as counts per language, logit and label."""
    model.threshold[:] = base = _best_cut(logits, labels, count)
    for k in range(len(LANGUAGES)):
        own = lang == k
        n = int((labels * count)[own].sum())
        if n and (count * (labels == 0))[own].any():
            model.threshold[k] = (n * _best_cut(logits[own], labels[own], count[own]) + SHRINK * base) / (n + SHRINK)


def _best_cut(logits: np.ndarray, y: np.ndarray, count: np.ndarray) -> float:
    """The threshold with the highest F1, in the middle of the gap between its neighbours. Where no threshold beats calling
    every text toxic, the logits tell nothing, and none is called so."""
    order = np.argsort(-logits, kind="stable")
    x, hit, upto = logits[order], np.cumsum((y * count)[order]), np.cumsum(count[order])
    toxic = int(hit[-1])
    f1 = 2 * hit / (upto + max(1, toxic))
    able = np.flatnonzero(x[:-1] > x[1:])
    if not len(able) or f1[able].max() <= f1[-1]:
        return float(x[0] + 2) if toxic < upto[-1] else float(x[-1] - 2)
    best = int(able[f1[able].argmax()])
    return float((x[best] + x[best + 1]) / 2)


_models: dict[int, Model] = {}


def _held_model(shared, key: int) -> Model:
    if key not in _models:
        _models.clear()
        _models[key] = pickle.loads(zlib.decompress(shared.value))
    return _models[key]


def _shared(model: Model):
    """The weights, to be sent to each executor once; their size is fixed by the parameters."""
    spark = SparkSession.getActiveSession()
    bound_batches(spark)
    packed = zlib.compress(pickle.dumps(model), 1)
    return spark.sparkContext.broadcast(packed), zlib.crc32(packed)


def scorer(model: Model):
    """A column function from text to score."""
    shared, key = _shared(model)

    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(_held_model(shared, key).scores(texts.tolist()))
        give_back()

    return score


def binned(model: Model):
    """A column function from text to language * 2^20 + bin of its logit, without thresholds."""
    shared, key = _shared(model)

    @F.pandas_udf(T.LongType())
    def where(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            own, out = texts.tolist(), np.empty(len(texts), np.int64)
            for part in _parts(own):
                feats = Features(own[part])
                logits = np.clip(_held_model(shared, key).logits(feats, len(own[part])), -LOGIT_BOUND, LOGIT_BOUND)
                out[part] = (feats.languages().astype(np.int64) << 20) + np.floor((logits + LOGIT_BOUND) / BIN).astype(np.int64)
            yield pd.Series(out)
        give_back()

    return where


def labelled(labels: DataFrame, label: str, seen: Column) -> DataFrame:
    """doc_id, _label of the rows that may be learned from; seen is about doc_id. An id with both labels counts as 1."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).filter("_id IS NOT NULL AND _label IN (0, 1)")
    return known.withColumnRenamed("_id", "doc_id").filter(seen).groupBy("doc_id").agg(F.max("_label").alias("_label"))


def training_rows(docs: DataFrame, known: DataFrame, most: int = MAX_TRAIN_ROWS, chars: int | None = None) -> DataFrame:
    """doc_id, text, _label of up to ``most`` labelled rows of either label, the first by a hash of their id, and of these
    the first that have ``chars`` characters together, if that is given; whole texts, always. Of rows that repeat an id,
    the text that comes first by code point."""
    chosen = known.filter("_label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = chosen.union(known.filter("_label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    # At most twice `most` rows of two numbers: a proven bound, so they go to the texts rather than the texts to them.
    if chars is not None:
        sizes = docs.select("doc_id", F.length("text").alias("_n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label").agg(F.max("_n").alias("_n"))
        upto = F.sum(F.coalesce("_n", F.lit(0)) + 1).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
        chosen = sizes.withColumn("_upto", F.coalesce(upto, F.lit(0))).filter((F.col("_upto") + F.coalesce("_n", F.lit(0)) <= chars) | (F.col("_upto") == 0)).select("doc_id", "_label")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "_label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on labels.toxic, from rows whose crc32(doc_id as text) mod 5 is not 0.

    A fifth of those rows is left out of the fit. Whole texts of all of them are scored and counted by guessed language,
    label and bin of the logit, which is all that reaches the driver; so the thresholds rest on all data and on its own
    share of toxic texts, at any size. Where that fifth has one label only, a fifth of the fit's rows is held back for it.
    """
    known = cut(labelled(labels, "toxic", crc_mod(F.col("doc_id"), 5) != 0), "labelled")
    held = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATE_MOD)) == 0
    told = known.filter(held).agg(F.min("_label").alias("low"), F.max("_label").alias("high")).first()
    rows = sorted(training_rows(docs, known.filter(~held), chars=MAX_TRAIN_CHARS).collect(), key=lambda r: (r["doc_id"], r["text"] or ""))
    model = train([r["text"] for r in rows], np.array([r["_label"] for r in rows], np.int64), hold=told["low"] == told["high"])
    others = bounded(known.filter(held))
    counts = docs.select("doc_id", "text").join(others, "doc_id").select(binned(model)("text").alias("at"), "_label").groupBy("at", "_label").count().collect()
    y, n, at = (np.array([r[c] for r in counts], np.int64) for c in ("_label", "count", "at"))
    if len(set(y.tolist())) == 2:
        set_thresholds(model, at >> 20, (at & (1 << 20) - 1) * BIN - LOGIT_BOUND + BIN / 2, y, n)
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, from the whole text alone.

    Null, empty and blank texts have no window and score what the bias alone says. Repeated rows score alike. With no
    labels, or labels of one class only, every text scores as that class (no labels: clean). An empty table gives no
    rows; further columns of either table, whatever their names, play no part.
    """
    score = scorer(fit(docs, labels))
    own = docs.select(F.col("doc_id"), score(F.col("text")).alias("score"))
    return own.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not judged toxic, with all columns.

    Each row is judged by its own text: repeated rows stay or go together, null, empty and blank texts score what the
    bias alone says, and an empty table stays empty. Without labels of both classes nothing is learned: with none, or
    none toxic, all rows stay. Only a score decides, so no row is shuffled.
    """
    score = scorer(fit(docs, labels))
    return docs.filter(score(docs["text"]) < 0.5)
