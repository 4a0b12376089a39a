"""Annotated corpora: reading them, scoring what was masked against their annotators, and the phrases that may be allowed.

A document's spans are gathered beside its text, and each document is read once: its words never become rows of a shuffle.
What a set of spans covers is one running maximum over them, which an item looks up, so no item is paired with the spans of
its document. Arrow batches are read a document at a time and handed on in pieces of bounded size. Offsets are code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MENTION = "struct<entity_id:string,entity_type:string,identifier_type:string,start_offset:int,end_offset:int,span_text:string>"
CORPUS = f"doc_id string, text string, annotations map<string,struct<entity_mentions:array<{MENTION}>>>"
#: Kinds of mentions: what must be masked by itself, what identifies together with other facts, and what may stay.
DIRECT, QUASI, SAFE = "DIRECT", "QUASI", "NO_MASK"


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text) and mentions (doc_id, annotator, entity_id, entity_type, identifier_type, start, end, agrees)
    of an annotated corpus in JSON. ``agrees`` says whether the text at the offsets is the one that was annotated."""
    raw = spark.read.schema(CORPUS).option("multiLine", True).json(path)
    told = raw.select("doc_id", "text", F.explode("annotations").alias("annotator", "own")).select("doc_id", "text", "annotator", F.explode("own.entity_mentions").alias("m"))
    start, end = F.col("m.start_offset"), F.col("m.end_offset")
    agrees = F.col("m.span_text").isNull() | (F.substr("text", start + 1, end - start) == F.col("m.span_text"))
    mentions = told.select("doc_id", "annotator", "m.entity_id", "m.entity_type", "m.identifier_type", start.alias("start"), end.alias("end"), F.coalesce(agrees, F.lit(False)).alias("agrees"))
    return raw.select("doc_id", "text"), mentions


_WORD = re.compile(r"[^\W_]+")


#: Words that are handed on at once.
PIECE = 20_000


def tokens(docs: DataFrame) -> DataFrame:
    """The words of documents, runs of letters and digits of any script: doc_id, nr (from 0), word, start, end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, nr, word, start, end = [], [], [], [], []

            def told(at=at, nr=nr, word=word, start=start, end=end, batch=batch) -> pa.RecordBatch:
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                out = pa.RecordBatch.from_arrays([ids, *[pa.array(c, kind) for c, kind in ((nr, pa.int32()), (word, pa.string()), (start, pa.int32()), (end, pa.int32()))]], ["doc_id", "nr", "word", "start", "end"])
                for c in (at, nr, word, start, end):
                    c.clear()
                return out

            for i, text in enumerate(batch.column(1)):
                for k, m in enumerate(_WORD.finditer(text.as_py() or "")):
                    at.append(i)
                    nr.append(k)
                    word.append(m.group())
                    start.append(m.start())
                    end.append(m.end())
                    if len(at) >= PIECE:
                        yield told()
            if at:
                yield told()

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("nr", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def _islands(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans as disjoint ones in order: those that overlap or touch become one, empty ones go."""
    some = end > start
    order = np.argsort(start[some], kind="stable")
    s, e = start[some][order], end[some][order]
    if not len(s):
        return s, e
    reach = np.maximum.accumulate(e)
    first = np.flatnonzero(np.r_[True, s[1:] > reach[:-1]])
    return s[first], reach[np.r_[first[1:] - 1, len(s) - 1]]


def _covered(start: np.ndarray, end: np.ndarray, islands: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether islands cover all of each item, and whether any of it."""
    s, e = islands
    if not len(s):
        return np.zeros(len(start), bool), np.zeros(len(start), bool)
    upto = np.searchsorted(s, start, "right") - 1
    before = np.searchsorted(s, end, "left") - 1
    return (upto >= 0) & (e[upto] >= end), (before >= 0) & (e[before] > start)


def _places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's words."""
    spans = np.fromiter((x for m in _WORD.finditer(text) for x in m.span()), np.int64)
    return spans[0::2], spans[1::2]


def _gathered(spans: DataFrame, name: str, *columns) -> DataFrame:
    """A row for each document with its spans as an array."""
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias(name))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """Of a batch's lists: where each begins and ends among all their items, and these."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    upto = np.cumsum(size)
    return upto - size, upto, column.flatten()


def _numbers(items: pa.StructArray, name: str) -> np.ndarray:
    return np.asarray(pc.fill_null(items.field(name), 0)).astype(np.int64)


COUNTS = ["direct", "direct_total", "quasi", "quasi_total", "precise", "judged", "safe_touched", "safe", "masked_chars"]


def _score(text: str, own: dict[str, np.ndarray], lit: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """The COUNTS of a document. own has ``start``, ``end``, ``need``, ``safe``, ``kind`` (0 direct, 1 quasi) and the numbers
    of ``annotator`` and ``entity`` of its distinct mentions; lit are the islands of what is masked."""
    start, end = _places(text)
    whole, touched = _covered(start, end, lit)
    # A word belongs to a mention by its end: running counts tell how many lie before any place.
    upto = lambda flags, at: np.r_[0, np.cumsum(flags)][np.searchsorted(end, at, "right")]
    within = lambda flags: upto(flags, own["end"]) - upto(flags, own["start"])
    all_of, some = within(whole) >= within(np.ones(len(end), bool)), within(touched) > 0
    need, out = own["need"], []
    entity, which = np.unique(np.stack([own["annotator"][need], own["entity"][need]]), axis=1, return_inverse=True)
    kind, found = np.ones(entity.shape[1], np.int64), np.ones(entity.shape[1], bool)
    np.minimum.at(kind, which.ravel(), own["kind"][need])
    np.logical_and.at(found, which.ravel(), all_of[need])
    for k in (0, 1):
        out += [int((found & (kind == k)).sum()), int((kind == k).sum())]
    precise, readers = 0, np.unique(own["annotator"])
    for reader in readers:
        of = need & (own["annotator"] == reader)
        precise += int(_covered(start[touched], end[touched], _islands(own["start"][of], own["end"][of]))[0].sum())
    return [*out, precise, int(touched.sum()) * len(readers), int((some & own["safe"]).sum()), int(own["safe"].sum()), int((lit[1] - lit[0]).sum())]


def score_corpus(docs: DataFrame, mentions: DataFrame, masked: DataFrame) -> DataFrame:
    """Per document: what of it was found and what was lost, as counts that add up over documents.

    docs has doc_id, text; mentions doc_id, annotator, entity_id, identifier_type, start, end; masked doc_id, start, end.
    An annotator's entity is found when each of its mentions that needs it has all its words masked (``direct`` and
    ``quasi``, with totals). ``precise`` of ``judged`` are masked words, each counted once for every annotator, and as
    precise where that annotator masks all of it. ``safe_touched`` of ``safe`` mentions that may stay have some of a word
    masked. ``masked_chars`` of ``chars`` are covered. A null text counts as empty, mentions of other documents as none.
    """
    names = ["annotator", "entity_id", "identifier_type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            m_from, m_to, told = _lists(column["mentions"])
            l_from, l_to, hidden = _lists(column["masked"])
            code = {n: np.asarray(pc.fill_null(pc.dictionary_encode(told.field(n)).indices, -1)).astype(np.int64) for n in names}
            kind = told.field("identifier_type")
            placed = pc.and_(pc.is_valid(told.field("start")), pc.is_valid(told.field("end")))
            is_of = {k: np.asarray(pc.fill_null(pc.and_(pc.equal(kind, k), placed), False)) for k in (DIRECT, QUASI, SAFE)}
            every = {"start": _numbers(told, "start"), "end": _numbers(told, "end"), "annotator": code["annotator"], "entity": code["entity_id"], "type": code["identifier_type"]}
            starts, ends, rows = _numbers(hidden, "start"), _numbers(hidden, "end"), []
            for i, text in enumerate(column["text"]):
                own = np.arange(m_from[i], m_to[i])
                if len(own):
                    own = own[np.unique(np.stack([every[c][own] for c in every]), axis=1, return_index=True)[1]]
                told_here = {c: every[c][own] for c in every} | {"need": is_of[DIRECT][own] | is_of[QUASI][own], "safe": is_of[SAFE][own], "kind": np.where(is_of[DIRECT][own], 0, 1)}
                rows.append(_score(text.as_py() or "", told_here, _islands(starts[l_from[i] : l_to[i]], ends[l_from[i] : l_to[i]])))
            counts = np.array(rows, np.int64).reshape(len(rows), len(COUNTS))
            chars = pc.fill_null(pc.utf8_length(column["text"]), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([column["doc_id"], *[pa.array(c) for c in counts.T], chars], ["doc_id", *COUNTS, "chars"])

    given = docs.select("doc_id", "text").join(_gathered(mentions, "mentions", *names, "start", "end"), "doc_id", "left").join(_gathered(masked.filter("end > start"), "masked", "start", "end"), "doc_id", "left")
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in (*COUNTS, "chars")]])
    return given.mapInArrow(run, kind)


def corpus_rates(scores: DataFrame) -> DataFrame:
    """The rates of score_corpus over all documents: measure, hits, total, rate (null where there is nothing to count)."""
    pairs = {"direct": ("direct", "direct_total"), "quasi": ("quasi", "quasi_total"), "precision": ("precise", "judged"), "safe_touched": ("safe_touched", "safe"), "masked": ("masked_chars", "chars")}
    row = scores.agg(*[F.struct(F.coalesce(F.sum(h), F.lit(0)).alias("hits"), F.coalesce(F.sum(t), F.lit(0)).alias("total")).alias(m) for m, (h, t) in pairs.items()])
    told = row.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}.hits").alias("hits"), F.col(f"{m}.total").alias("total")) for m in pairs])))
    return told.withColumn("rate", F.when(F.col("total") > 0, F.round(F.col("hits") / F.col("total"), 6)))


def document_bootstrap(scores: DataFrame, hits: str, total: str, draws: int = 1000, seed: int = 20260922) -> DataFrame:
    """A 95 % interval of sum(hits) / sum(total) by drawing documents again: rate, low, high.

    Each document takes part in a draw as often as a Poisson variable of mean 1 says, made from a hash of its id, the draw
    and the seed, so tasks draw without knowing of each other, and only the draws' two sums are shuffled.
    """
    draw = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda d: (F.xxhash64("doc_id", d, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)))).alias("draw", "u")
    # The distribution function of a Poisson variable of mean 1, beyond which no hash of 53 bits goes.
    steps, p, total_p = [], 2.718281828459045**-1, 0.0
    for k in range(1, 18):
        total_p += p
        steps.append(total_p)
        p /= k
    times = sum((F.when(F.col("u") >= s, 1).otherwise(0) for s in steps[1:]), F.when(F.col("u") >= steps[0], 1).otherwise(0))
    sums = scores.select("doc_id", hits, total, draw).withColumn("times", times).groupBy("draw").agg(F.sum(F.col("times") * F.col(hits)).alias("h"), F.sum(F.col("times") * F.col(total)).alias("t"))
    rates = sums.filter("t > 0").select((F.col("h") / F.col("t")).alias("r"))
    ends = rates.agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high"))
    return scores.agg((F.sum(hits) / F.sum(total)).alias("rate")).crossJoin(F.broadcast(ends))


def allow_from_pages(masked: DataFrame, least: int = 2) -> DataFrame:
    """Phrases, and their words, that were masked on at least ``least`` pages and so are the corpus's own: phrase, pages.
    masked has doc_id, page, phrase. Nothing with a digit and no single letter is among them."""
    whole = masked.select("doc_id", "page", F.btrim("phrase").alias("phrase"))
    words = whole.select("doc_id", "page", F.explode(F.split("phrase", r"\s+")).alias("phrase"))
    some = whole.union(words).filter((F.length("phrase") > 1) & ~F.col("phrase").rlike(r"\p{N}"))
    return some.groupBy("phrase").agg(F.count_distinct("doc_id", "page").alias("pages")).filter(F.col("pages") >= least)


def allow_from_mentions(docs: DataFrame, mentions: DataFrame, least: int = 2, most_masked: float = 0.1, words: bool = True) -> DataFrame:
    """Phrases that annotators let stand in at least ``least`` documents, and mask in at most a share of their mentions;
    and, with ``words``, capitalised words of as many documents that are in no mention to be masked: phrase, documents."""
    least_of = F.count_distinct("doc_id").alias("documents")
    need = F.col("identifier_type").isin(DIRECT, QUASI)
    flags = [F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in (("need", need), ("free", ~need))]
    given = docs.select("doc_id", "text").join(_gathered(mentions.dropna(subset=["start", "end"]), "mentions", *flags, "start", "end"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            m_from, m_to, told = _lists(column["mentions"])
            starts, ends, needs, free = (_numbers(told, n) for n in ("start", "end", "need", "free"))
            rows: list[tuple] = []
            for i, text in enumerate(column["text"]):
                own = slice(m_from[i], m_to[i])
                rows += _phrases(i, text.as_py(), starts[own], ends[own], needs[own], free[own], words)
                if rows and (len(rows) >= PIECE or i + 1 == len(batch)):
                    yield _batch(batch, rows)
                    rows = []
            if rows:
                yield _batch(batch, rows)

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("phrase", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in _PHRASE]])
    found = given.mapInArrow(run, kind)
    texts = found.filter("mentions > 0")
    share = texts.groupBy(F.lower("phrase").alias("key")).agg((F.sum("needed") / F.sum("mentions")).alias("share"))
    safe = texts.filter("free > 0").groupBy("phrase").agg(least_of).filter(F.col("documents") >= least)
    phrases = safe.withColumn("key", F.lower("phrase")).join(share.filter(F.col("share") <= most_masked), "key").select("phrase", "documents")
    if not words:
        return phrases
    clean = found.filter("capital > 0").groupBy("phrase").agg(least_of, F.max("within").alias("within")).filter((F.col("documents") >= least) & (F.col("within") == 0))
    return phrases.unionByName(clean.select("phrase", "documents")).groupBy("phrase").agg(F.max("documents").alias("documents"))


#: Of a phrase in a document: its mentions, those that need masking and that may stand, whether it is a capitalised word, and within a mention that needs it.
_PHRASE = ["mentions", "needed", "free", "capital", "within"]


def _phrases(at: int, text: str | None, start: np.ndarray, end: np.ndarray, need: np.ndarray, free: np.ndarray, words: bool) -> list[tuple]:
    """at and the phrase with _PHRASE, once for each phrase that a document's mentions and capitalised words have."""
    out: dict[str, list[int]] = {}
    for s, e, n, f in zip(start.tolist(), end.tolist(), need.tolist(), free.tolist(), strict=True) if text is not None else ():
        own = out.setdefault(text[s : max(s, e)], [0, 0, 0, 0, 0])
        own[0] += 1
        own[1] += n
        own[2] += f
    if words and text:
        capital = [m.span() for m in _WORD.finditer(text) if m.end() - m.start() > 1 and unicodedata.category(text[m.start()]) == "Lu"]
        s, e = np.array(capital, np.int64).reshape(-1, 2).T
        for (a, b), within in zip(capital, _covered(s, e, _islands(start[need > 0], end[need > 0]))[1].tolist(), strict=True):
            own = out.setdefault(text[a:b], [0, 0, 0, 0, 0])
            own[3] = 1
            own[4] |= within
    return [(at, phrase, *counts) for phrase, counts in out.items()]


def _batch(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    at, phrase, *counts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(phrase, pa.string()), *[pa.array(c, pa.int32()) for c in counts]], ["doc_id", "phrase", *_PHRASE])
