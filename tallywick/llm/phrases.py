"""Collocations by language, from depth-limited count tries."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywick.llm.common import bound_batches, cut, shuffle_parts

#: Bytes of text that one trie counts, and nodes of a range that are held before they are merged into one run; both bound
#: a task's memory whatever its input.
TRIE_BYTES = 8 << 20
MERGE_NODES = 4 << 20
#: Bytes of text to a range of phrases, and bytes of texts whose trie says where ranges begin. Texts over 1 MB are not
#: among them; all texts are counted, and only how even the ranges are depends on these.
RANGE_BYTES = 8 << 20
SAMPLE_BYTES = 2 << 20
SALTS = 64
#: Scores are in millionths.
UNIT = 1_000_000
UNKNOWN = "und"
NODE = "lang string, phrase string, n long"

_WORD, _GAP, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 32]] = _GAP
_CLASS[[10, 11, 12, 13, *b".,;:!?"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Run:
    """A trie as sorted lists: its words in the order of their bytes, and for each level d its nodes, as d + 1 columns of
    the words' places, with their counts. Nothing is hashed, so no two phrases are mistaken for each other."""

    def __init__(self, words: pa.Array, levels: list[tuple[list[np.ndarray], np.ndarray]]):
        self.words, self.levels = words, levels

    def __len__(self) -> int:
        return sum(len(n) for _, n in self.levels)

    def phrases(self, level: int, some: np.ndarray) -> pa.Array:
        columns, _ = self.levels[level]
        words = [self.words.take(pa.array(c[some])) for c in columns]
        return pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if len(words) > 1 else words[0]

    def starts(self, level: int, phrase: tuple[bytes, ...], known: list[bytes]) -> int:
        """How many of a level's nodes come before a phrase, by their words in order; ``known`` is the list of words."""
        columns, n = self.levels[level]
        low, high = 0, len(n)
        for column, word in zip(columns, phrase, strict=False):
            place = bisect_left(known, word)
            at = low + int(np.searchsorted(column[low:high], place))
            if place == len(known) or known[place] != word:
                return at
            low, high = at, low + int(np.searchsorted(column[low:high], place, side="right"))
        return low if len(columns) >= len(phrase) else high

    def between(self, slices: list[slice]) -> Run:
        """The nodes of a slice of each level, with the words that they need."""
        used = np.zeros(len(self.words), bool)
        for (columns, _), own in zip(self.levels, slices, strict=True):
            for c in columns:
                used[c[own]] = True
        place = np.cumsum(used, dtype=np.int32) - 1
        return Run(self.words.filter(pa.array(used)), [([place[c[own]] for c in columns], n[own]) for (columns, n), own in zip(self.levels, slices, strict=True)])

    def pack(self) -> tuple[bytes, bytes]:
        parts = [np.array([len(n) for _, n in self.levels], "<i8").tobytes()]
        for columns, n in self.levels:
            parts += [c.astype("<u4").tobytes() for c in columns] + [n.astype("<i8").tobytes()]
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return squeeze(b" ".join(self.words.to_pylist())), squeeze(b"".join(parts))

    @staticmethod
    def unpack(words: bytes, nodes: bytes, depth: int) -> Run:
        grow = zstandard.ZstdDecompressor().decompress
        raw, levels, at = grow(nodes), [], 8 * depth
        for d, size in enumerate(np.frombuffer(raw, "<i8", depth).tolist()):
            columns = [np.frombuffer(raw, "<u4", size, at + 4 * size * k).astype(np.int32) for k in range(d + 1)]
            at += 4 * size * (d + 1)
            levels.append((columns, np.frombuffer(raw, "<i8", size, at)))
            at += 8 * size
        return Run(pa.array(grow(words).split(b" "), pa.large_binary()), levels)


def _ordered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in the order of their bytes, and each given word's place among them."""
    held = words.dictionary_encode()
    order = pc.sort_indices(held.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return held.dictionary.take(pa.array(order)), place[held.indices.to_numpy()]


def trie(raw: bytes, depth: int) -> Run:
    """Counts of the words of some texts and of what follows them, to a depth: level d has the phrases of d + 1 words."""
    data = np.frombuffer(raw, np.uint8)
    kind = _CLASS[data]
    word = kind == _WORD
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == _BREAK, dtype=np.int32)[start] if len(start) else start
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words, ids = _ordered(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[data[word]])]))
    levels, columns = [], []
    node, at = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for d in range(depth):
        if d:
            # a phrase ends where its piece does
            on = at + d < len(ids)
            on[on] = piece[at[on]] == piece[at[on] + d]
            node, at = node[on], at[on]
        code, node, n = np.unique(node * max(1, len(words)) + ids[at + d], return_inverse=True, return_counts=True)
        parent, last = np.divmod(code, max(1, len(words)))
        columns = [c[parent] for c in columns] + [last.astype(np.int32)]
        levels.append((columns, n))
    return Run(words, levels)


def merge(runs: list[Run]) -> Run:
    """The runs as one: words of all are put in one order, and a node's counts are added up."""
    words, place = _ordered(pa.concat_arrays([r.words for r in runs]))
    own = np.split(place, np.cumsum([len(r.words) for r in runs])[:-1])
    levels = []
    for d in range(len(runs[0].levels)):
        columns = [np.concatenate([p[r.levels[d][0][k]] if len(p) else r.levels[d][0][k] for p, r in zip(own, runs, strict=True)]) for k in range(d + 1)]
        n = np.concatenate([r.levels[d][1] for r in runs])
        code, most = columns[0].astype(np.int64), max(1, len(words))
        for c in columns[1:]:
            if most * len(words) >= 1 << 62:
                known, code = np.unique(code, return_inverse=True)
                most = len(known)
            code, most = code * len(words) + c, most * len(words)
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        levels.append(([c[order[first]] for c in columns], np.add.reduceat(n[order], first) if len(first) else n))
    return Run(words, levels)


RUN = "range int, lang string, words binary, nodes binary"


def _tries(depth: int, most: int, bounds: list[tuple[bytes, ...]]):
    """Batches (lang, text) to the packed runs of tries, one trie per language for each ``most`` bytes of a task's texts,
    and of each a run per range of phrases; the ranges begin at ``bounds``."""

    def made(lang: str, held: list[bytes]) -> pa.RecordBatch:
        whole = trie(b"\n".join(held), depth)
        known = whole.words.to_pylist()
        edges = [[0, *(whole.starts(d, b, known) for b in bounds), len(n)] for d, (_, n) in enumerate(whole.levels)]
        rows = []
        for k in range(len(bounds) + 1):
            own = [slice(e[k], e[k + 1]) for e in edges]
            if any(x.stop > x.start for x in own):
                rows.append((k, lang, *whole.between(own).pack()))
        kinds = [pa.int32(), pa.string(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["range", "lang", "words", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                if size and size + len(raw) > most:
                    for own, texts in held.items():
                        yield made(own, texts)
                    held, size = {}, 0
                held.setdefault(lang, []).append(raw)
                size += len(raw) + 1
        for own, texts in held.items():
            yield made(own, texts)

    return run


def _merges(depth: int, min_count: int, most: int):
    """Sorted packed runs to the nodes of each range and language that occur often enough, and, as an empty phrase, the
    words that the range has in all."""

    def told(lang: str, runs: list[Run]) -> pa.RecordBatch:
        whole = merge(runs)
        phrases, counts = [pa.array([b""], pa.large_binary())], [np.array([whole.levels[0][1].sum()], np.int64)]
        for d, (_, n) in enumerate(whole.levels):
            some = np.flatnonzero(n >= min_count)
            phrases.append(whole.phrases(d, some))
            counts.append(n[some])
        count = np.concatenate(counts)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(count), pa.string()), pa.concat_arrays(phrases).cast(pa.large_string()).cast(pa.string()), pa.array(count, pa.int64())], names=["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, runs, size = None, [], 0
        for batch in batches:
            for *key, words, nodes in zip(*[batch.column(c).to_pylist() for c in ("range", "lang", "words", "nodes")], strict=True):
                if runs and key != at:
                    yield told(at[1], runs)
                    runs, size = [], 0
                at = key
                runs.append(Run.unpack(words, nodes, depth))
                size += len(runs[-1])
                if size > most and len(runs) > 1:
                    runs = [merge(runs)]
                    size = 0
        if runs:
            yield told(at[1], runs)

    return run


def _bounds(given: DataFrame, depth: int, ranges: int, total: int) -> list[tuple[bytes, ...]]:
    """Phrases at which ranges of about equally many nodes begin, from texts of about SAMPLE_BYTES in all."""
    share = min(1_000_000, max(1, SAMPLE_BYTES * 1_000_000 // max(1, total)))
    some = given.filter((F.pmod(F.xxhash64("text", F.lit("ranges")), F.lit(1_000_000)) < share) & (F.octet_length("text") <= 1 << 20)).select("text")
    held, size = [], 0
    for row in some.toLocalIterator():
        held.append(row["text"].encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size > 2 * SAMPLE_BYTES:
            break
    found = trie(b"\n".join(held), depth)
    columns = next((c for c, n in reversed(found.levels) if len(n)), None)
    if columns is None:
        return []
    n, words = len(columns[0]), found.words.to_pylist()
    places = sorted({n * k // ranges for k in range(1, ranges)} - {0})
    return [tuple(words[c[i]] for c in columns) for i in places]


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``max_words`` words that occur at least ``min_count`` times in their language (lang, phrase, n),
    and all words of each language (lang, n).

    Each task counts its texts in tries and serialises them as sorted runs, cut where ranges of phrases begin. A range's
    runs are merged in one task, adding up what they have of a node. Ranges are of whole phrases and grow in number with
    the texts, so a word that a third of all phrases begin with is many ranges, and a phrase that a third of all texts
    have is one entry of each run.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    total, parts = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0, shuffle_parts(spark)
    bounds = _bounds(given, max_words, max(parts, -(-total // RANGE_BYTES)), total)
    runs = given.mapInArrow(_tries(max_words, TRIE_BYTES, bounds), RUN)
    dealt = runs.repartitionById(parts, F.pmod("range", F.lit(parts))).sortWithinPartitions("range", "lang")
    nodes = cut(dealt.mapInArrow(_merges(max_words, min_count, MERGE_NODES), NODE), "phrases")
    return nodes.filter("phrase <> ''"), nodes.filter("phrase = ''").groupBy("lang").agg(F.sum("n").alias("n"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), in decimals: exact for counts up to 10^15."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(UNIT).cast("decimal(7,0)") * (a * a), left * right)


def _parts(words: Column, first: int, n: int | Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10, contained: int = 50, top: int = 2000) -> DataFrame:
    """Each language's best phrases of 2 to ``max_words`` words: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line breaks into pieces, and these at spaces and tabs into words.
    A phrase that occurs a times, at least ``min_count``, is cut after each of its words; a cut scores a * a over what its
    two parts occur alone, in millionths and floored, and the lowest-scoring cut counts, of equal ones the first. A phrase
    goes if a longer candidate that contains it, itself dropped or not, occurs at least ``contained`` percent as often.
    The ``top`` of each language by score, occurrences and bytes stay.

    A phrase's left parts are the nodes on its way from the root; its right parts are where its node's suffix link leads.
    Only nodes that occur often enough are looked up, since the parts of a candidate do. A part that many candidates
    share is a skewed key of a join with one row on the other side, which adaptive execution splits.

    Null texts have no words; a null lang is ``und``, and counts with it. Repeated rows count each time. Texts are read
    whole. A language without candidates has no rows, and so has an empty table; further columns of docs play no part.
    """
    nodes, words = phrase_counts(docs, text_col, lang_col, max_words, min_count)
    spaces = F.length("phrase") - F.length(F.replace(F.col("phrase"), F.lit(" ")))
    held = nodes.withColumn("size", spaces + 1)
    candidates = held.filter("size > 1").withColumn("words", F.split("phrase", " "))

    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), "size", "words", cut)
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), _parts(F.col("words"), 1, F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), _parts(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("part"))))
    links = cuts.select("lang", "phrase", "a", "k", sides.alias("to")).select("lang", "phrase", "a", "k", "to.*")
    found = links.join(nodes.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    scored = found.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    scored = scored.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.*")

    longer = candidates.filter("size > 2")
    sizes = F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m")
    starts = F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("s")
    inside = longer.select("lang", "n", "size", "words", sizes).select("*", starts).select("lang", _parts(F.col("words"), F.col("s"), F.col("m")).alias("phrase"), "n")
    inside = inside.groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    open_ = best.join(inside, ["lang", "phrase"], "left").filter(f"around IS NULL OR 100 * CAST(around AS DECIMAL(20,0)) < {contained} * CAST(a AS DECIMAL(20,0))")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = open_.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    out = ranked.join(words, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
