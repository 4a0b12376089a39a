"""Lines that many documents share, found by two Bloom filters for each slice of the hash space, then confirmed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywick.llm.common import bounded, bound_batches, cut, mix, shuffle_parts

#: A line is known by so many bytes of its key's SHA-256: the first 8 go into the filters, all of them confirm.
KEY_BYTES = 16
#: Lines that one partial filter stands for, and distinct lines that a slice is meant for.
CHUNK_LINES = 1 << 17
SLICE_LINES = 1 << 20
#: Bits of a filter for each line that it is told, at least, and bits that a line sets.
BITS_PER_LINE = 16
PROBES = 4
SALTS = 16
_BLANK = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line: what is left without ASCII white space at both ends, A-Z lower-cased. Null is an empty line."""
    return [line.strip(_BLANK).lower() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:KEY_BYTES]


def _points(key: bytes) -> int:
    return len(key.decode("utf-8", "surrogatepass"))


def _keyed(min_points: int, chunk_lines: int):
    """Batches (doc_id, mark, text) to chunk, doc_id, mark and the digests of the document's distinct keys, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            rows, keys, chunks = [], [], []
            for i, text in enumerate(batch.column("text")):
                own = {k for k in line_keys(text.as_py()) if len(k) >= min_points and (min_points < 2 or _points(k) >= min_points)}
                if not own:
                    continue
                if held and held + len(own) > chunk_lines:
                    n, held = n + 1, 0
                held += len(own)
                rows.append(i)
                keys.append(b"".join(map(digest, own)))
                chunks.append((part << 32) | n)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), batch.column("doc_id").take(at), batch.column("mark").take(at), pa.array(keys, pa.binary())], names=["chunk", "doc_id", "mark", "keys"])

    return run


def heads(keys: bytes) -> np.ndarray:
    """The first 8 bytes of each digest, as a number: what the filters know a line by."""
    return np.frombuffer(keys, "<u8")[:: KEY_BYTES // 8]


def slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each hash: its upper half, scaled."""
    return ((hashes >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)


PARTIAL = "slice int, chunk long, once binary, twice binary"


def _partials(slices: int, chunk_lines: int):
    """Each chunk's lines, by slice: the hashes that one of its documents has, and those that several have."""

    def fold(chunk: int, held: list[bytes]) -> list[tuple]:
        hashes, n = np.unique(heads(b"".join(held)), return_counts=True)
        of = slice_of(hashes, slices)
        edges = np.flatnonzero(np.diff(of)) + 1
        rows = []
        for part, counts in zip(np.split(hashes, edges), np.split(n, edges), strict=True):
            rows.append((int(slice_of(part[:1], slices)[0]), chunk, part[counts == 1].tobytes(), part[counts > 1].tobytes()))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        for batch in batches:
            rows = []
            for chunk, keys in zip(batch.column("chunk").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                if held and (chunk != at or size > chunk_lines * KEY_BYTES):
                    rows += fold(at, held)
                    held, size = [], 0
                at = chunk
                held.append(keys)
                size += len(keys)
            if rows:
                yield _batch(rows)
        if held:
            yield _batch(fold(at, held))

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("slice", pa.int32()), ("chunk", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])


class SeenTwice:
    """Two Bloom filters over one slice: of the hashes seen at least once, and of those seen at least twice.

    ``add`` takes hashes of which none repeats within a call. What was added twice is always in ``twice``; what was not
    is there with a small probability.
    """

    def __init__(self, hashes: int):
        size = 64
        while size < BITS_PER_LINE * hashes:
            size *= 2
        self.once, self.twice, self.last = np.zeros(size, bool), np.zeros(size, bool), np.uint64(size - 1)

    def _bits(self, hashes: np.ndarray) -> np.ndarray:
        step = mix(hashes) | np.uint64(1)
        return ((hashes[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & self.last).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        bits = self._bits(hashes)
        self.twice[bits[self.once[bits].all(axis=1)]] = True
        self.once[bits] = True

    def add_repeated(self, hashes: np.ndarray) -> None:
        bits = self._bits(hashes)
        self.once[bits] = self.twice[bits] = True

    def suspected(self, hashes: np.ndarray) -> np.ndarray:
        return hashes[self.twice[self._bits(hashes)].all(axis=1)]


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted partial filters: each slice's are merged into its two filters, which then answer each chunk with those of
    its hashes that they suspect."""

    def answer(held: list[tuple]) -> pa.RecordBatch:
        told = [(chunk, np.frombuffer(once, "<u8"), np.frombuffer(twice, "<u8")) for chunk, once, twice in held]
        seen = SeenTwice(sum(len(a) + len(b) for _, a, b in told))
        for _, once, twice in told:
            seen.add(once)
            seen.add_repeated(twice)
        found = [(chunk, np.concatenate([seen.suspected(once), twice])) for chunk, once, twice in told]
        found = [(chunk, x.tobytes()) for chunk, x in found if len(x)]
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["chunk", "hashes"])

    at, held = None, []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("slice", "chunk", "once", "twice")], strict=True):
            if held and row[0] != at:
                yield answer(held)
                held = []
            at = row[0]
            held.append(row[1:])
    if held:
        yield answer(held)


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (chunk, kind, doc_id, mark, keys): a chunk's suspected hashes, which come first, pick of each of its
    documents the lines that are to be confirmed: doc_id, mark, k1, k2 (the digest as two numbers)."""
    at, told, hashes = None, [], np.zeros(0, np.uint64)
    for batch in batches:
        rows, found = [], []
        for i, (chunk, kind, keys) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("kind").to_pylist(), batch.column("keys").to_pylist(), strict=True)):
            if chunk != at:
                at, told, hashes = chunk, [], np.zeros(0, np.uint64)
            if kind == 0:
                told.append(np.frombuffer(keys, "<u8"))
                continue
            if told:
                hashes, told = np.unique(np.concatenate([hashes, *told])), []
            own = np.frombuffer(keys, "<i8").reshape(-1, 2)
            known = heads(keys)
            own = own[np.searchsorted(hashes, known, "right") > np.searchsorted(hashes, known)]
            rows.append(np.full(len(own), i))
            found.append(own)
        both = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        at_rows = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at_rows), batch.column("mark").take(at_rows), pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["doc_id", "mark", "k1", "k2"]
        )


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, text, gone, own) to doc_id, text, n_lines, n_dropped: lines whose digest is in ``gone`` go; of
    one in ``own`` the document keeps the first."""
    for batch in batches:
        texts, lines, dropped = [], [], []
        for text, gone, own in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), batch.column("own").to_pylist(), strict=True):
            text = text or ""
            if not gone:
                texts.append(text)
                lines.append(text.count("\n") + 1)
                dropped.append(0)
                continue
            gone, first = {tuple(g.values()) for g in gone}, {tuple(g.values()) for g in own or ()}
            all_, kept = text.split("\n"), []
            for line, key in zip(all_, line_keys(text), strict=True):
                k = tuple(np.frombuffer(digest(key), "<i8").tolist())
                if k not in gone or not key:
                    kept.append(line)
                elif k in first:
                    first.discard(k)
                    kept.append(line)
            texts.append("\n".join(kept))
            lines.append(len(all_))
            dropped.append(len(all_) - len(kept))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])


def _among(lines: DataFrame, known: DataFrame) -> DataFrame:
    """lines joined with known, which has a row per (k1, k2): known goes to the tasks where it is small, else is salted,
    since one line may be that of a third of all documents."""
    whole = bounded(known, text_bytes=32)
    if whole is not known:
        return lines.join(whole, ["k1", "k2"])
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)).cast("int")).join(salted, ["k1", "k2", "_salt"]).drop("_salt")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_points: int = 1) -> tuple[DataFrame, DataFrame]:
    """The suspected lines of all documents (doc_id, mark, k1, k2), and of these the ones that at least ``min_docs``
    documents have (k1, k2, n, and first: the document that a first occurrence is in)."""
    spark = docs.sparkSession
    bound_batches(spark)
    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = cut(given.filter("text IS NOT NULL").mapInArrow(_keyed(min_points, CHUNK_LINES), f"chunk long, doc_id {kind}, mark long, keys binary"), "lines")

    lines = (keyed.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // KEY_BYTES
    parts = shuffle_parts(spark)
    slices = parts * max(1, -(-lines // (parts * SLICE_LINES)))
    partial = keyed.select("chunk", "keys").mapInArrow(_partials(slices, CHUNK_LINES), PARTIAL)
    dealt = partial.repartitionById(parts, F.pmod("slice", F.lit(parts))).sortWithinPartitions("slice")
    answers = dealt.mapInArrow(_answers, "chunk long, hashes binary")

    none = [F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("long").alias("mark")]
    both = answers.select("chunk", F.lit(0).alias("kind"), *none, F.col("hashes").alias("keys")).union(keyed.select("chunk", F.lit(1), "doc_id", "mark", "keys"))
    runs = both.repartition("chunk").sortWithinPartitions("chunk", "kind")
    suspects = cut(runs.mapInArrow(_suspects, f"doc_id {kind}, mark long, k1 long, k2 long"), "suspects")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "mark")).alias("first")
    return suspects, suspects.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), first).filter(F.col("n") >= min_docs)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_points: int = 1, keep_first: bool = False) -> DataFrame:
    """Documents without the lines that many documents share: doc_id, text, n_lines (before), n_dropped.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased; keys of fewer than ``min_points``
    code points are left alone, and so are empty ones at any setting. A key that at least ``min_docs`` documents have goes
    with all its lines, wherever they stand; with ``keep_first`` the first line of the first document that has it stays
    (the smallest id, a null id last).

    Lines are hashed, and each chunk of documents folds its hashes into partial filters, one for each slice of the hash
    space; slices grow in number with the lines, so none outgrows a task. A slice merges its partials into two Bloom
    filters, of what was seen once and what was seen twice, and tells each chunk which of its hashes may repeat. Only
    those lines are then counted by 128 bits of their SHA-256, which no two lines share in practice; a line that one document alone has
    is counted only where a filter errs, and is dropped by the count. What a chunk has several times it tells once, so a
    line of a third of all documents costs its slice one entry per chunk.

    One row per row of docs. Null and empty texts are one empty line, which stays. A line counts once in a document
    however often it has it; rows that repeat an id, or all of a row, are documents of their own. A null id is an id like
    another. Texts of any length are read whole. An empty table gives no rows, and further columns of docs play no part.
    """
    suspects, repeated = repeated_lines(docs, id_col, text_col, min_docs, min_points)
    known = cut(repeated.select("k1", "k2", "first"), "repeated")
    hit = _among(suspects, known)
    key = F.struct("k1", "k2")
    in_first: Column = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")) if keep_first else F.lit(False)
    told = cut(hit.groupBy("doc_id", "mark").agg(F.collect_set(key).alias("gone"), F.collect_set(F.when(in_first, key)).alias("own")), "decisions")

    size = told.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("gone")).alias("keys")).first()
    each = 64 + 48 * (size["keys"] or 0) // max(1, size["n"])
    some = bounded(told.toDF("_id", "_mark", "gone", "own"), text_bytes=each)
    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    both = given.join(some, given["doc_id"].eqNullSafe(some["_id"]) & (given["mark"] == some["_mark"]), "left")
    kind = docs.schema[id_col].dataType.simpleString()
    return both.select("doc_id", "text", "gone", "own").mapInArrow(_rewritten, f"doc_id {kind}, text string, n_lines long, n_dropped long")


def kept_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: what drop_repeated_lines leaves, as a digest."""
    return drop_repeated_lines(docs, min_docs=min_docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
