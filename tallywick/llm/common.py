"""What the operators of this subpackage share: the shared folder, cutting lineage, and words as hashes."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are hashed at a time; bounds the memory of a task whatever the length of a text.
SEGMENT = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a folder of this
    machine serves if the session runs on this machine alone; elsewhere that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallywick-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get()
    return at.rstrip("/")


#: Paths that are to be deleted together, where someone keeps count of them.
_tracked: list[str] | None = None


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/tallywick/{label}-{uuid.uuid4().hex}"
    if _tracked is not None:
        _tracked.append(path)
    return path


@contextmanager
def tracked(into: list[str]) -> Iterator[None]:
    """Note the scratch paths made within, for their maker to delete once nothing reads them any more."""
    global _tracked
    before, _tracked = _tracked, into
    try:
        yield
    finally:
        _tracked = before


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch paths, which only scratch_path() makes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    paths.clear()


#: Rows that Spark hands to Python at a time. Its default of 10,000 is for narrow rows: of whole texts that is too much memory.
BATCH_ROWS = 500


def bound_batches(spark: SparkSession) -> None:
    """Let this session hand texts to Python in batches of at most BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def give_back() -> None:
    """At the end of a Python task: hand freed memory back to the machine, as a worker may then be idle beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        gc.collect()
        trim(0)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: what follows neither recomputes it nor depends on its executors."""
    bound_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A frame is broadcast only if its rows, at the size of their hashed form, stay within so many bytes.
BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row of fixed-width columns in a hash table: the key and the row, with their headers, and the slot."""
    return 32 + 16 * len(df.columns)


def bounded(df: DataFrame, most: int = BROADCAST_BYTES, text_bytes: int = 0) -> DataFrame:
    """A narrow frame that is cheap to count, to be broadcast if it takes at most so many bytes; else it is joined by a
    shuffle. ``text_bytes`` is what a row may hold besides its fixed-width columns."""
    rows = most // (row_bytes(df) + text_bytes)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


# words as 64-bit hashes, in numpy -------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = re.compile(rb"[\x09-\x0d\x20]")
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + 4096)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_BASE, _UNBASE)]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def segments(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about SEGMENT bytes that end at white space."""
    at = 0
    while len(raw) - at > SEGMENT:
        gap = _GAP.search(raw, at + SEGMENT)
        if gap is None:
            break
        yield raw[at : gap.start()]
        at = gap.start()
    yield raw[at:] if at else raw


class Words:
    """The words of some texts: ``hash`` of each word, ``doc`` (index of its text, ascending), ``start`` and ``end`` within ``data``."""

    def __init__(self, pieces: list[bytes], doc: list[int], lower: bool):
        data = np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)
        self.data = data if not lower else _LOWER[data]
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum([len(p) + 1 for p in pieces])
        self.doc = np.asarray(doc, np.int64)[np.searchsorted(ends, self.start, side="right")] if len(pieces) else np.zeros(0, np.int64)
        self.sums = None

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        start, end = (self.start, self.end) if start is None else (start, end)
        power, back = _power_tables(len(self.data) + 1)
        if self.sums is None:
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)])])
        return mix((self.sums[end] - self.sums[start]) * back[start])


def word_chunks(texts: list[str | None], lower: bool = True) -> Iterator[Words]:
    """The words of texts, about SEGMENT bytes at a time and in order; null counts as empty. A long text comes in several chunks."""
    pieces, doc, held = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        for piece in segments(text.encode("utf-8", "surrogatepass")):
            if pieces and held + len(piece) > SEGMENT:
                yield Words(pieces, doc, lower)
                pieces, doc, held = [], [], 0
            pieces.append(piece)
            doc.append(i)
            held += len(piece) + 1
    if pieces:
        yield Words(pieces, doc, lower)
