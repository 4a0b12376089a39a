"""WARC archives whose records are Zstandard frames under one dictionary, embedded in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywick.llm.common import BROADCAST_BYTES, bounded, cut, scratch_path, shuffle_parts

#: The skippable frame that a reader of .warc.zst files expects its dictionary in.
SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: A dictionary is built from so many bytes of an archive's own records, taken evenly from those at hand.
SAMPLE_BYTES = 4 << 20
#: Records held before the dictionary is built, in bytes; the rest of an archive streams through.
HELD_BYTES = 8 << 20
#: Payload bytes after which a writer starts another archive.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
MIN_REVISIT = 0
CRLF = "\r\n"


def digest_of(payload: bytes) -> str:
    """The bare upper-case base32 SHA-1 of a payload."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: the payload as response, or a revisit that names the page that has it."""
    digest = digest_of(payload)
    name = "none" if page_id is None else str(page_id)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-ID": name,
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"
        head["X-Refers-To-Page"] = str(refers_to)
    body = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode()
    block = body if revisit else body + payload
    head["Content-Type"] = "application/http; msgtype=response"
    head["Content-Length"] = str(len(block))
    lines = "WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in head.items()) + CRLF
    return lines.encode("utf-8", "surrogatepass") + block + (CRLF * 2).encode()


def build_dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary from records; with too few of them to train on, their own bytes, which serve as one."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = [r[:SAMPLE_BYTES] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICTIONARY_BYTES:]


class ArchiveWriter:
    """Writes the skippable frame with the dictionary, then each record as a frame of its own."""

    def __init__(self, out, dictionary: bytes):
        self.out = out
        out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_checksum=True)

    def add(self, record: bytes) -> None:
        self.out.write(self.packer.compress(record))


def read_archive(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one at a time: the dictionary comes from the leading frame, frames are split as they are read."""
    held = stream.read(8)
    magic, size = struct.unpack("<II", held)
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    dictionary = stream.read(size)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    held, frame, parts, begun = b"", unpacker.decompressobj(), [], False
    while True:
        held = held or stream.read(block)
        if not held:
            break
        parts.append(frame.decompress(held))
        begun, held = True, b""
        if frame.eof:
            yield b"".join(parts)
            held, frame, parts, begun = frame.unused_data, unpacker.decompressobj(), [], False
    if begun:
        raise ValueError("the archive ends within a record")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; the HTTP headers before the payload are left out."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split(CRLF)[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Archives of a partition's rows, under names of their own: only those of a task that ends are listed."""
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        made: list[tuple[str, int]] = []
        held, size, out, writer, count, written = [], 0, None, None, 0, 0

        def begin():
            nonlocal out, writer, held, size, count, written
            name = f"pages-{uuid.uuid4().hex}.warc.zst"
            out = store.open_output_stream(f"{root}/{name}", compression=None)
            writer, count, written = ArchiveWriter(out, build_dictionary(held)), 0, 0
            made.append((name, 0))
            for r in held:
                put(r)
            held, size = [], 0

        def put(r: bytes):
            nonlocal count, written
            writer.add(r)
            count, written = count + 1, written + len(r)
            made[-1] = (made[-1][0], count)

        for batch in batches:
            for row in batch.itertuples(index=False):
                page_id = None if pd.isna(row.page_id) else int(row.page_id)
                refers_to = None if pd.isna(row.refers_to) else int(row.refers_to)
                record = record_bytes(page_id, row.url, (row.html or "").encode("utf-8", "surrogatepass"), refers_to, refers_to is not None)
                if out is None:
                    held.append(record)
                    size += len(record)
                    if size >= HELD_BYTES:
                        begin()
                else:
                    put(record)
                    if written >= ARCHIVE_BYTES:
                        out.close()
                        out = None
        if held:
            begin()
        if out is not None:
            out.close()
        yield pd.DataFrame({"archive": [n for n, _ in made], "records": [c for _, c in made]}).astype({"archive": object, "records": "int64"})

    return write


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, few_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Write a record per page into .warc.zst archives in a folder that all executors share; returns archive, records.

    Of pages whose payloads are equal (SHA-256) and of at least min_revisit bytes, the one with the largest page_id is
    the response and the others are revisits of it. Only digests are grouped, aggregated before the shuffle. Where few
    payloads repeat, they go to the pages; else the pages' ids and digests alone are joined with them, and a page finds
    what it revisits by its id and digest, in the one shuffle that deals pages among the writers. So a payload that a
    third of the pages share gathers nowhere.

    Null payloads are empty. Rows that repeat the largest page_id with the same payload are all responses; a null
    page_id revisits the largest there is, or is a response if there is none. Folder may be any URI of a file system.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", "html", F.unhex(F.sha2(payload, 256)).alias("digest"))
    groups = own.filter(F.octet_length(payload) >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.filter("n > 1").select("digest", "last"), "payloads")
    few = bounded(groups, most=few_bytes, text_bytes=48)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    parts = shuffle_parts(pages.sparkSession)
    dealt = F.xxhash64("page_id", "digest")
    if few is not groups:
        marked = own.join(few, "digest", "left").withColumn("refers_to", refers).repartition(parts, dealt)
    else:
        marks = own.select("page_id", "digest").join(groups, "digest").withColumn("refers_to", refers).filter("refers_to IS NOT NULL")
        marks = marks.select(dealt.alias("_at"), F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to").distinct().repartition(parts, "_at")
        sent = own.withColumn("at", dealt).repartition(parts, "at")
        same = (sent["at"] == marks["_at"]) & sent["page_id"].eqNullSafe(marks["_page"]) & (sent["digest"] == marks["_digest"])
        marked = sent.join(marks, same, "left")
    return cut(marked.select("page_id", "url", "html", "refers_to").mapInPandas(_writer(folder), "archive string, records long"), "archives")


def _reader(folder: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["archive"]:
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows = []
                    for record in read_archive(stream):
                        fields, payload = parse_record(record)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = fields["WARC-Type"] == "revisit"
                        if not revisit and (digest_of(payload) != digest or len(payload) != int(fields["X-Payload-Length"])):
                            raise ValueError(f"a payload in {name} does not have its digest")
                        page_id, to = fields["X-Page-ID"], fields.get("X-Refers-To-Page")
                        rows.append((None if page_id == "none" else int(page_id), int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], None if to is None else int(to)))
                        if len(rows) == 2000:
                            yield _frame(rows)
                            rows = []
                    yield _frame(rows)

    return read


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row per record of the listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Every response's payload is held against its digest and length; one that differs, or a cut archive, is an error.
    """
    listed = archives.filter("records > 0").repartition(shuffle_parts(archives.sparkSession), F.xxhash64("archive"))
    return listed.mapInPandas(_reader(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back. An empty table gives no archive and no rows."""
    folder = scratch_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_archives(write_archives(pages, folder, min_revisit), folder)
