"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywick.llm.common import cut, give_back

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
#: Pieces packed together by one task. A group leaves about one sequence part-filled, so larger groups waste less; at
#: this size that is under one sequence in a thousand, and a group is a few MB.
GROUP_PIECES = 16_384
#: Distinct words, and distinct parts of words, whose ids a Python worker keeps; rarer ones are encoded anew each time.
CACHED = 100_000
#: Words encoded at a time; bounds memory, not what is encoded.
CHUNK_WORDS = 200_000

#: Words of these characters alone are split and lower-cased here, all others by the tokenizer: in this range both agree.
_PLAIN = re.compile("[!-~\xc0-\xff]+").fullmatch
#: The vocabulary's own way to split lower-case text, for these characters: contractions, letters, single digits, signs.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-/:-@\\[-`{-~\xd7\xf7]+").findall

_encoders: dict[str, _WordEncoder] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte of UTF-8 as a printable character: itself, or one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(0x100 + rest.index(b)) for b in range(256)}


class _WordEncoder:
    """Ids of words under a vocabulary whose tokens never span white space, with those of frequent words kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.parts: dict[str, list[int]] = {}
        self.index: dict[str, int] = {}
        self.flat, self.length = array("I"), array("q")

    def _part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            text = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            ids = [t.id for t in self.split(text)]
            if len(self.parts) < CACHED:
                self.parts[part] = ids
        return ids

    def _word(self, word: str) -> list[int]:
        if _PLAIN(word) and "<|" not in word:
            return [i for part in _PARTS(word.lower()) for i in self._part(part)]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after the other, and how many each word has."""
        get = self.index.get
        which = np.array([get(w, -1) for w in words], np.int64)
        held, rare = len(self.index), {}
        for i in np.flatnonzero(which < 0).tolist():
            word = words[i]
            k = self.index.get(word, rare.get(word))
            if k is None:
                ids = self._word(word)
                if len(self.index) < CACHED and not rare:
                    k = self.index[word] = len(self.index)
                    held = k + 1
                else:
                    k = rare[word] = held + len(rare)
                self.flat.extend(ids)
                self.length.append(len(ids))
            which[i] = k
        flat, length = np.array(self.flat, np.uint32), np.array(self.length, np.int64)
        if rare:
            del self.flat[len(self.flat) - int(length[held:].sum()) :]
            del self.length[held:]
        ends = np.cumsum(length)
        own = length[which]
        upto = np.cumsum(own)
        return flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat((ends - length)[which] - (upto - own), own)], own


def text_ids(texts: list[str | None], path: str, end_id: int = END_ID) -> Iterator[np.ndarray]:
    """The ids of each text, then the end id. Texts are split at ASCII white space, which no token of the vocabulary
    spans, and never cut; about CHUNK_WORDS words are encoded at a time, of several texts or of a part of one."""
    encoder = _encoders.get(path)
    if encoder is None:
        encoder = _encoders[path] = _WordEncoder(path)
    end = np.array([end_id], np.uint32)
    words: list[str] = []
    counts: list[int] = []

    def flush() -> Iterator[np.ndarray]:
        ids, own = encoder.encode(words)
        upto = np.concatenate([[0], np.cumsum(own)])[np.cumsum([0, *counts])]
        for k in range(len(counts)):
            yield np.concatenate([ids[upto[k] : upto[k + 1]], end])

    for text in texts:
        fresh = _split(text or "")
        if counts and len(words) + len(fresh) > CHUNK_WORDS:
            yield from flush()
            words, counts = [], []
        if len(fresh) > CHUNK_WORDS:
            yield np.concatenate([*(encoder.encode(fresh[i : i + CHUNK_WORDS])[0] for i in range(0, len(fresh), CHUNK_WORDS)), end])
        else:
            words += fresh
            counts.append(len(fresh))
    if counts:
        yield from flush()


def _split(text: str) -> list[str]:
    """Runs of anything but ASCII white space; str.split alone also splits at other characters, so it serves only texts without them."""
    if text.isascii():
        return text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else [w.decode() for w in text.encode().split()]
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


class BestFit:
    """Open bins by remaining capacity, in a segment tree over the capacities: its leaves hold stacks of bins, its
    inner nodes how many bins lie below. The tightest bin that fits is found in logarithmic time."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def _add(self, room: int, n: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def _tightest(self, need: int) -> int:
        """The smallest remaining capacity of at least need that some open bin has; -1 if none."""
        count, node = self.count, need + self.leaves
        if count[node]:
            return need
        while node > 1 and (node & 1 or not count[node + 1]):
            node >>= 1
        if node <= 1:
            return -1
        node += 1
        while node < self.leaves:
            node *= 2
            if not count[node]:
                node += 1
        return node - self.leaves

    def place(self, length: int) -> tuple[int, int]:
        """Put a piece into the tightest bin that fits, else into a new one; its bin and its place there."""
        room = self._tightest(length)
        if room < 0:
            room, which = self.capacity, self.bins
            self.bins += 1
        else:
            which = self.open[room].pop()
            self._add(room, -1)
        if room > length:
            self.open[room - length].append(which)
            self._add(room - length, 1)
        return which, self.capacity - room


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(path: str, capacity: int, end_id: int):
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                rows = []
                for doc_id, ids in zip(part["doc_id"].tolist(), text_ids(part["text"].tolist(), path, end_id), strict=True):
                    doc_id = None if doc_id is None or doc_id != doc_id else int(doc_id)
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        rows.append((doc_id, k, start, len(own), zlib.crc32(own.astype("<u4").tobytes())))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})
        give_back()

    return pieces


def _packer(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        tree = BestFit(capacity)
        placed = [tree.place(int(n)) for n in group["length"]]
        own = group.drop(columns=["grp"])
        own["sequence_id"] = np.array([b for b, _ in placed], np.int64) + (group["grp"].to_numpy(np.int64) << 32)
        own["offset"] = np.array([o for _, o in placed], np.int64)
        return own

    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens by best-fit decreasing.

    A document is its ids and the end id; only a longer one is cut, into full pieces and a rest. Pieces are dealt at
    random into groups of about ``group_pieces``, each packed whole: the longest first, each into the tightest open
    sequence that holds it. Only ids, lengths and checksums are shuffled, never texts.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece. Null and empty texts are
    the end id alone. Rows that repeat an id are documents of their own. An empty table gives no rows; further columns
    play no part.
    """
    path = tokenizer or public_tokenizers.path(VOCABULARY)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = cut(given.mapInPandas(_cutter(path, capacity, end_id), PIECES), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(_packer(capacity), PIECES + ", sequence_id long, offset long")
