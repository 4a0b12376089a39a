import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallywick.llm import packing as pk

PATH = public_tokenizers.path(pk.VOCABULARY)


@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), max_size=6))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_tokenizers(texts):
    plain = Tokenizer.from_file(PATH)
    for text, ids in zip(texts, pk.text_ids(texts, PATH), strict=True):
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("cached", [0, 3, 300_000])
def test_rare_words_and_small_caches(monkeypatch, cached):
    monkeypatch.setattr(pk, "CACHED", cached)
    monkeypatch.setattr(pk, "CHUNK_WORDS", 7)
    monkeypatch.setattr(pk, "_encoders", {})
    texts = ["don't WE'LL x's 12 ###ab é É ß", None, "", "a b c " * 9, "<|endoftext|> ﬁ Σ ç", "a\x1cb c d"]
    plain = Tokenizer.from_file(PATH)
    for _ in range(2):
        for text, ids in zip(texts, pk.text_ids(texts, PATH), strict=True):
            assert ids.tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 1]


@given(st.lists(st.integers(1, 50), max_size=120))
@settings(max_examples=100, deadline=None)
def test_tree_is_best_fit(lengths):
    tree, rooms = pk.BestFit(50), []
    for n in sorted(lengths, reverse=True):
        which, offset = tree.place(n)
        fits = [r for r in rooms if r >= n]
        if fits:
            assert 50 - offset == rooms[which] == min(fits)
        else:
            assert which == len(rooms) and offset == 0
            rooms.append(50)
        rooms[which] -= n


def test_pieces_and_sequences(docs_of, odd_rows):
    rows = [(k, t) for k, (_, t) in enumerate(odd_rows)]
    plain = Tokenizer.from_file(PATH)
    out = pk.pack(docs_of(rows), capacity=64, group_pieces=200).toPandas()
    for k, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = out[out.doc_id == k].sort_values("piece")
        want = [(i, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for i, s in enumerate(range(0, len(ids), 64))]
        assert list(own[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 64


def test_repeats_nulls_and_empty(docs_of, odd_rows):
    out = pk.pack(docs_of(odd_rows)).toPandas()
    assert len(out[out.piece == 0]) == len(odd_rows)
    assert pk.pack(docs_of([])).count() == 0
