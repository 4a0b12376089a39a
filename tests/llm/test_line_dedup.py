"""Line dedup against a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallywick.llm import line_dedup
from tallywick.llm.common import mix

WS = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def plain(rows, min_docs, min_points=1, keep_first=False):
    n, first = Counter(), {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for k in {key_of(x) for x in (r[1] or "").split("\n")}:
            n[k] += 1
            first.setdefault(k, r)
    out = []
    for r in rows:
        lines, kept, seen = (r[1] or "").split("\n"), [], set()
        for x in lines:
            k = key_of(x)
            gone = k and len(k) >= min_points and n[k] >= min_docs
            if not gone or (keep_first and first[k] == r and k not in seen):
                kept.append(x)
            seen.add(k)
        out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("keep_first", [False, True])
def test_equals_plain_version(docs_of, keep_first):
    rng = random.Random(3)
    pool = [f"Line {i} of the pool" for i in range(60)] + ["É", "é", "  padded\t", "PADDED", "", " ", "x" * 5000]
    weights = [1 / (i + 1) for i in range(len(pool))]
    rows = [(i if i % 9 or keep_first else None, "\n".join(rng.choices(pool, weights, k=rng.randrange(0, 12)) + [f"own {i}"]) if i % 11 else None) for i in range(120)]
    rows += [] if keep_first else [(7, rows[7][1])] * 3
    found = line_dedup.drop_repeated_lines(docs_of(rows), min_docs=4, keep_first=keep_first).collect()
    assert ordered(found) == ordered(plain(rows, 4, keep_first=keep_first))


def test_odd_rows(docs_of, odd_rows):
    found = line_dedup.drop_repeated_lines(docs_of(odd_rows), min_docs=3).collect()
    assert ordered(found) == ordered(plain(odd_rows, 3))
    assert {r["doc_id"]: r["n_lines"] for r in found}[2] == 1


def test_longer_keys_only(docs_of):
    rows = [(i, "ab\nlonger line\néé\n") for i in range(5)]
    found = line_dedup.drop_repeated_lines(docs_of(rows), min_docs=5, min_points=3).collect()
    assert ordered(found) == ordered(plain(rows, 5, 3))
    assert found[0]["text"] == "ab\néé\n"


def test_empty_table(docs_of):
    assert line_dedup.kept_lines(docs_of([(1, "x")]).filter("doc_id > 1")).collect() == []


def test_query_digests(docs_of):
    rows = [(i, f"shared\nown {i}\n  SHARED ") for i in range(10)]
    found = {r["doc_id"]: r for r in line_dedup.kept_lines(docs_of(rows)).collect()}
    assert found[3]["kept_sha256"] == hashlib.sha256(b"own 3").hexdigest() and found[3]["n_dropped"] == 2


def test_shuffled_joins_give_the_same(docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "bounded", lambda df, **_: df)
    rows = [(i, f"shared\nown {i}") for i in range(30)]
    assert ordered(line_dedup.drop_repeated_lines(docs_of(rows)).collect()) == ordered(plain(rows, 10))


def test_many_small_chunks(docs_of, monkeypatch):
    rows = [(i, f"a{i % 7}\nb{i % 3}\nown {i}") for i in range(300)]
    monkeypatch.setattr(line_dedup, "CHUNK_LINES", 8)
    assert ordered(line_dedup.drop_repeated_lines(docs_of(rows)).collect()) == ordered(plain(rows, 10))


def test_filters_miss_nothing_and_err_little():
    hashes = mix(np.arange(1, 20001, dtype=np.uint64))
    seen = line_dedup.SeenTwice(30000)
    seen.add(hashes)
    seen.add(hashes[:5000])
    seen.add_repeated(mix(np.arange(50000, 55000, dtype=np.uint64)))
    assert set(hashes[:5000].tolist()) <= set(seen.suspected(hashes).tolist())
    assert len(seen.suspected(hashes[5000:])) < 150
    assert len(seen.suspected(mix(np.arange(50000, 55000, dtype=np.uint64)))) == 5000


def test_slices_cover_the_hash_space():
    hashes = mix(np.arange(1, 10001, dtype=np.uint64))
    of = line_dedup.slice_of(hashes, 7)
    assert set(of.tolist()) == set(range(7)) and (np.diff(line_dedup.slice_of(np.sort(hashes), 7).astype(int)) >= 0).all()
