"""Collocations against a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywick.llm import phrases


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def counted(rows, max_words):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return n, f


def plain(rows, max_words=3, min_count=10, contained=50, top=2000):
    out = []
    n, counts = counted(rows, max_words)
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in good.items():
            longer = (b for q, b in good.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(100 * b >= contained * a for b in longer):
                continue
            s, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def table(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    for name in ("phrase", "n", "words", "rank", "score", "size"):
        df = df.withColumn(name, df["text"])
    return df


def made(n, seed, words="a b C d É é the of New York x\x1cy"):
    rng = random.Random(seed)
    pool = words.split(" ")
    return [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(pool) + rng.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n", "\r\n", "\x0b"]) for _ in range(rng.randrange(0, 40)))) for _ in range(n)]


@pytest.mark.parametrize(("max_words", "contained", "top"), [(3, 50, 2000), (4, 30, 25), (2, 50, 5)])
def test_equals_plain_version(spark, max_words, contained, top):
    rows = made(150, max_words) + [("en", None), ("en", ""), (None, " .,"), ("only", "once here")]
    found = phrases.collocations(table(spark, rows), max_words=max_words, min_count=10, contained=contained, top=top).collect()
    assert sorted(map(tuple, found)) == plain(rows, max_words, 10, contained, top)


def test_many_tries_and_ranges_are_merged(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TRIE_BYTES", 200)
    monkeypatch.setattr(phrases, "RANGE_BYTES", 500)
    monkeypatch.setattr(phrases, "MERGE_NODES", 50)
    rows = made(200, 8) + [("en", "very " * 3000)]
    found = phrases.collocations(table(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, found)) == plain(rows)


def test_counts(spark):
    rows = made(80, 4)
    nodes, words = phrases.phrase_counts(table(spark, rows), min_count=1)
    n, f = counted(rows, 3)
    assert {(r["lang"], r["phrase"]): r["n"] for r in nodes.collect()} == {(lang, " ".join(p)): c for lang, own in f.items() for p, c in own.items()}
    assert {r["lang"]: r["n"] for r in words.collect()} == {k: v for k, v in n.items() if v} | {k: 0 for k, v in n.items() if not v}


def test_empty_table(spark):
    assert phrases.collocations(table(spark, [("en", "x")]).filter("lang = 'de'")).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 999_999_999_989, 999_999_999_999, 123_456_789_012_345
    row = spark.range(1).select(phrases.score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row["s"] == 10**6 * a * a // (left * right)


def nodes_of(run):
    return [[(bytes(p.as_py()), int(c)) for p, c in zip(run.phrases(d, np.arange(len(n))), n)] for d, (_, n) in enumerate(run.levels)]


def test_trie_levels_come_sorted():
    run = phrases.trie(b"b a b. a B\tb a", 3)
    assert nodes_of(run) == [[(b"a", 3), (b"b", 4)], [(b"a b", 2), (b"b a", 2), (b"b b", 1)], [(b"a b b", 1), (b"b a b", 1), (b"b b a", 1)]]


def test_runs_are_cut_packed_and_merged_without_loss():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("a b c d ab".split()) for _ in range(200)).encode() for _ in range(4)]
    runs = [phrases.trie(t, 3) for t in texts]
    whole = nodes_of(phrases.trie(b"\n".join(texts), 3))
    assert nodes_of(phrases.merge(runs)) == whole
    bounds = [(b"a", b"c", b"z"), (b"ab",), (b"b", b"a"), (b"c", b"zz", b"a")]
    parts = [[] for _ in range(5)]
    for run in runs:
        known = run.words.to_pylist()
        edges = [[0, *(run.starts(d, b, known) for b in bounds), len(n)] for d, (_, n) in enumerate(run.levels)]
        for k in range(5):
            parts[k].append(phrases.Run.unpack(*run.between([slice(e[k], e[k + 1]) for e in edges]).pack(), 3))
    cut = [nodes_of(phrases.merge(p)) for p in parts]
    assert [sum((c[d] for c in cut), []) for d in range(3)] == whole
    words = [tuple(p.split(b" ")) for k in range(5) for level in cut[k] for p, _ in level]
    low = [sorted(w for level in cut[k] for w in [tuple(p.split(b" ")) for p, _ in level]) for k in range(5)]
    assert len(words) == len(set(words)) and all(a[-1] < b <= c[0] for a, b, c in zip(low, bounds, low[1:]))
