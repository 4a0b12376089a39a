import random
import re
from collections import Counter, defaultdict

from tallywick.llm import near_dedup as nd

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverse = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverse[g].append(i)
    for i, s in sets.items():
        for j, n in Counter(k for g in s for k in inverse[g] if k < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_matches_brute_force_on_chains_and_groups(docs_of):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(5, 150))]
        for _ in range(rnd.randint(1, 25)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((n, " ".join(copy)))
            n += 1
            if rnd.random() < 0.2:
                base = copy
    rnd.shuffle(rows)
    got = {r[0]: tuple(r)[1:] for r in nd.near_groups(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_matches_brute_force_where_many_share_a_part(docs_of):
    rnd = random.Random(9)
    shared = [f"p{i}" for i in range(120)]
    rows, n = [], 0
    for g in range(60):
        own = [f"g{g}x{i}" for i in range(rnd.choice([12, 25, 34, 45, 60, 80]))]
        for _ in range(rnd.choice([1, 1, 1, 2, 4])):
            words = shared[: rnd.randint(90, 120)] + own
            for _ in range(rnd.choice([0, 1, 2])):
                words[rnd.randrange(len(words))] = f"y{n}"
            rows.append((n, " ".join(words)))
            n += 1
    rnd.shuffle(rows)
    got = {r[0]: tuple(r)[1:] for r in nd.near_groups(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_odd_rows(docs_of, odd_rows):
    out = nd.near_groups(docs_of(odd_rows)).collect()
    assert len(out) == len(odd_rows)
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    for i in (1, 2, 3):
        assert tuple(by[i])[1:] == (0, i, True)
    assert by[4]["component_id"] == by[5]["component_id"] == by[9]["component_id"] == 4
    assert [r["kept"] for r in out if r["doc_id"] == 5] == [False, False]
    assert all(r["component_id"] is None and r["kept"] for r in out if r["doc_id"] is None)
    assert by[6]["n_shingles"] == 1 and by[7]["n_shingles"] == 1
    assert nd.near_groups(docs_of([])).count() == 0


def test_upper_case_is_ascii_only(docs_of):
    rows = [(1, "A B C D E"), (2, "a b c d e"), (3, "É b c d e"), (4, "é b c d e")]
    assert {r["doc_id"]: r["component_id"] for r in nd.near_groups(docs_of(rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_long_texts_hash_the_same_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(20_000))
    whole = list(nd.shingle_sets([text, "", "a b"]))
    monkeypatch.setattr("tallywick.llm.common.SEGMENT", 1000)
    parts = list(nd.shingle_sets([text, "", "a b"]))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, parts, strict=True))


def test_sketches_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    one, two = pool[:2000], pool[200:2200]  # similarity 1800 / 2200
    low = nd.minhashes([one, two])
    a, b = nd.odd_sketches(low)
    differing = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
    d = np.log(1 - 2 * differing / nd.SKETCH_BITS) / np.log(1 - 2 / nd.SKETCH_BITS)
    assert abs(1 - d / (2 * nd.SAMPLES) - 1800 / 2200) < 0.1
    assert differing <= nd.max_differing_bits()


def test_drop_keeps_the_smallest_id(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    kept = nd.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 8, None}


def test_components_of_chains_stars_and_rings(spark):
    rnd = random.Random(3)
    names = rnd.sample(range(1000), 120)
    edges = [(names[i], names[i + 1]) for i in range(40)] + [(names[50], names[51 + i]) for i in range(20)] + [(names[80 + i], names[80 + (i + 1) % 10]) for i in range(10)] + [(names[100], names[100])]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in nd.components(spark.createDataFrame(edges * 2, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent if n != names[100]}
    assert nd.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_partner_of_many_is_sent_once_for_each_part(docs_of, monkeypatch):
    monkeypatch.setattr(nd, "PARTNERS", 3)
    rows = [(i, " ".join(f"w{j}" for j in range(60)) + f" x{i}") for i in range(40)] + [(100 + i, " ".join(f"v{j}" for j in range(i, i + 40))) for i in range(12)]
    got = {r[0]: tuple(r)[1:] for r in nd.near_groups(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_dropping_keeps_odd_rows_and_empty_tables(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    kept = nd.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7, 8] and ids.count(None) == 2
    assert nd.drop_near_copies(docs_of([])).count() == 0
