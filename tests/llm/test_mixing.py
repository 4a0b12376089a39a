import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywick.llm import mixing
from tallywick.llm.mixing import capped_targets, mix, mixed_rows, ranked_sources, split_quotas


def plain_targets(sizes, weights, cap=3):
    target, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        share = left / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * share > cap * sizes[i]}
        for i in over or free:
            target[i] = float(cap * sizes[i]) if over else weights[i] * share
            left -= target[i] if over else 0
        free = free - over if over else set()
    return target


def test_sources_rank_by_code_point_and_null_is_last(spark):
    names = ["b", None, "a", "Z", "", "\uffff", "\U00010000", "-", "~"]
    keyed = spark.createDataFrame([(n,) for n in names], "source string").select(mixing._source_key(F.col("source")).alias("source"))
    ranks = {r["source"]: r["rank"] for r in ranked_sources(keyed).collect()}
    order = sorted(names, key=lambda n: (n is None, n or ""))
    assert [ranks["~" if n is None else "=" + n] for n in order] == list(range(len(names)))


@pytest.mark.parametrize(("sizes", "weights"), [([100, 100, 100], [5, 2, 1]), ([10, 1000, 1], [5, 2, 1]), ([0, 7], [5, 2]), ([0, 0], [1, 1]), ([5], [5]), ([1, 2, 4, 8, 900, 3], [5, 2, 1, 5, 2, 1])])
def test_targets(spark, sizes, weights):
    rows = spark.createDataFrame([(i, s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "i int, source_size long, weight double")
    targets = [r["target"] for r in sorted(capped_targets(rows).collect())]
    assert targets == pytest.approx(plain_targets(sizes, weights))
    assert sum(targets) == pytest.approx(sum(sizes))


def brute_mix(rows, targets, shards, block_words, seed):
    """(doc_id, place, size, source) to copies and shards, by the rule of the docstring, in plain Python."""
    prime, out, plan = (1 << 31) - 1, {}, {}
    order = sorted({r[3] for r in rows})
    for s in order:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: r[1])
        size = sum(r[2] for r in own)
        blocks = max(1, math.ceil(size / block_words))
        spot = {r[0]: (((r[1] % (1 << 64)) >> 16) % blocks) * prime % blocks for r in own}
        whole = min(3, int(targets[s] // size)) if size else 0
        rest, edge, ahead = targets[s] - whole * size, -1, 0
        words = [sum(r[2] for r in own if spot[r[0]] == k) for k in range(blocks)]
        for k in range(blocks):
            if words[k] and rest > 0 and sum(words[:k]) < rest:
                edge, ahead = k, sum(words[:k])
        room, more = rest - ahead, set()
        if edge >= 0:
            near = [r for r in own if r[2] > 0 and edge <= spot[r[0]] < edge + mixing.EDGE_BLOCKS]
            gap = room
            while able := [r for r in near if r[0] not in more and r[2] <= gap]:
                filled, now = 0, set()
                for r in able:
                    filled += r[2]
                    if filled <= gap:
                        now.add(r[0])
                more |= now
                gap = room - sum(r[2] for r in near if r[0] in more)
            best = min(((abs(gap - r[2]), r[1], r[0]) for r in near if r[0] not in more and abs(gap - r[2]) < gap), default=None)
            more |= {best[2]} if best else set()
        for r in own:
            out[r[0]] = whole + (spot[r[0]] < edge or r[0] in more)
        plan[s] = (whole * blocks + edge + 1, blocks, spot)
    drawn = [s for s in order if plan[s][0]]
    upto = np.cumsum(split_quotas(np.array([plan[s][0] for s in drawn]), shards, seed), axis=0)
    result = {}
    for r in rows:
        quota, blocks, spot = plan[r[3]]
        draws = [min(e * blocks + spot[r[0]], quota - 1) for e in range(out[r[0]])]
        result[r[0]] = [int((upto[:, drawn.index(r[3])] <= d * prime % quota).sum()) for d in draws]
    return result


def test_draws_match_a_plain_version(spark, docs_of):
    rng = np.random.default_rng(1)
    rows = [(i, f"u{i} " + "w " * int(rng.integers(0, 90)) * (1 + 20 * (i % 97 == 0)), f"s{int(rng.integers(0, 30)) ** 2 % 8}") for i in range(700)]
    docs = docs_of(rows)
    options = {"shards": 16, "block_words": 150, "seed": 7}
    got = {r["doc_id"]: r for r in mix(docs, **options).collect()}
    held = docs.select("doc_id", F.xxhash64("doc_id", "text", F.lit(7)).alias("place")).collect()
    plain = [(r["doc_id"], r["place"], got[r["doc_id"]]["size"], rows[r["doc_id"]][2]) for r in held]
    want = brute_mix(plain, {r[3]: got[r[0]]["target"] for r in plain}, 16, 150, 7)
    assert {i: list(r["shards"]) for i, r in got.items()} == want
    assert all(r["taken"] == len(want[i]) * r["size"] for i, r in got.items())
    assert len({s for shards in want.values() for s in shards}) == 16


def test_quotas_are_exact_and_repeatable():
    quotas = np.array([1000, 37, 0, 5])
    parts = split_quotas(quotas, 13, 3)
    assert (parts.sum(axis=0) == quotas).all() and (parts >= 0).all()
    assert (parts == split_quotas(quotas, 13, 3)).all()
    totals = parts.sum(axis=1)
    assert totals.max() - totals.min() <= 2


def test_mix_meets_targets(docs_of):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(1, 60)), ["a", "b", None, "c"][min(3, int(rng.integers(0, 9)) // 2)]) for i in range(600)]
    out = mix(docs_of(rows)).collect()
    again = mix(docs_of(list(reversed(rows)))).collect()
    key = lambda rs: sorted((r["doc_id"], r["taken"], tuple(r["shards"])) for r in rs)
    assert key(out) == key(again)
    source = {r[0]: r[2] for r in rows}
    for s in ("a", "b", "c", None):
        own = [r for r in out if source[r["doc_id"]] == s]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 8
    assert all(r["taken"] == len(r["shards"]) * r["size"] <= 3 * r["size"] for r in out)
    assert {s for r in out for s in r["shards"]} <= set(range(64))


def test_odd_rows_and_empty(docs_of, odd_rows):
    out = mix(docs_of(odd_rows)).collect()
    assert len(out) == len(odd_rows)
    assert {r["doc_id"]: r["size"] for r in out if r["doc_id"] in (1, 2, 3, 6, 7)} == {1: 0, 2: 0, 3: 0, 6: 60_000, 7: 1}
    assert mix(docs_of([])).count() == 0
    assert all(r["target"] == 0 and r["taken"] == 0 for r in mix(docs_of([(1, None), (2, "")])).collect())


def test_mixed_rows_repeat_documents(docs_of):
    rows = [(i, "w " * (i % 20 + 1), "a" if i < 10 else "b") for i in range(200)]
    docs = docs_of(rows)
    want = {r["doc_id"]: len(r["shards"]) for r in mix(docs).collect()}
    got = mixed_rows(docs)
    assert got.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in want.items() if v}
    assert mixed_rows(docs_of([])).count() == 0


def test_repeated_and_null_ids_are_mixed_as_rows_of_their_own(docs_of):
    rows = [(None if i % 3 else 7, f"t{i} " + "w " * (i % 9), None if i % 2 else "a") for i in range(300)]
    docs = docs_of(rows)
    taken = mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 5 for r in taken)
    words = lambda t: len(t.split())
    assert sum(words(r["text"]) for r in mixed_rows(docs).collect()) == sum(r["taken"] for r in taken)


def plan_of(docs, **options):
    return mixing.Plan(docs, "doc_id", "text", "source", (5, 2, 1), options.get("shards"), options.get("block_words"), options.get("seed", 7))


def drawn_by(plan):
    """Draws per source (rows) and shard, and the sources' quotas."""
    rows = [r for r in plan.sources.collect() if r["quota"]]
    out = np.zeros((len(rows), plan.shards), np.int64)
    for i, r in enumerate(rows):
        out[i, r["shards"]] = np.diff([0, *r["upto"]])
    return out, np.array([r["quota"] for r in rows])


def test_a_tree_of_more_shards_than_top_nodes_takes_the_same(docs_of, monkeypatch):
    rows = [(i, "w " * (i % 20 + 1), "a" if i < 100 else "b") for i in range(400)]
    monkeypatch.setattr(mixing, "TOP_NODES", 4)
    out = mix(docs_of(rows), shards=10, block_words=16).collect()
    assert {s for r in out for s in r["shards"]} == set(range(10))
    draws, quotas = drawn_by(plan_of(docs_of(rows), shards=10, block_words=16))
    assert (draws.sum(axis=1) == quotas).all() and np.ptp(draws.sum(axis=0)) <= 3
    monkeypatch.undo()
    assert {r["doc_id"]: r["taken"] for r in out} == {r["doc_id"]: r["taken"] for r in mix(docs_of(rows), shards=3, block_words=16).collect()}


def test_600_shards_and_4700_sources_draw_hypergeometrically(docs_of):
    rows = [(i, "w " * 8, f"s{i % 7000 if i % 3 else i % 40}") for i in range(30_000)]
    plan = plan_of(docs_of(rows), shards=600, block_words=8)
    draws, quotas = drawn_by(plan)
    assert len(quotas) > mixing.TOP_CELLS // mixing.TOP_NODES and plan.shards > mixing.TOP_NODES
    assert (draws.sum(axis=1) == quotas).all()
    per, total = draws.sum(axis=0), int(quotas.sum())
    assert np.ptp(per) <= 3
    # the variance of a source's draws over the shards, against a hypergeometric draw of total / shards
    each = total / 600
    want = each * (quotas / total) * (1 - quotas / total) * (total - each) / (total - 1)
    got = ((draws - quotas[:, None] / 600) ** 2).mean(axis=1)
    large = quotas >= np.sort(quotas)[-100]
    for some in (large, ~large):
        assert abs(got[some].sum() / want[some].sum() - 1) < 0.1


def test_sources_are_pooled_without_losing_draws(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "TOP_CELLS", 6 * 16)
    rows = [(i, "w " * (i % 30 + 1), f"s{i % 40 if i % 2 else 0}") for i in range(900)]
    draws, quotas = drawn_by(plan_of(docs_of(rows), shards=16, block_words=20))
    assert (draws.sum(axis=1) == quotas).all() and np.ptp(draws.sum(axis=0)) <= 3
