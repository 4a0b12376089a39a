"""Conversation repair against a plain version that tries every edit."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from tallywick.llm import conversations
from tallywick.llm.conversations import ASSISTANT_, FAR, NONE, USER_, Block

WS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def order(r):
    return (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest())


def cheapest(turns):
    """(cost, audit) of turns (initial, forced, truncated), by the cheapest and then least audit from each state on."""
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        ways = []
        if i == len(turns) and state in ("", "a"):
            ways.append((0, ""))
        if i < len(turns):
            initial, forced, open_ = turns[i]
            ways.append(step(4, "D", best(i + 1, state, 0)))
            if not forced:
                more = 3 if open_ else 0
                if (state, initial) in go:
                    ways.append(step(more, "K", best(i + 1, initial, 0)))
                for x in "ua":
                    if (state, x) in go:
                        ways.append(step(3 + more, "R", best(i + 1, x, 0)))
        if inserts < 3:
            for x in "ua":
                if (state, x) in go:
                    ways.append(step(3, "I", best(i, x, inserts + 1)))
        return min(ways, default=(10**9, "~"))

    def step(cost, edit, rest):
        return cost + rest[0], edit + rest[1]

    return best(0, "", 0)


def plain(rows):
    """Every conversation's row, from its damaged turns."""
    out = []
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=order)
        known, kinds = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(WS)
            kinds.append("blank" if not bare else "duplicate" if (role, text) in known else "truncated" if bare[-1] not in ".!?" else "")
            known.add((role, text))
        cost, audit = cheapest(tuple((r[2][:1], k in ("blank", "duplicate"), k == "truncated") for r, k in zip(own, kinds)))
        lines, left, next_ = [], iter(own), "user"
        for edit in audit:
            row = next(left) if edit != "I" else None
            if edit == "D":
                continue
            role, text = (row[2] if edit == "K" else next_, row[3]) if row else (next_, "")
            lines.append(f"{role}:{text}")
            next_ = "assistant" if role[0] == "u" else "user"
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out.append((conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(n, seed, convs=12):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "ux"]
    texts = ["Yes.", "No!", "open end", "", "  ", None, "Why?\n", "a. ", "é…", "x" * 300]
    return [(rng.choice([None, *range(convs)]), rng.choice([None, *range(30)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def as_table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "part", "block", "audit", "copies", "place", "kind"):
        df = df.withColumn(name, df["role"])
    return df


@pytest.mark.parametrize(("n", "seed", "block"), [(160, 1, 2048), (400, 2, 3), (300, 3, 1)])
def test_equals_plain_version(spark, n, seed, block):
    rows = made(n, seed, 40 if seed == 1 else 6)
    found = conversations.repair(as_table(spark, rows), block=block).collect()
    assert sorted(map(tuple, found), key=repr) == plain(rows)


def test_one_long_conversation_over_many_partitions(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"turn {i}" + rng.choice([".", "", "!"])) for i in range(700)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hi.")]
    found = conversations.repair(as_table(spark, rows).repartition(4), block=64).collect()
    assert sorted(map(tuple, found), key=repr) == plain(rows)


def test_repeated_rows_are_one_row_with_copies(spark):
    rows = [(7, 1, "user", "Again.")] * 500 + [(7, 2, "assistant", "Yes.")]
    found = conversations.repair(as_table(spark, rows)).collect()
    assert sorted(map(tuple, found), key=repr) == plain(rows)
    assert conversations.faults(conversations.damaged(as_table(spark, rows))).count() == len(set(damage(rows))) < 3


def test_empty_table_and_dropped_conversation(spark):
    df = as_table(spark, [(1, 1, "user", "x")])
    assert conversations.repair(df.filter("turn > 1")).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = conversations.repair(as_table(spark, [(gone, 0, "user", "Hi.")])).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_blocks_compose():
    rng = random.Random(9)
    for _ in range(200):
        turns = [(rng.choice(["u", "a", "s", "x", ""]), rng.random() < 0.8, rng.random() < 0.3, rng.choice([1, 1, 2])) for _ in range(rng.randrange(1, 9))]
        at = rng.randrange(0, len(turns) + 1)
        whole, left, right = Block(turns), Block(turns[:at]), Block(turns[at:])
        for start, end in itertools.product(range(4), range(4)):
            ways = [(int(left.cost[start, k] + right.cost[k, end]), left.audit(start, k) + right.audit(k, end)) for k in range(4) if left.cost[start, k] < FAR and right.cost[k, end] < FAR]
            if whole.cost[start, end] >= FAR:
                assert not ways
            else:
                assert min(ways) == (int(whole.cost[start, end]), whole.audit(start, end))


def test_audits():
    block = Block([("u", True, False, 1), ("u", True, False, 1), ("a", True, False, 1)])
    assert int(block.cost[NONE, ASSISTANT_]) == 3 and block.audit(NONE, ASSISTANT_) == "KIKK"
    assert int(Block([("u", True, True, 1)]).cost[NONE, USER_]) == 3
    assert np.array_equal(Block([("u", False, False, 3)]).cost.diagonal(), [12] * 4)
