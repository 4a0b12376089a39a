"""Repair of conversations whose turns were damaged: a retained-subsequence dynamic program, block by block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywick.llm.common import bound_batches, cut, shuffle_parts

#: Roles that a repaired conversation has, by initial; states of the program: no turn retained yet, or the last one's role.
USER, ASSISTANT = "user", "assistant"
NONE, SYSTEM_, USER_, ASSISTANT_ = range(4)
STATES = 4
#: What edits cost. A truncated turn that stays costs RETAIN_TRUNCATED more.
DELETE, REROLE, INSERT, RETAIN_TRUNCATED = 4, 3, 3, 3
#: Turns of a conversation that one step of the program takes; only these are held at a time.
BLOCK = 2048
#: Above any cost, and small enough that sums of it stay within 64 bits.
FAR = 1 << 60
_SPACE = " \t\n\x0b\x0c\r"
# Turns to insert between the last retained role (row) and the next one (column), as the roles' order asks; no system
# turn may follow another. The last column is for the end.
_GAPS = np.array([[0, 0, 1, 0], [FAR, 0, 1, 2], [FAR, 1, 0, 1], [FAR, 0, 1, 0]], np.int64)
_INSERTED = np.where(_GAPS >= FAR, FAR, _GAPS * INSERT)
_INITIALS = {"s": SYSTEM_, "u": USER_, "a": ASSISTANT_}


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations as a fixed rule damages them: conv, turn, role, text, copies (how often a turn stands there).

    crc32 of conv and turn decides, modulo 20: 0 drops the turn, 1 empties its text, 2 removes its full stops, question
    and exclamation marks, 3 repeats it, 4 makes it the user's. Nulls stand as one space, but in turn itself.
    """
    space = F.lit(" ")
    conv, turn = F.col(conv_col).cast("string"), F.col(turn_col).cast("long")
    kind = F.crc32(F.concat(F.coalesce(conv, space), F.lit(":"), F.coalesce(turn.cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce(F.col(role_col), space), F.coalesce(F.col(text_col), space)
    rows = turns.select(conv.alias("conv"), turn.alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.select(
        "conv",
        "turn",
        F.when(F.col("kind") == 4, USER).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """The distinct turns of conversations (conv, turn, role, text, copies) without their texts: conv, turn, role, sha
    (of the text), copies, blank, repeated (role and text stood at an earlier turn), truncated.

    What repeats a turn altogether is one row with its copies, so a turn that is there a million times is one row too.
    The first turn of each role and text is a minimum, aggregated before the shuffle, and a join that skew can't stop.
    """
    bare = F.rtrim("text", F.lit(_SPACE))
    known = rows.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("sha"), "copies", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"))
    turns = cut(known.groupBy("conv", "turn", "role", "sha").agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("open").alias("truncated")), "turns")
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = turns.groupBy("conv", "role", "sha").agg(F.min(at).alias("first")).toDF("_conv", "_role", "_sha", "first")
    both = turns.join(first, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("sha") == F.col("_sha")))
    return both.select("conv", "turn", "role", "sha", "copies", "blank", (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("repeated"), "truncated")


def _costs(initial: str, free: bool, truncated: bool) -> list[int]:
    """What it costs to retain a turn as each role: nothing as its own, REROLE as another; FAR where it may not be."""
    if not free:
        return [FAR] * 3
    own, extra = _INITIALS.get(initial, NONE), RETAIN_TRUNCATED if truncated else 0
    return [extra if own == SYSTEM_ else FAR, extra + (0 if own == USER_ else REROLE), extra + (0 if own == ASSISTANT_ else REROLE)]


class Block:
    """Some turns of a conversation, one after the other: ``cost[r, e]`` is the least for going from the last retained
    role r before them to the last retained role e after them, and ``audit(r, e)`` the ASCII-least of its edits.

    Retained turns are chosen from the end: a gap between two of them costs the deletions within it, a difference of
    prefix sums, and the insertions that the pair of roles asks for. The running minimum per role of what follows, less
    the deletions before it, prices all gaps of a turn at once. Within a gap deletions come before insertions, which is
    ASCII-least.
    """

    def __init__(self, turns: list[tuple[str, bool, bool, int]]):
        self.turns, n = turns, len(turns)
        own = np.array([_costs(i, free, truncated) for i, free, truncated, _ in turns], np.int64).reshape(n, 3)
        copies = np.array([c for *_, c in turns], np.int64)
        self.own = own
        before = np.concatenate([[0], np.cumsum(copies * DELETE)])
        exits = np.full((STATES, STATES), FAR, np.int64)
        np.fill_diagonal(exits, 0)
        self.left = np.empty((n + 1, STATES, STATES), np.int64)
        self.left[n] = exits
        best = np.full((3, STATES), FAR, np.int64)  # by the role of the next retained turn, less the deletions before the block
        for i in range(n - 1, -1, -1):
            # a retained turn still loses its repetitions
            best = np.minimum(best, own[i][:, None] + self.left[i + 1][1:] + (before[i + 1] - DELETE))
            next_ = (_INSERTED[:, :3, None] + best[None]).min(axis=1)
            left = np.minimum(next_, exits + before[n]) - before[i]
            self.left[i] = np.where(left < FAR // 2, left, FAR)
        self.cost = self.left[0]

    def audit(self, start: int, end: int) -> str:
        out, role = [], start
        for i, (_, _, _, copies) in enumerate(self.turns):
            left, after = int(self.left[i][role, end]), self.left[i + 1][:, end]
            if copies * DELETE + int(after[role]) == left:
                out.append("D" * copies)
                continue
            ways = []
            for q in range(3):
                if int(_INSERTED[role, q]) + int(self.own[i][q]) + (copies - 1) * DELETE + int(after[q + 1]) == left:
                    ways.append(("I" * int(_GAPS[role, q]) + ("K" if _INITIALS.get(self.turns[i][0]) == q + 1 else "R"), q + 1))
            edit, role = min(ways)
            out.append(edit + "D" * (copies - 1))
        return "".join(out)


BLOCKS = "conv string, part int, block int, cost array<long>, order array<int>, audits array<string>, first string, last string, illegal long"


def _illegal(pairs: Iterator[tuple[str, str]]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in pairs)


def _blocks(block: int):
    """Sorted distinct turns (part, conv, initial, free, truncated, copies) to a row per block of a conversation."""

    def solve(conv: str | None, part: int, at: int, turns: list[tuple], begins: bool) -> tuple:
        made, cost, order, audits = Block(turns), [], [], []
        for start in range(STATES):
            found = [(made.audit(start, end) if made.cost[start, end] < FAR else None) if start == NONE or not begins else None for end in range(STATES)]
            ranked = sorted((a, end) for end, a in enumerate(found) if a is not None)
            cost += [int(c) for c in made.cost[start]]
            order += [next((k for k, (_, e) in enumerate(ranked) if e == end), STATES) for end in range(STATES)]
            audits += found
        initials = [t[0] for t in turns]
        illegal = _illegal(zip(initials, initials[1:], strict=False)) + sum(t[3] - 1 for t in turns)
        return conv, part, at, cost, order, audits, initials[0], initials[-1], illegal

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64()]
    names = [x.split(" ")[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, at, begins = None, [], 0, False
        for batch in batches:
            rows = []
            for part, conv, *turn in zip(*[batch.column(c).to_pylist() for c in ("part", "conv", "initial", "free", "truncated", "copies")], strict=True):
                if turns and key != (part, conv):
                    rows.append(solve(key[1], key[0], at, turns, begins and at == 0))
                    turns, at, begins = [], 0, True
                elif len(turns) == block:
                    rows.append(solve(key[1], key[0], at, turns, begins and at == 0))
                    turns, at = [], at + 1
                key = (part, conv)
                turns.append(tuple(turn))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)
        if turns:
            row = solve(key[1], key[0], at, turns, begins and at == 0)
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], names=names)

    return run


CHOSEN = "conv string, part int, block int, at int, tail int, total long, illegal long"


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks without their audits: for each the way through it that the cheapest, ASCII-least edits take (4 times
    the role before it and the one after), the turns to insert behind it, the conversation's cost and its illegal neighbours."""

    def solve(conv: str | None, held: list[tuple]) -> list[tuple]:
        costs = np.array([h[2] for h in held], np.int64).reshape(-1, STATES, STATES)
        left = _INSERTED[:, 3].copy()
        lefts = [left]
        for cost in costs[::-1]:
            left = np.minimum((cost + left[None]).min(axis=1), FAR)
            lefts.append(left)
        lefts.reverse()
        total, illegal = int(lefts[0][NONE]), sum(h[6] for h in held) + _illegal((a[5], b[4]) for a, b in zip(held, held[1:], strict=False))
        rows, role = [], NONE
        for k, (h, cost, after, before) in enumerate(zip(held, costs, lefts[1:], lefts, strict=False), 1):
            ways = [(h[3][STATES * role + e], e) for e in range(STATES) if int(cost[role, e]) < FAR and int(cost[role, e]) + int(after[e]) == int(before[role])]
            at = STATES * role + min(ways)[1]
            role = at % STATES
            rows.append((conv, h[0], h[1], at, int(_GAPS[role, 3]) if k == len(held) else 0, total, illegal))
        return rows

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("conv", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("at", pa.int32()), ("tail", pa.int32()), ("total", pa.int64()), ("illegal", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])

    key, held = None, []
    for batch in batches:
        rows = []
        for conv, *rest in zip(*[batch.column(c).to_pylist() for c in ("conv", "part", "block", "cost", "order", "first", "last", "illegal")], strict=True):
            if held and conv != key:
                rows += solve(key, held)
                held = []
            key = conv
            held.append(tuple(rest))
        if rows:
            yield made(rows)
    if held:
        yield made(solve(key, held))


class Repair:
    """A conversation written anew, turn by turn, as its audit says; ``turn`` takes each turn that was there, in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.next = audit, 0, USER

    def _line(self, role: str, text: str) -> tuple[str, str]:
        self.next = ASSISTANT if role.startswith("u") else USER
        return role, text

    def _insertions(self) -> list[tuple[str, str]]:
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            out.append(self._line(self.next, ""))
        return out

    def turn(self, role: str, text: str) -> list[tuple[str, str]]:
        out = self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        return out if edit == "D" else [*out, self._line(role if edit == "K" else self.next, text)]

    def finish(self) -> list[tuple[str, str]]:
        return self._insertions()


REPAIRED = "conv string, place long, role string, text string"


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, of which a conversation's first brings its audit and the others its turns, to the repaired turns.
    Turns stream by; only the audit is held."""
    key, repair, place = None, None, 0

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["conv", "place", "role", "text"])

    for batch in batches:
        rows = []
        for conv, audit, role, text, copies in zip(*[batch.column(c).to_pylist() for c in ("conv", "audit", "role", "text", "copies")], strict=True):
            if audit is not None:
                lines = repair.finish() if repair is not None else []
            else:
                lines = [line for _ in range(copies) for line in repair.turn(role, text)]
            for line in lines:
                rows.append((key, place, *line))
                place += 1
            if audit is not None:
                key, repair, place = conv, Repair(audit), 0
        yield made(rows)
    if repair is not None:
        yield made([(key, place + i, *line) for i, line in enumerate(repair.finish())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns in order to conv and the SHA-256 of their ``role:text`` lines."""
    key, sha, begun = None, None, False

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["conv", "repaired_sha256"])

    for batch in batches:
        rows = []
        for conv, place, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "place", "role", "text")], strict=True):
            if place == 0:
                if begun:
                    rows.append((key, sha.hexdigest()))
                key, sha, begun = conv, hashlib.sha256(), True
            sha.update(("\n" if place else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield made(rows)
    if begun:
        yield made([(key, sha.hexdigest())])


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("sha")]


def audits(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The cheapest repair of each conversation of ``faults()``: conv, audit, cost, illegal.

    ``turns`` is read twice, so it should be a written table. Turns are sorted over ranges, so that a long conversation is several tasks' work, and cut into blocks. Each block is
    solved for every role that may come before it and be the last one after it: a table of 4 by 4 costs, with the
    least audit of each. A conversation's tables are then composed, from its end to its start for the costs and from its
    start for the choices, which needs a few numbers for each block and no turns.
    """
    parts = shuffle_parts(turns.sparkSession)
    free = ~(F.col("blank") | F.col("repeated"))
    ranged = turns.repartitionByRange(parts, *_order()).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*_order())
    light = ranged.select("part", "conv", F.left("role", F.lit(1)).alias("initial"), free.alias("free"), "truncated", "copies")
    blocks = cut(light.mapInArrow(_blocks(block), BLOCKS), "blocks")
    order = [F.asc_nulls_first("conv"), "part", "block"]
    chosen = blocks.drop("audits").repartition("conv").sortWithinPartitions(*order).mapInArrow(_chosen, CHOSEN)
    c = chosen.alias("c")
    both = blocks.alias("b").join(c, F.col("b.conv").eqNullSafe(F.col("c.conv")) & (F.col("b.part") == F.col("c.part")) & (F.col("b.block") == F.col("c.block")))
    audit = F.concat(F.get("b.audits", F.col("c.at")), F.repeat(F.lit("I"), F.col("c.tail")))
    some = both.select("b.conv", F.struct("b.part", "b.block", audit.alias("audit")).alias("part"), "c.total", "c.illegal")
    told = some.groupBy("conv").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.first("total").alias("cost"), F.first("illegal").alias("illegal"))
    return told.select("conv", F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"), "cost", "illegal")


def repaired_turns(rows: DataFrame, told: DataFrame) -> DataFrame:
    """The repaired conversations: conv, place (from 0), role, text, from rows (conv, turn, role, text, copies) and their
    audits. Each conversation streams by in order behind its audit: texts are shuffled once, and none is held.

    The result comes with each conversation in one partition, in order.
    """
    nothing = {"turn": F.lit(None).cast("long"), "role": F.lit(""), "text": F.lit(""), "copies": F.lit(0).cast("long")}
    heads = told.select("conv", F.lit(0).alias("kind"), *[c.alias(name) for name, c in nothing.items()], "audit")
    body = rows.select("conv", F.lit(1).alias("kind"), *nothing, F.lit(None).cast("string").alias("audit"))
    both = heads.union(body).withColumn("sha", F.when(F.col("kind") == 1, F.unhex(F.sha2("text", 256))))
    return both.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "kind", F.asc_nulls_first("turn"), "role", "sha").mapInArrow(_rewritten, REPAIRED)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Damage conversations and mend them: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation's turns are taken by turn, nulls first; turns of one number by role, then by the hash of the text, so
    that repetitions stand together. Each turn's first fault counts: blank, duplicate (its role and text stood earlier),
    truncated (its last character is no full stop, question or exclamation mark). Edits keep (K), delete (D), reroll (R)
    and insert (I) turns until the roles' initials are an optional s and pairs ua, or nothing; the cheapest are taken, and
    of those the ASCII-least audit. A turn whose role has another initial, or is empty, can be rerolled or deleted only.

    One row per conv_id of turns, null too. Nulls of other columns but turn stand as one space, so a null text is blank
    and a null role has no place in the order. Repeated rows are turns of their own and duplicates of each other. One
    without turns after damage has zeros, an empty audit and the hash of nothing. An empty table gives no rows; further
    columns play no part. Texts of any length are read whole.

    Only numbers and hashes are sorted and solved; texts are shuffled once, for the digest, which needs a conversation's
    bytes in order and so streams each through one task. Everything else of a long conversation is dealt to many.
    """
    bound_batches(turns.sparkSession)
    rows = damaged(turns, conv_col, turn_col, role_col, text_col)
    found = cut(faults(rows), "faults")
    told = cut(audits(found, block), "audits")

    open_, copies = ~F.col("blank"), F.col("copies")
    spare = F.when(F.col("repeated"), copies).otherwise(copies - 1)
    one = F.when(open_ & ~F.col("repeated") & F.col("truncated"), 1).otherwise(0)
    by_turn = found.groupBy("conv", "turn").agg(
        F.sum(F.when(~open_, copies).otherwise(0)).alias("blank"), F.sum(F.when(open_, spare).otherwise(0)).alias("duplicate"), F.sum(one).alias("truncated")
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = by_turn.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])

    shas = repaired_turns(rows, told).mapInArrow(_digests, "conv string, repaired_sha256 string")
    out = turns.select(F.col(conv_col).alias("conv_id")).distinct().withColumn("_conv", F.col("conv_id").cast("string"))
    for more in (counts, told, shas):
        out = out.join(more.withColumnRenamed("conv", "_of"), F.col("_conv").eqNullSafe(F.col("_of")), "left").drop("_of")
    number = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *number, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
