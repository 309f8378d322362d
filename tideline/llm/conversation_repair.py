"""Repair of conversation structure at least cost, by Hirschberg's divide and conquer over four grammar states.

Role initials must read `(s?(ua)+)?`. The states are 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end. Each
row is kept (0), given the role that the state asks for (3) or deleted (4, and it must be where the row is blank or repeats
an earlier one); rows without text may be inserted anywhere (3). Rows that stay cut short cost 3 more.

The cost of a stretch of rows is a 4 x 4 table: from each state before to each state after. A stretch is divided in the
middle, its forward vector (from the state before to each state in the middle) and its backward vector (from there to the
state after) are added, and the least sum is the crossing. Of equal sums the crossing whose edits come first in ASCII
order is taken: insertions belong to the row they stand before, so the edits of a stretch end with that of its last row,
none is the beginning of another, and the order of the edits to the left alone decides. That order is kept with the costs
as the rank of each state after, for each state before. Tables are made from the rows upwards, all conversations of a batch
at once, the crossings are read downwards: space is linear in the rows.

Tables can be joined in any grouping, so a conversation of any length is divided among tasks: rows are dealt by ranges of
(conversation, turn), conversations within one range are repaired where they lie, and those over a range edge or above
PIECE rows are handled in pieces. Only one number per piece and state meets in one place, and the hash of the repaired
text streams over the pieces in order.

Null roles and texts count as one space, null conversations and turns too where they are hashed; all rows without a
conversation are one conversation. Rows of equal turn go by role, then by the SHA-256 of the text; repeated rows are
duplicates of the first. An empty table gives no rows. Columns but conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Stages, column, run_starts

#: Costs of the edits and what a row that is cut short adds.
KEEP, REROLE, DELETE, INSERT, SHORT = 0, 3, 4, 3, 3
NEVER = 1 << 40
#: Rows, and bytes of text, of a conversation that are held at a time.
PIECE, PIECE_BYTES = 20_000, 1 << 23

BLANK_CHARS = "\t\n\x0b\x0c\r "
OTHER, SYSTEM, USER, ASSISTANT = range(4)
#: Bits of a row's code: its initial, then its first fault; ghosts are rows that the damage took away.
BLANK, DUPLICATE, TRUNCATED, GHOST = 4, 8, 16, 32

_ASKED = {0: "user", 1: "user", 2: "assistant", 3: "user"}
_AFTER = {0: 2, 1: 2, 2: 3, 3: 2}
_KEPT = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (2, ASSISTANT): 3, (3, USER): 2}


def _leaves() -> tuple[np.ndarray, np.ndarray, list]:
    """For each code: costs, ranks and edits (initials) from each state before a row to each state after it."""
    cost, rank = np.full((32, 4, 4), NEVER, np.int64), np.zeros((32, 4, 4), np.int64)
    edits = [[[""] * 4 for _ in range(4)] for _ in range(32)]
    for code, before in product(range(32), range(4)):
        initial, gone, short = code & 3, bool(code & (BLANK | DUPLICATE)), SHORT if code & TRUNCATED else 0
        best: dict[int, tuple[int, str]] = {}
        state = before
        for inserted in range(4):
            ways = [(DELETE, "D", state)]
            if not gone:
                ways.append((REROLE + short, "R", _AFTER[state]))
                if (state, initial) in _KEPT:
                    ways.append((KEEP + short, "K", _KEPT[state, initial]))
            for c, name, after in ways:
                way = (c + INSERT * inserted, "I" * inserted + name)
                best[after] = min(best.get(after, (NEVER, "")), way)
            state = _AFTER[state]
        for after, (c, name) in best.items():
            cost[code, before, after], edits[code][before][after] = c, name
        order = sorted(range(4), key=lambda q, b=best: b.get(q, (0, "~"))[1] or "~")
        for place, q in enumerate(order):
            rank[code, before, q] = place
    return cost, rank, edits


LEAF_COST, LEAF_RANK, LEAF_EDITS = _leaves()
#: Insertions after the last row, by the state after it.
CLOSING = np.array([0, 2, 1, 0])


def joined(lc: np.ndarray, lr: np.ndarray, rc: np.ndarray, rr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs, ranks and crossings of stretches from those of their two halves, many at once."""
    total = lc[:, :, :, None] + rc[:, None, :, :]  # [stretch, before, crossing, after]
    cross = np.argmin(total * 4 + lr[:, :, :, None], axis=2)
    cost = np.minimum(np.take_along_axis(total, cross[:, :, None, :], axis=2)[:, :, 0, :], NEVER)
    n = np.arange(len(lc))[:, None, None]
    before, after = np.arange(4)[None, :, None], np.arange(4)[None, None, :]
    key = lr[n, before, cross] * 4 + rr[n, cross, after]
    key = np.where(cost >= NEVER, 16 + after, key)
    rank = np.argsort(np.argsort(key, axis=2), axis=2)
    return cost, rank, cross.astype(np.int8)


class Tree:
    """Stretches of every conversation, halved down to single rows. starts: first row of each, and the number of rows."""

    def __init__(self, cost: np.ndarray, rank: np.ndarray, starts: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # pairs' left nodes, crossings, lone nodes
        while len(cost) > len(starts) - 1:
            size = np.diff(starts)
            of = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(cost)) - starts[:-1][of]
            left = np.flatnonzero((place % 2 == 0) & (place + 1 < size[of]))
            lone = np.flatnonzero((place % 2 == 0) & (place + 1 == size[of]))
            c, r, cross = joined(cost[left], rank[left], cost[left + 1], rank[left + 1])
            at = np.empty(len(left) + len(lone), np.int64)  # nodes of the next level in order of their rows
            order = np.argsort(np.concatenate([left, lone]), kind="stable")
            at[order] = np.arange(len(at))
            cost, rank = np.concatenate([c, cost[lone]])[order], np.concatenate([r, rank[lone]])[order]
            self.levels.append((left, lone, cross, at))
            starts = np.append(0, np.cumsum(-(-size // 2)))
        self.cost, self.rank = cost, rank

    def states(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states before and after each row, given those before and after each conversation."""
        for left, lone, cross, at in reversed(self.levels):
            b, a = before[at], after[at]
            k = len(left)
            middle = cross[np.arange(k), b[:k], a[:k]]
            n = 2 * k + len(lone)
            before, after = np.empty(n, np.int64), np.empty(n, np.int64)
            before[left], after[left] = b[:k], middle
            before[left + 1], after[left + 1] = middle, a[:k]
            before[lone], after[lone] = b[k:], a[k:]
        return before, after


def ends(cost: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest last state of each whole conversation, and the cost of all edits."""
    total = cost[:, 0, :] + CLOSING * INSERT
    last = np.argmin(total * 4 + rank[:, 0, :], axis=1)
    return last, total[np.arange(len(last)), last]


def repaired(code: int, before: int, after: int, role: str, text: str) -> tuple[str, list[str]]:
    """The edits of a row and the lines that it leaves."""
    edits, lines, state = LEAF_EDITS[code & 31][before][after], [], before
    for e in edits[:-1]:
        lines.append(f"{_ASKED[state]}:")
        state = _AFTER[state]
    if edits[-1] == "K":
        lines.append(f"{role}:{text}")
    elif edits[-1] == "R":
        lines.append(f"{_ASKED[state]}:{text}")
    return edits, lines


def closing(state: int) -> list[str]:
    lines = []
    for _ in range(CLOSING[state]):
        lines.append(f"{_ASKED[state]}:")
        state = _AFTER[state]
    return lines


def tallies(codes: np.ndarray, turns: np.ndarray, known: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Per stretch: faults, illegal neighbours, and first, last and number of distinct turns. turns ascend within a stretch."""
    n = len(starts) - 1
    of = np.repeat(np.arange(n), np.diff(starts))
    add = lambda mask: np.bincount(of[mask], minlength=n)
    inside = np.ones(len(codes), bool)
    inside[starts[:-1]] = False
    pair = (np.append(0, codes[:-1]) & 3) * 4 + (codes & 3)
    legal = np.isin(pair, [SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER])
    fresh = known & ~(inside & np.append(False, known[:-1]) & (turns == np.append(0, turns[:-1])))
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.flatnonzero(known)
    last[of[at]] = turns[at]
    first[of[at[::-1]]] = turns[at[::-1]]
    return {"blank": add(codes & BLANK > 0), "duplicate": add(codes & DUPLICATE > 0), "truncated": add(codes & TRUNCATED > 0),
            "illegal": add(inside & ~legal), "first": first, "last": last, "distinct": add(fresh), "rows": np.diff(starts)}


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
OUT_SCHEMA = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
              "audit string, repaired_sha256 string, piece bigint, place bigint, code int, turn bigint, role string, text string")
_OUT = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[t])
                  for n, t in (f.split() for f in OUT_SCHEMA.split(", "))])
EMPTY = hashlib.sha256(b"").hexdigest()


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _OUT], schema=_OUT)


def _whole(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Repairs conversations that are all there; starts: their first rows."""
    codes = column(table, "code").astype(np.int64)
    lies = np.append(0, np.cumsum(codes & GHOST == 0))  # real rows before each row
    ids = table.column("conv_id").take(pa.array(starts[:-1]))
    real = np.flatnonzero(codes & GHOST == 0)
    bounds = lies[starts]
    some = np.flatnonzero(np.diff(bounds))
    rows = table.take(pa.array(real))
    n = len(starts) - 1
    out = {k: np.zeros(n, np.int64) for k in RESULT[1:7]}
    audit, digest = [""] * n, [EMPTY] * n
    if len(some):
        codes = codes[real]
        inner = np.append(bounds[some], bounds[-1])
        turns = rows.column("turn")
        known = ~np.asarray(turns.is_null())
        turns = np.asarray(turns.fill_null(0))
        tree = Tree(LEAF_COST[codes & 31], LEAF_RANK[codes & 31], inner)
        last, cost = ends(tree.cost, tree.rank)
        before, after = tree.states(np.zeros(len(some), np.int64), last)
        sums = tallies(codes, turns, known, inner)
        for k in ("blank", "duplicate", "truncated", "illegal"):
            out[k][some] = sums[k]
        out["gaps"][some] = np.where(sums["distinct"] > 0, sums["last"] - sums["first"] + 1 - sums["distinct"], 0)
        out["cost"][some] = cost
        roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
        steps = [*map(repaired, codes.tolist(), before.tolist(), after.tolist(), roles, texts)]
        for i, a, b, q in zip(some.tolist(), inner[:-1].tolist(), inner[1:].tolist(), last.tolist(), strict=True):
            end = closing(q)
            audit[i] = "".join(s[0] for s in steps[a:b]) + "I" * len(end)
            digest[i] = hashlib.sha256("\n".join([x for s in steps[a:b] for x in s[1]] + end).encode()).hexdigest()
    return _batch(conv_id=ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, **out, audit=audit, repaired_sha256=digest)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition: conversations that lie in it whole come out repaired, the first, the last and those of more than
    PIECE rows (or PIECE_BYTES) as rows with the number of their piece and their place in it."""
    from pyspark import TaskContext

    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    held: list[pa.RecordBatch] = []
    opened = True  # the conversation in hand may have begun before this partition, or has begun to leave in pieces

    def pieces(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal number
        for a in range(0, table.num_rows, PIECE):
            part = table.slice(a, PIECE)
            keep = {k: part.column(k).combine_chunks() for k in ("conv_id", "code", "turn", "role", "text")}
            yield _batch(piece=np.full(part.num_rows, number), place=np.arange(part.num_rows), **keep)
            number += 1

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        starts = run_starts(column(table, "nul"), column(table, "no"))
        held, first = [], 0
        if len(starts) > 2:
            if opened:
                yield from pieces(table.slice(0, starts[1]))
                first, opened = 1, False
            if first < len(starts) - 2:
                upto = starts[first: -1]
                yield _whole(table.slice(upto[0], upto[-1] - upto[0]).combine_chunks(), upto - upto[0])
        rest = table.slice(starts[-2])
        if rest.num_rows > PIECE or rest.column("text").nbytes > PIECE_BYTES:
            yield from pieces(rest)
            opened, held = True, []  # what follows of the same conversation goes in pieces too
        else:
            held = rest.combine_chunks().to_batches()
    if held:
        yield from pieces(pa.Table.from_batches(held))


PIECE_SCHEMA = ("conv_id bigint, piece bigint, n bigint, cost array<bigint>, rank array<bigint>, blank bigint, duplicate bigint, "
                "truncated bigint, illegal bigint, first bigint, last bigint, distinct bigint, head int, tail int")


def _summary(table: pa.Table) -> pa.Table:
    """One piece as costs, ranks and tallies."""
    table = table.sort_by("place")
    codes = column(table, "code").astype(np.int64)
    real = np.flatnonzero(codes & GHOST == 0)
    ids, piece = table.column("conv_id").slice(0, 1).combine_chunks(), table.column("piece").slice(0, 1).combine_chunks()
    names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")]
    if not len(real):
        zero = pa.array([0], pa.int64())
        none = pa.array([[]], pa.list_(pa.int64()))
        return pa.Table.from_arrays([ids, piece, zero, none, none, *[zero] * 7, pa.array([0], pa.int32()), pa.array([0], pa.int32())], names)
    codes, turns = codes[real], table.column("turn").take(pa.array(real))
    known = ~np.asarray(turns.is_null())
    starts = np.array([0, len(real)])
    tree = Tree(LEAF_COST[codes & 31], LEAF_RANK[codes & 31], starts)
    t = tallies(codes, np.asarray(turns.fill_null(0)), known, starts)
    numbers = [pa.array(t[k], pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal", "first", "last", "distinct")]
    return pa.Table.from_arrays(
        [ids, piece, pa.array([len(real)], pa.int64()), pa.array([tree.cost.ravel().tolist()], pa.list_(pa.int64())),
         pa.array([tree.rank.ravel().tolist()], pa.list_(pa.int64())), *numbers,
         pa.array([codes[0] & 3], pa.int32()), pa.array([codes[-1] & 3], pa.int32())], names)


PLAN_SCHEMA = ("conv_id bigint, piece bigint, before int, after int, closing int, gaps bigint, blank bigint, duplicate bigint, "
               "truncated bigint, illegal bigint, cost bigint")


def _planned(table: pa.Table) -> pa.Table:
    """The states before and after each piece of one conversation, and on its last piece what holds for all of it."""
    rows = table.sort_by("piece").to_pylist()
    full = [r for r in rows if r["n"]]
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "gaps", "cost"), 0)
    states, last = [], 0
    if full:
        tree = Tree(*(np.array([r[k] for r in full], np.int64).reshape(-1, 4, 4) for k in ("cost", "rank")), np.array([0, len(full)]))
        last, cost = (int(x[0]) for x in ends(tree.cost, tree.rank))
        states = list(zip(*(x.tolist() for x in tree.states(np.zeros(1, np.int64), np.array([last]))), strict=True))
        for k in ("blank", "duplicate", "truncated", "illegal"):
            total[k] = sum(r[k] for r in full)
        total["illegal"] += sum((a["tail"], b["head"]) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)) for a, b in zip(full, full[1:]))
        timed = [r for r in full if r["distinct"]]
        if timed:
            distinct = sum(r["distinct"] for r in timed) - sum(a["last"] == b["first"] for a, b in zip(timed, timed[1:]))
            total["gaps"] = timed[-1]["last"] - timed[0]["first"] + 1 - distinct
        total["cost"] = cost
    at, out = iter(states), []
    for i, r in enumerate(rows):
        before, after = next(at) if r["n"] else (0, 0)
        end = {"closing": int(last), **total} if i == len(rows) - 1 else {"closing": None, **dict.fromkeys(total)}
        out.append({"conv_id": r["conv_id"], "piece": r["piece"], "before": before, "after": after, **end})
    names = [f.split()[0] for f in PLAN_SCHEMA.split(", ")]
    kinds = [pa.int32() if f.split()[1] == "int" else pa.int64() for f in PLAN_SCHEMA.split(", ")]
    return pa.Table.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds, strict=True)], names)


EDIT_SCHEMA = "piece bigint, place bigint, before int, after int"


def _edits(table: pa.Table) -> pa.Table:
    """The states before and after each row of one piece."""
    table = table.sort_by("place")
    codes, places = column(table, "code").astype(np.int64), column(table, "place")
    real = np.flatnonzero(codes & GHOST == 0)
    before, after = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    if len(real):
        tree = Tree(LEAF_COST[codes[real] & 31], LEAF_RANK[codes[real] & 31], np.array([0, len(real)]))
        b, a = (np.array([table.column(k)[0].as_py()]) for k in ("before", "after"))
        before[real], after[real] = tree.states(b, a)
    return pa.Table.from_arrays(
        [table.column("piece").combine_chunks(), pa.array(places), pa.array(before, pa.int32()), pa.array(after, pa.int32())], ["piece", "place", "before", "after"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation, piece and place; the last row of a conversation carries `closing` and the totals."""
    digest, audit, begun = hashlib.sha256(), [], False
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            edits, lines = ("", []) if r["code"] & GHOST else repaired(r["code"], r["before"], r["after"], r["role"], r["text"])
            end = closing(r["closing"]) if r["final"] else []
            audit.append(edits + "I" * len(end))
            if lines := lines + end:
                digest.update(("\n" * begun + "\n".join(lines)).encode())
                begun = True
            if r["final"]:
                done.append({k: r[k] for k in RESULT[:7]} | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()})
                digest, audit, begun = hashlib.sha256(), [], False
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], _OUT.field(k).type) for k in RESULT], RESULT)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage, ghosts for those that it takes away: conv_id, turn, role, text, code (initial and the faults
    that a row shows by itself), digest of the text, and a number of each row."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), draw.alias("draw"),
        F.when(draw == 4, F.lit("user")).otherwise(text_of("role")).alias("role"),
        F.when(draw <= 1, F.lit("")).when(draw == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text")).alias("text"))
    rows = rows.withColumn("again", F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    shown = F.rtrim("text", F.lit(BLANK_CHARS))
    end = F.substring(shown, -1, 1)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(shown == "", BLANK).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    code = F.when(F.col("draw") == 0, GHOST).otherwise(initial + fault)
    return rows.select("conv_id", "turn", "role", "text", code.cast("int").alias("code"), F.unhex(F.sha2("text", 256)).alias("digest"),
                       F.monotonically_increasing_id().alias("uid"))


def with_duplicates(rows: DataFrame) -> DataFrame:
    """Marks rows whose role and text a conversation has had before, unless they are blank."""
    firsts = rows.filter(F.col("code").bitwiseAND(BLANK | GHOST) == 0).groupBy("conv_id", "role", "digest").agg(
        F.count("*").alias("n"), F.min(F.struct("turn", "uid")).alias("f")).filter("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("f.uid").alias("first_uid"))
    j = rows.join(firsts, rows.conv_id.eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    again = (F.col("code").bitwiseAND(BLANK | GHOST) == 0) & (F.col("first_uid") != F.col("uid"))
    marked = F.col("code").bitwiseAND(3).bitwiseOR(F.lit(DUPLICATE))
    return j.withColumn("code", F.coalesce(F.when(again, marked), F.col("code"))).select(*rows.columns)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    stages = Stages(conversations.sparkSession, "conversations")
    rows = stages.cut(damaged(conversations), "zstd")  # uid must be the same for both readers
    order = ["nul", "no", "has_turn", "turn", "role", "digest", "uid"]
    keyed = with_duplicates(rows.df).withColumns({
        "nul": F.col("conv_id").isNotNull(), "no": F.coalesce("conv_id", F.lit(0)), "has_turn": F.col("turn").isNotNull()})
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("nul", "no", "conv_id", "code", "turn", "role", "text")
    out = stages.cut(dealt.mapInArrow(_streamed, OUT_SCHEMA), "zstd")
    stages.only(out)
    whole = out.df.filter("piece is null").select(*RESULT)
    parts = out.df.filter("piece is not null").select("conv_id", "piece", "place", "code", "turn", "role", "text")
    pieces = stages.cut(parts.drop("role", "text").groupBy("conv_id", "piece").applyInArrow(_summary, PIECE_SCHEMA))
    plan = stages.cut(pieces.df.groupBy("conv_id").applyInArrow(_planned, PLAN_SCHEMA))
    ways = parts.select("piece", "place", "code").join(plan.df.select("piece", "before", "after"), "piece").groupBy("piece").applyInArrow(_edits, EDIT_SCHEMA)
    sizes = parts.groupBy("piece").agg(F.max("place").alias("place"))
    ends_ = plan.df.filter("closing is not null").join(sizes, "piece").select(
        "piece", "place", "closing", *RESULT[1:7], F.lit(True).alias("final"))
    line = parts.join(ways, ["piece", "place"]).join(ends_, ["piece", "place"], "left").withColumn("final", F.coalesce("final", F.lit(False)))
    streamed = line.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "place").mapInArrow(
        _hashed, ", ".join(OUT_SCHEMA.split(", ")[: len(RESULT)]))
    return whole.unionByName(streamed)
