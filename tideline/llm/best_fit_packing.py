"""Packing token pieces into sequences: Martello-Toth dominance reduction, then best fit of the rest.

Pieces of equal length are alike, so the instance is a histogram of at most `capacity` lengths, whatever the number of
documents; the plan is made on it and names, for each length, which ranks go to which run of sequences and at which
offset. Ranks are given where the pieces are cut (task and running number, plus offsets per task), so no length, however
common, meets in one task.

Reduction, from the longest length down. A set of pieces may be fixed for good when it holds at least as much as any set
the longest piece could be with, piece by piece:
- nothing else fits: alone;
- a partner fills the sequence exactly, or only one more piece fits: with the longest partner that fits;
- at most two more fit, and the longest partner is no shorter than any two that fit together: with that partner.

Documents longer than the capacity are cut into full pieces, with the shorter one first. Null counts as empty; every
document has the end id, so every row gives a piece. Repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import byte_bpe
from tideline.llm.common import Stages, column, ranges, slices, text_bytes

CAPACITY, END = 1024, 2

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint"
PACKED_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def encode_with_end(vocabulary: str, end: int, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and number of ids per text, each text followed by the end id."""
    flat, lengths = byte_bpe.load(vocabulary).encode(texts)
    ends = np.cumsum(lengths + 1)
    ids = np.full(int(ends[-1]) if len(ends) else 0, end, np.uint32)
    inside = np.ones(len(ids), bool)
    inside[ends - 1] = False
    ids[inside] = flat
    return ids, lengths + 1


def _pieces(vocabulary: str, capacity: int, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
    for whole in batches:
        for batch in slices(whole, "text", byte_bpe.BATCH):
            ids, lengths = encode_with_end(vocabulary, END, batch.column("text"))
            count = -(-lengths // capacity)
            row = np.repeat(np.arange(len(lengths)), count)
            piece = ranges(np.zeros(len(count)), count)
            first = lengths - (count - 1) * capacity
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            begin = (np.cumsum(lengths) - lengths)[row] + start
            data = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a: 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            counts = np.bincount(length, minlength=capacity + 1)
            nth = np.empty(len(length), np.int64)
            nth[order] = ranges(seen, counts)
            seen += counts
            out = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                   pa.array(crc, pa.int64()), pa.array(np.full(len(row), part)), pa.array(nth)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)


def cut_documents(docs: DataFrame, vocabulary: str = byte_bpe.VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its task; ids: the token ids themselves."""
    schema = PIECE_SCHEMA + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint"), text_bytes()).mapInArrow(partial(_pieces, vocabulary, capacity, with_ids), schema)


def _longest(counts: np.ndarray, most: int) -> int:
    """The longest length present up to `most`, 0 if none."""
    present = np.flatnonzero(counts[1: most + 1]) if most > 0 else np.empty(0, int)
    return int(present[-1]) + 1 if len(present) else 0


def _smallest(counts: np.ndarray, n: int) -> list[int]:
    """The n shortest pieces present (with repeats), or fewer."""
    out: list[int] = []
    for length in np.flatnonzero(counts[1:]) + 1:
        out += [int(length)] * int(min(counts[length], n - len(out)))
        if len(out) == n:
            break
    return out


def _longest_pair(counts: np.ndarray, most: int) -> int:
    """The largest sum up to `most` of two pieces present."""
    present = np.flatnonzero(counts[1:]) + 1
    best = 0
    for a in present[present < most]:
        other = present[(present <= most - a) & ((present != a) | (counts[present] > 1))]
        if len(other):
            best = max(best, int(a + other[-1]))
    return best


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets; counts (by length) is shrunk in place. Returns (lengths, number of sequences)."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        for size in range(capacity, 0, -1):
            while counts[size]:
                counts[size] -= 1  # the piece itself; what is left could go with it
                room = capacity - size
                partner = _longest(counts, room)
                small = _smallest(counts, 3)
                alone = partner == 0
                pair = partner == room or len(small) < 2 or small[0] + small[1] > room
                two = not (alone or pair) and (len(small) < 3 or sum(small) > room) and partner >= _longest_pair(counts, room)
                counts[size] += 1
                if alone:
                    group, times = (size,), int(counts[size])
                elif pair or two:  # taking pieces away only narrows what else could go with this length
                    group, times = (size, partner), int(min(counts[size], counts[partner]) if partner != size else counts[size] // 2)
                else:
                    break
                for length in group:
                    counts[length] -= times
                fixed.append((group, times))
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of the lengths in falling order, run by run: sequences with the same content are one entry."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(content: tuple[int, ...], room: int, times: int) -> None:
        if times:
            by_room.setdefault(room, []).append((content, times))

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            room = min((r for r in by_room if r >= size), default=None)
            if room is None:
                content, room, times = (), capacity, left
            else:
                content, times = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
            each = min(room // size, left)
            full = min(times, left // each)
            left -= full * each
            put(content + (size,) * each, room - each * size, full)
            if content:
                rest = times - full
                if rest and left:  # less than one more fill is left
                    put(content + (size,) * left, room - left * size, 1)
                    rest, left = rest - 1, 0
                put(content, room, rest)
    return [entry for entries in by_room.values() for entry in entries]


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: rank r of the length, from that row's first rank on,
    goes to sequence first sequence + r - first rank."""
    counts = counts.copy()
    entries = reduce_dominated(counts, capacity) + best_fit(counts, capacity)
    used, sequence, rows = np.zeros(capacity + 1, np.int64), 0, []
    for content, times in entries:
        offset = 0
        for size in content:
            rows.append((size, used[size], sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _placed(rows: np.ndarray, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = (rows[:, 0] << 44) + rows[:, 1]
    for batch in batches:
        rank = column(batch, "nth") + column(batch, "before")
        i = np.searchsorted(key, (column(batch, "length") << 44) + rank, side="right") - 1
        out = {"sequence_id": pa.array(rows[i, 2] + rank - rows[i, 1]), "offset": pa.array(rows[i, 3])}
        yield pa.RecordBatch.from_arrays([out[n] if n in out else batch.column(n) for n in names], names)


def pack(stages: Stages, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for written pieces (columns length, part, nth; others are kept)."""
    spark = pieces.sparkSession
    tallies = stages.cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n"))).df
    counts = np.zeros(capacity + 1, np.int64)
    for row in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = pieces.join(tallies.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")), ["part", "length"])
    names = [n for n in pieces.columns if n not in ("part", "nth")] + ["sequence_id", "offset"]
    types = dict(pieces.dtypes) | {"sequence_id": "bigint", "offset": "bigint"}
    rows = spark.sparkContext.broadcast(plan(counts, capacity))  # bounded by the capacity, not by the data
    return ranked.mapInArrow(lambda batches: _placed(rows.value, names, batches), ", ".join(f"{n} {types[n]}" for n in names))


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = byte_bpe.VOCABULARY,
                     with_ids: bool = False, stages: Stages | None = None) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (, ids)."""
    stages = stages or Stages(docs.sparkSession, "packing")
    return pack(stages, stages.cut(cut_documents(docs, vocabulary, capacity, with_ids)).df, capacity)
