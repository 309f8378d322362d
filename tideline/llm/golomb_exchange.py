"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every task hashes its documents, sorts the fingerprints and sends each owner (a range of the fingerprint space) one
   message: its distinct fingerprints as Golomb-Rice coded differences.
2. An owner merges its messages and answers each with a bitmap: which fingerprints another message has as well.
3. Documents whose fingerprint is marked, or occurs twice in their own task, are suspects. Only their texts are grouped,
   byte by byte; a false suspect ends up alone in its group.

A group of copies costs one code per message however many copies it has, and texts are pre-aggregated before they are
shuffled. Owners are as many as keep OWNED fingerprints in each, so neither grows with the data.

Texts are equal when equal after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest doc_id
stays; repeated rows with that doc_id all stay. A null doc_id is smaller than any other.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Stages, column, run_starts, text_bytes

#: Fingerprints an owner holds on average, and documents a task sends at once.
OWNED, SENT = 1_000_000, 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MESSAGE_SCHEMA = "part bigint, owner bigint, codes binary, doc_ids array<bigint>, digests binary"


def golomb_encode(values: np.ndarray, base: int) -> bytes:
    """Strictly ascending unsigned values, none below base: differences with the power of two nearest to ln 2 x mean."""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(base))
    bits = max(0, int(np.floor(np.log2(max(1.0, 0.6931 * gaps.mean()))))) if len(gaps) else 0
    high = gaps >> bits
    unary = np.zeros(int(high.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
    packed = np.packbits(unary).tobytes()
    return struct.pack("<IBI", len(gaps), bits, len(packed)) + packed + np.packbits(low).tobytes()


def golomb_decode(data: bytes, base: int) -> np.ndarray:
    n, bits, size = struct.unpack_from("<IBI", data)
    unary = np.unpackbits(np.frombuffer(data, np.uint8, size, 9))
    high = np.diff(np.flatnonzero(unary)[:n], prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(data, np.uint8, -1, 9 + size), count=n * bits).reshape(n, bits).astype(np.int64)
    return np.cumsum((high << bits) + (low << np.arange(bits)).sum(axis=1)) + base


def _leading(digests: np.ndarray, width: int) -> np.ndarray:
    """The first width bits of each digest."""
    return (np.ascontiguousarray(digests[:, :8]).view(">u8")[:, 0] >> np.uint64(64 - width)).astype(np.int64)


def _first(owner: int, owners: int, width: int) -> int:
    """Smallest fingerprint of an owner."""
    return -(-(owner << width) // owners)


def _messages(owners: int, width: int):
    def send(part: int, ids: list, digests: bytearray) -> pa.RecordBatch:
        rows = np.frombuffer(bytes(digests), np.uint8).reshape(-1, 32)
        prints = _leading(rows, width)
        order = np.argsort(prints, kind="stable")
        rows, prints = rows[order], prints[order]
        ids = pa.array(ids, pa.int64()).take(pa.array(order))
        owner = (prints * owners) >> width
        at = run_starts(owner)
        codes = [golomb_encode(np.unique(prints[a:b]), _first(int(owner[a]), owners, width)) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(codes), part)), pa.array(owner[at[:-1]]), pa.array(codes, pa.binary()),
            pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids),
            pa.array([rows[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
        ], ["part", "owner", "codes", "doc_ids", "digests"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        ids, digests = [], bytearray()
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            for x in batch.column("text"):
                digests += hashlib.sha256(x.as_py().lower()).digest()
            if len(ids) >= SENT:
                yield send(part, ids, digests)
                part, ids, digests = part + 1, [], bytearray()
        if ids:
            yield send(part, ids, digests)

    return run


def _answers(owners: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        owner = table.column("owner")[0].as_py()
        base = _first(owner, owners, width)
        sent = [golomb_decode(x.as_py(), base) for x in table.column("codes")]
        prints = np.concatenate(sent)
        order = np.argsort(prints, kind="stable")
        same = prints[order][1:] == prints[order][:-1]
        marked = np.zeros(len(prints), bool)
        marked[order[1:][same]] = True
        marked[order[:-1][same]] = True
        ends = np.cumsum([len(x) for x in sent])
        maps = [np.packbits(marked[e - len(x): e]).tobytes() for e, x in zip(ends, sent, strict=True)]
        return pa.table({"part": table.column("part"), "owner": table.column("owner"), "marks": pa.array(maps, pa.binary())})

    return run


def _judged(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, digests, marks in zip(*(batch.column(c) for c in ("doc_ids", "digests", "marks")), strict=True):
                rows = np.frombuffer(digests.as_py(), np.uint8).reshape(-1, 32)
                at = run_starts(_leading(rows, width))
                sizes = np.diff(at)
                marked = np.unpackbits(np.frombuffer(marks.as_py(), np.uint8), count=len(sizes)).astype(bool) | (sizes > 1)
                digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(rows), [None, pa.py_buffer(digests.as_py())])
                yield pa.RecordBatch.from_arrays(
                    [ids.values, digest.cast(pa.binary()), pa.array(np.repeat(marked, sizes))], ["doc_id", "digest", "suspect"])

    return run


def exact_duplicates(docs: DataFrame, stages: Stages | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text) for every row of docs."""
    stages = stages or Stages(docs.sparkSession, "exact")
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    total = docs.count()
    owners = max(1, -(-total // OWNED))
    width = min(46, max(16, total.bit_length() + 14))
    sent = stages.cut(docs.select("doc_id", text_bytes()).mapInArrow(_messages(owners, width), MESSAGE_SCHEMA)).df
    answers = sent.select("part", "owner", "codes").groupBy("owner").applyInArrow(
        _answers(owners, width), "part bigint, owner bigint, marks binary")
    judged = stages.cut(
        sent.select("part", "owner", "doc_ids", "digests").join(answers, ["part", "owner"])
        .mapInArrow(_judged(width), "doc_id bigint, digest binary, suspect boolean")
        .select("doc_id", F.lower(F.hex("digest")).alias("text_sha256"), "suspect")).df

    suspects = judged.filter("suspect").select("doc_id", "text_sha256")
    asked = suspects.select(F.col("doc_id").alias("asked")).distinct()
    texts = docs.join(asked, docs.doc_id.eqNullSafe(asked.asked), "left_semi").select(
        "doc_id", F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("text"))
    groups = (texts.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
              .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    same = suspects.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    alone = judged.filter("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(same)
