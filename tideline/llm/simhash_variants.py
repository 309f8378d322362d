"""SimHash near-duplicates by deletion variants.

A 64-bit fingerprint is cut into two segments. Of two fingerprints that differ in at most two bits, one segment differs
in at most one, so the pair meets under the variant of that segment in which the differing bit is a wildcard. Each
distinct fingerprint is indexed under its 64 one-wildcard variants, an equality on the variant brings candidates
together, and the Hamming distance decides.

Copies share a fingerprint and are indexed once. A variant's group is searched breadth-first: a fingerprint that has
been reached is not compared again, so a dense group costs little more than one pass and gives one link per member, not
all pairs. Groups of more than GROUP are dealt again by the pieces of the other segment (three pieces, at most two
differing bits: one piece is equal), which keeps every link.

Null and empty texts have fingerprint zero and link like any other. Repeated rows give repeated result rows. A null
doc_id has no part in naming a component; a component of such rows alone is named null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Stages, column, run_starts, text_bytes, unwrapped, whole_groups, wrapped
from tideline.llm.components import components

WIDTH, SEED, DISTANCE = 3, 42, 2

#: Largest variant group that one step searches whole.
GROUP = 4096


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Majority bits of the XXH64 of all word shingles; ASCII letters in lower case, ASCII white space between words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(width, len(words))
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)),
        np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[a: a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks.view(np.int64))], ["doc_id", "mark"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark (the fingerprint's bits as a signed long)."""
    return docs.select(F.col("doc_id").cast("bigint"), text_bytes()).mapInArrow(_fingerprints, "doc_id bigint, mark bigint")


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = np.uint64(0xFFFFFFFF)
    for batch in batches:
        mark = column(batch, "mark").view(np.uint64)
        for at in range(64):
            segment = (mark >> np.uint64(at // 32 * 32)) & low
            key = (segment & ~np.uint64(1 << at % 32)) | np.uint64(at << 32)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(mark.view(np.int64))], ["key", "mark"])


def _search(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly what distances up to DISTANCE connect within the group."""
    rest, queue, a, b = marks[1:], [marks[0]], [], []
    while len(rest) or queue:
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        x = queue.pop()
        near = np.bitwise_count(rest ^ x) <= DISTANCE
        if near.any():
            found, rest = rest[near], rest[~near]
            a.append(np.full(len(found), x))
            b.append(found)
            queue.extend(found)
        if not len(rest):
            break
    return (np.concatenate(a), np.concatenate(b)) if a else (marks[:0], marks[:0])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["key", "piece"]):
        mark = column(table, "mark").view(np.uint64)
        at = run_starts(column(table, "key"), column(table, "piece"))
        starts, sizes = at[:-1], np.diff(at)
        two = starts[sizes == 2]
        near = np.bitwise_count(mark[two] ^ mark[two + 1]) <= DISTANCE
        a, b = [mark[two[near]]], [mark[two[near] + 1]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            x, y = _search(mark[s: s + n])
            a.append(x)
            b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["u", "v"])


def links(stages: Stages, marks: DataFrame) -> DataFrame:
    """u, v: links between the distinct fingerprints in column mark."""
    keyed = marks.mapInArrow(_variants, "key bigint, mark bigint")
    large = stages.cut(keyed.groupBy("key").count().filter(F.col("count") > GROUP).select("key"))
    if large.df.isEmpty():
        keyed = keyed.withColumn("piece", F.lit(-1).cast("bigint"))
    else:
        other = F.when(F.shiftright("key", 32) < 32, F.shiftrightunsigned("mark", 32)).otherwise(
            F.col("mark").bitwiseAND(0xFFFFFFFF))
        cut3 = F.array(*(F.shiftleft(F.lit(i).cast("bigint"), 32) + F.shiftright(other, 11 * i).bitwiseAND(0x7FF) for i in range(3)))
        keyed = keyed.join(large.df.withColumn("large", F.lit(True)), "key", "left").select(
            "key", "mark", F.explode(F.when(F.col("large"), cut3).otherwise(F.array(F.lit(-1).cast("bigint")))).alias("piece"))
    return keyed.repartition("key", "piece").sortWithinPartitions("key", "piece").mapInArrow(_verified, "u bigint, v bigint")


def simhash_components(docs: DataFrame, stages: Stages | None = None) -> DataFrame:
    """doc_id, mark, component_id (smallest doc_id of all documents that links lead to) for every row of docs."""
    stages = stages or Stages(docs.sparkSession, "simhash")
    per_doc = stages.cut(fingerprints(docs)).df
    nodes = stages.cut(per_doc.groupBy("mark").agg(F.min("doc_id").alias("least"))).df
    united = components(stages, links(stages, nodes.select("mark"))).df
    named = nodes.join(united.withColumnRenamed("u", "mark"), "mark", "left").select(
        "mark", "least", F.coalesce("v", "mark").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stages.cut(named.join(roots, "root").select("mark", "component_id")).df
    return per_doc.join(named, "mark").select("doc_id", "mark", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without the near copies: of each component the row of the smallest doc_id stays.

    Of repeated rows with that doc_id all stay; rows with a null doc_id stay only where their component has no other.
    """
    marks = simhash_components(docs)
    kept = marks.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    rows = wrapped(docs)
    return unwrapped(rows.join(kept, rows.doc_id.eqNullSafe(kept.kept_id), "left_semi"), docs.columns)
