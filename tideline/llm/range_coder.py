"""Token ids in block files coded with static range asymmetric numeral systems (rANS).

Documents are dealt by ranges of doc_id and sorted, so the files hold ids in ascending doc_id order. One frequency table,
counted over all ids, serves every block. A block codes about BLOCK ids on LANES interleaved 64-bit states: id i belongs
to lane i mod LANES, and the lanes advance together as numpy vectors. Every CHECKPOINT steps the states and the place in
the word stream are stored with a checksum of the ids up to the next one, so segments of a block decode independently.

The container is a Parquet folder with one row per block (part, first document of the part, doc_ids, lengths, words,
states, places, checks); a second folder holds the frequency table, a third the index of blocks and their start.

Null counts as empty; every document ends with the end id. A null doc_id sorts first; repeated rows are written each, in
the order of their texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm import byte_bpe
from tideline.llm.best_fit_packing import encode_with_end
from tideline.llm.common import Stages, column, slices, text_bytes

END = 2
SCALE = 20  #: frequencies add up to 2 ** SCALE
LANES, CHECKPOINT, BLOCK = 2048, 128, 1 << 20

LOW = np.uint64(1 << 31)
MASK = np.uint64((1 << SCALE) - 1)
WORD = np.uint64(32)

IDS_SCHEMA = "part bigint, nth bigint, doc_id bigint, n bigint, ids binary"
BLOCK_SCHEMA = ("part bigint, first bigint, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, words binary, "
                "states binary, places array<bigint>, checks array<bigint>")
DOC_SCHEMA = "part bigint, first bigint, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"


class Table:
    """Frequencies of the symbols, scaled to 2 ** SCALE; every counted symbol has at least one."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        if len(symbols) > 1 << SCALE:
            raise ValueError("more symbols than slots")
        order = np.argsort(symbols)
        self.symbols, counts = symbols[order].astype(np.int64), counts[order].astype(np.float64)
        scaled = np.maximum(1, np.floor(counts / counts.sum() * (1 << SCALE))).astype(np.int64)
        over = int(scaled.sum()) - (1 << SCALE)
        if over <= 0:
            scaled[np.argmax(scaled)] -= over
        else:  # take from the largest in turn, never below one
            for i in np.argsort(-scaled, kind="stable"):
                take = min(over, max(0, int(scaled[i]) // 2))
                scaled[i] -= take
                over -= take
        self.frequency = scaled
        self.below = np.cumsum(scaled) - scaled
        size = int(self.symbols.max()) + 1
        self.of_symbol = np.full(size, -1, np.int64)
        self.of_symbol[self.symbols] = np.arange(len(symbols))
        self.slot = np.repeat(np.arange(len(symbols), dtype=np.int32), scaled)
        self.f64, self.b64 = scaled.astype(np.uint64), self.below.astype(np.uint64)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """words (uint32), states per checkpoint, place in words per checkpoint, crc32 of the ids per checkpoint."""
        index = self.of_symbol[ids]
        frequency, below = self.f64[index], self.b64[index]
        state = np.full(LANES, LOW, np.uint64)
        steps = -(-len(ids) // LANES)
        words, states, tail, total = [], [], [], 0
        for t in range(steps - 1, -1, -1):
            f, b = frequency[t * LANES: (t + 1) * LANES], below[t * LANES: (t + 1) * LANES]
            x = state[: len(f)]
            full = x >= (f << np.uint64(63 - SCALE))
            if full.any():
                out = (x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                words.append(out)
                total += len(out)
                x[full] >>= WORD
            high = x // f
            state[: len(f)] = (high << np.uint64(SCALE)) + (x - high * f) + b
            if t % CHECKPOINT == 0:
                states.append(state.copy())
                tail.append(total)
        stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
        places = [len(stream) - n for n in tail[::-1]]
        span = CHECKPOINT * LANES
        checks = [zlib.crc32(ids[a: a + span].astype("<u4").tobytes()) for a in range(0, len(ids), span)]
        return stream, np.array(states[::-1]).reshape(-1, LANES), np.array(places, np.int64), checks

    def decode(self, words: np.ndarray, state: np.ndarray, n: int) -> np.ndarray:
        """n ids from a checkpoint: the words from its place on, and its states."""
        state, place = state.copy(), 0
        out = np.empty(n, np.int32)
        for a in range(0, n, LANES):
            x = state[: min(LANES, n - a)]
            low = x & MASK
            index = self.slot[low]
            x = self.f64[index] * (x >> np.uint64(SCALE)) + low - self.b64[index]
            short = np.flatnonzero(x < LOW)
            x[short] = (x[short] << WORD) | words[place: place + len(short)]
            place += len(short)
            state[: len(x)] = x
            out[a: a + len(x)] = index
        return self.symbols[out]

    def decode_segment(self, block: dict, k: int) -> np.ndarray:
        """The ids between checkpoint k of a block and the next; checked."""
        span = CHECKPOINT * LANES
        n = min(span, block["n_ids"] - k * span)
        places = [*block["places"], len(block["words"]) // 4]
        words = np.frombuffer(block["words"], "<u4", places[k + 1] - places[k], 4 * places[k]).astype(np.uint64)
        ids = self.decode(words, np.frombuffer(block["states"], "<u8", LANES, 8 * LANES * k), n)
        if zlib.crc32(ids.astype("<u4").tobytes()) != block["checks"][k]:
            raise ValueError(f"checksum of part {block['part']}, block {block['first']}, segment {k}")
        return ids

    def decode_block(self, block: dict) -> np.ndarray:
        parts = [self.decode_segment(block, k) for k in range(len(block["places"]))]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _tokenised(vocabulary: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, nth = TaskContext.get().partitionId(), 0
    for whole in batches:
        for batch in slices(whole, "text", byte_bpe.BATCH):
            ids, lengths = encode_with_end(vocabulary, END, batch.column("text"))
            n = len(lengths)
            offsets = np.append(0, np.cumsum(lengths)) * 4
            data = pa.BinaryArray.from_buffers(
                pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part)), pa.array(np.arange(nth, nth + n)), batch.column("doc_id"), pa.array(lengths), data],
                ["part", "nth", "doc_id", "n", "ids"])
            nth += n


def _flat_ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u4")


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in batches:
        counts = np.bincount(_flat_ids(batch))
        if len(counts) > len(total):
            total, counts = counts, total
        total[: len(counts)] += counts
    present = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(present), pa.array(total[present])], ["id", "n"])


def _blocks(table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def block(rows: pa.Table) -> pa.RecordBatch:
        ids = _flat_ids(rows)
        words, states, places, checks = table.value.encode(ids)
        return pa.RecordBatch.from_pylist([{
            "part": rows.column("part")[0].as_py(), "first": rows.column("nth")[0].as_py(), "doc_ids": rows.column("doc_id").to_pylist(),
            "lengths": rows.column("n").to_pylist(), "n_ids": len(ids), "words": words.astype("<u4").tobytes(),
            "states": states.astype("<u8").tobytes(), "places": places.tolist(), "checks": checks}],
            schema=pa.schema([("part", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                              ("n_ids", pa.int64()), ("words", pa.binary()), ("states", pa.binary()), ("places", pa.list_(pa.int64())),
                              ("checks", pa.list_(pa.int64()))]))

    size = 0
    for batch in batches:
        part, nth, n = column(batch, "part"), column(batch, "nth"), column(batch, "n")
        if held and batch.num_rows:  # rows of one block follow each other
            last = held[-1]
            if (last.column("part")[-1].as_py(), last.column("nth")[-1].as_py() + 1) != (part[0], nth[0]):
                yield block(pa.Table.from_batches(held))
                held, size = [], 0
        a = 0
        for i in range(batch.num_rows):
            if i > a and (part[i] != part[i - 1] or nth[i] != nth[i - 1] + 1) or size and size + n[i] > BLOCK:
                if i > a:
                    held.append(batch.slice(a, i - a))
                yield block(pa.Table.from_batches(held))
                held, size, a = [], 0, i
            size += int(n[i])
        if batch.num_rows > a:
            held.append(batch.slice(a))
    if held:
        yield block(pa.Table.from_batches(held))


def _read(table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            block = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            ids = table.value.decode_block(block).astype("<u4")
            lengths = np.array(block["lengths"], np.int64)
            ends = np.cumsum(lengths)
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * (e - n): 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            many = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(many, block["part"])), pa.array(np.full(many, block["first"])), pa.array(block["doc_ids"], pa.int64()),
                 pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                ["part", "first", "doc_id", "before", "n_tokens", "ids_crc32"])


def write_ids(docs: DataFrame, path: str, vocabulary: str = byte_bpe.VOCABULARY, stages: Stages | None = None) -> None:
    """Tokenise and write blocks, table and index below path, in ascending doc_id order."""
    stages = stages or Stages(docs.sparkSession, "ids")
    dealt = (docs.select(F.col("doc_id").cast("bigint"), text_bytes())
             .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    tokens = stages.cut(dealt.mapInArrow(partial(_tokenised, vocabulary), IDS_SCHEMA), compression="zstd")
    counted = tokens.df.select("ids").mapInArrow(_histogram, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counted.write.parquet(f"{path}/table")
    table = read_table(docs.sparkSession, path)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # as large as the vocabulary
    tokens.df.mapInArrow(partial(_blocks, shared), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/blocks")
    tokens.drop()
    blocks = docs.sparkSession.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").select("part", "first", "n_ids")
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # as many rows as tasks wrote
    ahead = parts.select("part", F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    blocks.withColumn("within", within).join(ahead, "part").select(
        "part", "first", (F.col("ahead") + F.col("within")).alias("block_start")).write.parquet(f"{path}/index")


def read_table(spark: SparkSession, path: str) -> Table | None:
    rows = spark.read.schema("id bigint, n bigint").parquet(f"{path}/table").collect()  # at most the vocabulary
    return Table(np.array([r["id"] for r in rows]), np.array([r["n"] for r in rows])) if rows else None


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, decoded from the files."""
    shared = spark.sparkContext.broadcast(read_table(spark, path))
    decoded = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").mapInArrow(partial(_read, shared), DOC_SCHEMA)
    index = spark.read.schema("part bigint, first bigint, block_start bigint").parquet(f"{path}/index")
    return decoded.join(index, ["part", "first"]).select(
        "doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
