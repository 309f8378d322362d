"""What the document operators share: the input table, stage tables in shared storage, and Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import shared_dir

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB from now on: 10,000 whole texts at once fill the buffers of executors and their Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


class Stages:
    """Named intermediate tables below the shared folder.

    A cut ends the lineage: later work restarts from files that survive lost executors. The shuffle files of the
    write are given up with it. drop() removes a table that nothing reads any more; what the result reads stays.
    """

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tideline-{operator}-{uuid.uuid4().hex}"
        self._n = 0
        self.made: list[Stage] = []

    def cut(self, df: DataFrame, compression: str = "snappy") -> Stage:
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.option("compression", compression).parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        self.made.append(Stage(self.spark, path, self.spark.read.schema(df.schema).parquet(path)))
        return self.made[-1]

    def only(self, *kept: Stage) -> None:
        """Drops every table but these."""
        for stage in self.made:
            if not any(stage is k for k in kept):
                stage.drop()
        self.made = list(kept)


class Stage:
    """One written table: read it by .df, remove it by drop()."""

    def __init__(self, spark: SparkSession, path: str, df: DataFrame):
        self.spark, self.path, self.df = spark, path, df

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias(column)


def column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `most` bytes of the column each; one row is never divided."""
    lengths = batch.column(column)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(lengths), 0))
    part = np.cumsum(sizes, dtype=np.int64) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # workers are used again by other stages


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of a key-sorted partition in which every group of equal keys is whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        same = np.ones(batch.num_rows, dtype=bool)
        for k, v in zip(keys, last, strict=True):
            same &= column(batch, k) == v
        differ = np.flatnonzero(~same)
        start = int(differ[-1]) + 1 if len(differ) else 0
        if start == 0 and held:
            first = [held[0].column(k)[0].as_py() for k in keys]
            if first == last:
                held.append(batch)
                continue
        if start or held:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Start positions of runs of equal keys, with the length appended."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of start, start+1, ... of each length."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    shift = np.asarray(starts, dtype=np.int64) - (np.cumsum(lengths) - lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(shift, lengths)


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text, and everything but the text as struct `row`, so that no column of the caller meets one of ours."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"), F.struct(*others).alias("row"))


def unwrapped(df: DataFrame, columns: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The caller's columns again, with the text of df, and those in `changed` replaced where the caller has them."""
    changed = {"text": F.col("text")} | (changed or {})
    return df.select(*(changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in columns))
