"""Distributed union-find: components of a link table, smallest node as the name.

Each task first unites its own slice of the links (min labels with pointer jumping in numpy), which leaves at most one
link per node and slice. Alternating large-star and small-star rounds then unite across tasks until the links are
stars. Every round is written to the shared folder; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Stage, Stages, column

LINK_SCHEMA = "u bigint, v bigint"

#: Links a task unites at once; bounds its memory.
SLICE = 1_000_000


def unite(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes of the links that are not that smallest one."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inverse[: len(a)], inverse[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, label[i], low)
        np.minimum.at(after, label[j], low)
        while True:
            jumped = after[after]
            if np.array_equal(jumped, after):
                break
            after = jumped
        if np.array_equal(after, label):
            break
        label = after
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a, b = np.concatenate([a, column(batch, "u")]), np.concatenate([b, column(batch, "v")])
        if len(a) >= SLICE:
            a, b = unite(a, b)
            if len(a) >= SLICE // 2:  # mostly new nodes: hand them on
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])
                a, b = a[:0], b[:0]
    if len(a):
        a, b = unite(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])


def _round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) % 1000000007 as bigint))")).first())


def components(stages: Stages, links: DataFrame) -> Stage:
    """Columns u, v: every node that is not the smallest of its component, and that smallest node.

    links: columns u, v (bigint), in any order and number; rows with nulls and loops are ignored. A node that is not in
    the result's u is the smallest of its component, which may be itself alone.
    """
    links = links.filter("u is not null and v is not null and u <> v").select("u", "v")
    now = stages.cut(links.mapInArrow(_united, LINK_SCHEMA))
    before = _state(now.df)
    while before[0]:
        after = stages.cut(_round(now.df))
        now.drop()
        now, state = after, _state(after.df)
        if state == before:
            break
        before = state
    return now
