from __future__ import annotations

import math

import numpy as np
import pytest

from tideline.llm import exact_topk as T

SCHEMA = "vec_id long, embedding array<float>, label int"


def want(rows, best=20, every=20):
    whole = [(i, v, [math.floor(64 * float(x)) for x in e]) for i, (v, e, *_) in enumerate(rows)
             if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, q, a in whole:
        if q is None or q % every:
            continue
        found = sorted(((-sum(x * y for x, y in zip(a, b)), c is None, c or 0, j, c) for j, c, b in whole if j != i))
        out += [(q, k + 1, x[4], -x[0]) for k, x in enumerate(found[:best])]
    return sorted(out, key=repr)


def got(df, **more):
    return sorted((tuple(r) for r in T.nearest(df, **more).collect()), key=repr)


def vectors(seed, n, width=8):
    g = np.random.default_rng(seed)
    x = np.float32(g.normal(0, 0.2, (n, width)))
    x[g.random((n, width)) < 0.5] = 0  # sparse rows
    x[n // 3: n // 2] = x[0]  # a large group of equal vectors
    return [(i, x[i].tolist(), 0) for i in range(n)]


@pytest.mark.parametrize(("block", "tile", "tile_queries"), [(32_768, 4096, 32), (40, 16, 3), (300, 50, 7)])
def test_equals_all_products(spark, monkeypatch, block, tile, tile_queries):
    for name, value in (("BLOCK", block), ("QUERY_BLOCK", 5), ("TILE", tile), ("TILE_QUERIES", tile_queries)):
        monkeypatch.setattr(T, name, value)
    rows = vectors(block, 400)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want(rows)
    assert got(spark.createDataFrame(rows, SCHEMA), best=3, every=100) == want(rows, 3, 100)


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert got(df) == want([tuple(r) for r in df.select("vec_id", "embedding").collect()])


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (20, [], 1), (40, None, 1), (60, [float("nan"), 1.0], 1), (80, [float("inf")], 1), (100, [None, 1.0], 1),
            (None, [1.0, 0.5], 1), (-20, [-0.001, 3.0, 7.0], 1), (1, [0.5], None), (0, [1.0, 0.5], 1), (5, [1000.0, -2e5], 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", row string, score int")
    assert got(df) == want(rows)
    assert T.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert T.nearest(spark.createDataFrame([(20, [1.0], 1)], SCHEMA)).count() == 0
    huge = [(20, [3e38, 1.0], 0), (1, [1.0, 1.0], 0), (2, [1e12, 0.0], 0)]  # saturates and wraps
    assert T.nearest(spark.createDataFrame(huge, SCHEMA)).count() == 2
    wide = [(i, [float((i * j) % 7 - 3) for j in range(3000)], 0) for i in range(45)]
    assert got(spark.createDataFrame(wide, SCHEMA)) == want(wide)


def test_cells_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 50)
    monkeypatch.setattr(T, "QUERY_BLOCK", 5)
    rows = vectors(3, 300)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # no small partitions merged: equal keys must meet by their hash
    try:
        assert got(spark.createDataFrame(rows, SCHEMA)) == want(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
