"""Ranges from doubling tables next to plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators.ranges import Table, deeper, deepest, falling, plus, with_tables

LENGTHS = (1, 2, 3, 20, 37, 64)


def test_extremes_sums_and_falls(spark):
    g = random.Random(3)
    rows = [(t, [None if 5 <= i < 9 and t == "B" else round(g.uniform(10, 20), 3) for i in range(n)]) for t, n in (("A", 150), ("B", 40), ("C", 1))]
    close = F.col("c")
    hi, lo = Table("hi", close, F.greatest, 64), Table("lo", close, F.least, 64)
    total, fall = Table("sum", F.transform(close, lambda x: F.coalesce(x, F.lit(0.0))), plus, 64), Table("fall", falling(close), deeper, 64)
    cells = lambda i: F.array(*[F.struct(
        F.lit(n).alias("n"), i.alias("i"), hi.extreme(i, n).alias("hi"), lo.extreme(i, n).alias("lo"), total.total(i, n).alias("sum"),
        deepest(fall.parts(i, n)).alias("dd")) for n in LENGTHS])
    out = with_tables(spark.createDataFrame(rows, "t string, c array<double>"), [hi, lo, total, fall])
    got = out.select("t", F.inline(F.flatten(F.transform(F.sequence(F.lit(-2), F.size("c") - 1), cells)))).collect()
    closes = dict(rows)
    assert len(got) == sum((len(c) + 2) * len(LENGTHS) for c in closes.values())
    for r in got:
        near = [x for x in closes[r["t"]][max(r["i"], 0): r["i"] + r["n"]] if x is not None]
        if r["i"] < 0:
            assert r["hi"] is None and r["lo"] is None and r["sum"] is None
            continue
        assert r["hi"] == max(near, default=None) and r["lo"] == min(near, default=None)
        assert math.isclose(r["sum"], sum(near), abs_tol=1e-9)
        falls = [near[b] / near[a] - 1 for a in range(len(near)) for b in range(a + 1, len(near))]
        assert r["dd"] == pytest.approx(min([0.0, *falls]))


def test_levels_are_not_unfolded(spark):
    """Every level is computed once: the plan grows with the levels, not with their powers."""
    df = spark.createDataFrame([("A", [1.0, 2.0])], "t string, c array<double>")
    size = [len(with_tables(df, [Table("x", F.col("c"), F.greatest, n)])._jdf.queryExecution().optimizedPlan().toString()) for n in (16, 64, 256)]
    assert size[2] - size[1] < 2 * (size[1] - size[0]) + 2000
