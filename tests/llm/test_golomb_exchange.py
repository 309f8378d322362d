from __future__ import annotations

import numpy as np
import pytest
from compare import compare, duck

from tideline.llm import golomb_exchange as X
from tideline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("n, top", [(0, 10), (1, 10), (5, 5), (1000, 1 << 40), (3000, 4000)])
def test_golomb_round_trip(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(7, 7 + top, n))
    data = X.golomb_encode(values, 7)
    assert np.array_equal(X.golomb_decode(data, 7), values)
    if n == 1000:
        assert len(data) * 8 / len(values) < 2.5 + np.log2(top / len(values))


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    problem, rows = compare(spark, duck(sf), QUERIES["op2_exact_dedup"], ORACLES["op2_exact_dedup"], sf)
    assert problem is None and rows == 200


def test_many_owners_and_messages(spark, monkeypatch):
    monkeypatch.setattr(X, "OWNED", 7)
    monkeypatch.setattr(X, "SENT", 5)
    df = spark.createDataFrame([(i, f"Text {i % 13}" if i % 2 else f"t{i}") for i in range(200)], "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in X.exact_duplicates(df).collect()}
    for i in range(200):
        same = [j for j in range(200) if j % 2 and j % 13 == i % 13] if i % 2 else [i]
        assert got[i] == (max(same), len(same), i == max(same))


def test_odd_rows(odd, empty):
    got = [tuple(r) for r in X.exact_duplicates(odd).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert len(got) == odd.count()
    assert got.count((1, 3, 3, False)) == 2 and (3, 3, 3, True) in got and (None, 7, 2, False) in got and got.count((2, 2, 2, True)) == 2
    assert X.exact_duplicates(empty).count() == 0
