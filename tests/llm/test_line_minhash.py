from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import kept_lines

from tideline.llm import line_minhash as M


def rows(seed: int = 2) -> list[tuple]:
    r = random.Random(seed)
    base = ["".join(r.choices("abcdefghij   ", k=r.randint(12, 200))) for _ in range(40)]

    def edited(line: str) -> str:
        out = list(line)
        for _ in range(r.randint(0, max(1, len(out) // 25))):
            out[r.randrange(len(out))] = r.choice("xyz é漢")
        return "".join(out)

    return [(i, "\n".join(edited(r.choice(base)) for _ in range(r.randint(0, 20)))) for i in range(100)]


@pytest.mark.parametrize("crowd", [20_000, 8])
def test_lines_stay_as_brute_force_says(spark, monkeypatch, crowd):
    monkeypatch.setattr(M, "CROWD", crowd)
    given = rows()
    got = dict(M.dedup_lines(spark.createDataFrame(given, "doc_id long, text string")).collect())
    want = dict(zip([k for k, _ in given], kept_lines(given, M.LIKE, M.WIDTH, M.LEAST), strict=True))
    lost = {k for k, t in given if t != want[k] and not want[k].strip(" ")}
    assert got == {k: t for k, t in want.items() if k not in lost}


def test_short_lines_go_and_blank_ones_stay(spark):
    given = [(1, "Les.\n\nAnd ornd.\nx\n \nthe first document has this"), (2, "Les.\n\nAnd ornd.\ny\n \nanother line of its own"), (3, "Les.\nLes\nx\nz")]
    got = dict(M.dedup_lines(spark.createDataFrame(given, "doc_id long, text string")).collect())
    assert got == {1: given[0][1], 2: "\ny\n \nanother line of its own", 3: "Les\nz"}


def test_bands_are_shared_by_alike_lines():
    r = random.Random(1)
    lines = ["".join(r.choices("abcdefghijklmnop ", k=300)) for _ in range(300)]
    close = [x[:100] + "Q" + x[101:200] + "Q" + x[201:] for x in lines]
    a, b = M.bands(lines), M.bands(close)
    assert (a == b).any(axis=1).mean() > 0.99 and not (a == np.roll(b, 1, axis=0)).any()


def test_members_across_batches():
    r = random.Random(3)
    rows = sorted({(r.randrange(12), r.randrange(40)) for _ in range(60)})
    want = sorted((b, i, min(j for c, j in rows if c == b)) for b, i in rows if sum(c == b for c, _ in rows) > 1)
    for size in (1, 2, 3, 7, 100):
        parts = [rows[a: a + size] for a in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in p]), pa.array([x[1] for x in p])], ["bucket", "id"]) for p in parts]
        got = [tuple(row.values()) for batch in M._members(iter(batches)) for row in batch.to_pylist()]
        assert sorted(got) == want, size


def test_odd_rows(spark, odd, empty):
    report = {(r["doc_id"], r["n_lines"], r["n_removed"]) for r in M.line_report(odd).collect()}
    assert (1, 1, 0) in report and (4, 3, 0) in report and M.line_report(odd).count() == odd.count()
    assert M.line_report(empty).count() == 0 and M.dedup_lines(empty).columns == empty.columns


def test_columns_of_the_caller_survive(spark):
    df = spark.createDataFrame([(1, "the same long line\nother words entirely", 5, "k"), (2, "the same long line", 6, "l")],
                               "doc_id long, text string, mark int, dropped string")
    assert sorted(map(tuple, M.dedup_lines(df).collect())) == [(1, "the same long line\nother words entirely", 5, "k")]


@pytest.mark.parametrize("paired", [4, 0])
def test_large_buckets_are_searched_by_prefixes(spark, monkeypatch, paired):
    monkeypatch.setattr(M, "PAIRED", paired)
    test_lines_stay_as_brute_force_says(spark, monkeypatch, 20_000)


def test_pairs_are_judged_as_by_their_strings():
    r = random.Random(8)
    lines = ["".join(r.choices("abc ", k=r.randint(1, 90))) for _ in range(60)] + ["", "漢字", "a" * 50]
    texts = lines + [x[:5] + "Q" + x[6:] for x in lines] + [x + "tail"[: r.randint(0, 4)] for x in lines]
    a, b = (np.array([r.randrange(len(texts)) for _ in range(3000)]) for _ in range(2))
    b[:1000] = a[:1000] % len(lines) + len(lines) * np.array([r.randrange(3) for _ in range(1000)])
    got = M.alike_pairs(texts, a, b)
    assert got.tolist() == [M.similarity(M.shingles(texts[i]), M.shingles(texts[j])) >= M.LIKE for i, j in zip(a, b)] and 0 < got.sum() < len(a)


def test_band_keys_meet_in_their_part():
    r = np.random.default_rng(4)
    ids, keys = np.arange(200), r.integers(-50, 50, (200, M.BANDS))
    packed = M._packed(keys, np.arange(201))
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a: a + 30]), packed.slice(a, 30)], ["id", "bands"]) for a in range(0, 200, 30)]
    dealt = pa.Table.from_batches(M._dealt(iter(batches), 7)).sort_by("part")
    rows = [x for batch in M._sorted_parts(iter(dealt.to_batches(max_chunksize=2))) for x in zip(*(c.to_pylist() for c in batch.columns))]
    assert sorted(rows) == sorted((int(k), i) for i in range(200) for k in keys[i])
    seen = [k for k, _ in itertools.groupby(b for b, _ in rows)]
    assert len(seen) == len(set(seen))


def test_members_of_a_bucket_that_is_not_held_whole(monkeypatch):
    monkeypatch.setattr(M, "HELD", 3)
    ids = [5, 3, 9, 1, 7, 2, 8]
    batches = [pa.RecordBatch.from_arrays([pa.array([4] * len(x)), pa.array(x)], ["bucket", "id"]) for x in (ids[:4], ids[4:5], ids[5:])]
    got = [tuple(row.values()) for batch in M._members(iter(batches)) for row in batch.to_pylist()]
    assert got == [(4, i, 1) for i in ids]


def test_pairs_of_different_components():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 1, 1, 2, 2]), pa.array([10, 11, 12, 13, 10, 11]), pa.array([7, 8, 7, 9, 7, 7])], ["bucket", "id", "root"])
    got = sorted(tuple(row.values()) for b in M._crossing(iter([batch])) for row in b.to_pylist())
    assert got == [(10, 11), (10, 13), (11, 12), (11, 13), (12, 13)]
