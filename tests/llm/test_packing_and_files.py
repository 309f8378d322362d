from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import crc
from tokenizers import Tokenizer

from tideline.llm import best_fit_packing as P
from tideline.llm import byte_bpe
from tideline.llm import range_coder as R
from tideline.llm.common import Stages


def encoder():
    return Tokenizer.from_file(byte_bpe.VOCABULARY)


def test_ids_equal_the_library():
    r = random.Random(1)
    parts = ["'", "s", "t", "re", "ll", "ve", "d", "m", " ", "  ", "\n", "\t", "a", "Z", "é", "漢", "1", "²", " ", "!", "😀", "'s", "'ll",
             "\x1c", "\x85", "_", "<|endoftext|>", "\r\n", "x'", "ع", "​", "̀"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(4000)] + ["", " ", "'"]
    ids, lengths = byte_bpe.load().encode(pa.array([t.encode() for t in texts], pa.binary()))
    ends, library = np.cumsum(lengths), encoder()
    for t, e, n in zip(texts, ends, lengths, strict=True):
        assert ids[e - n: e].tolist() == library.encode(t, add_special_tokens=False).ids, t


def best_fit_decreasing(sizes, capacity: int) -> int:
    rooms: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [x for x in rooms if x >= s]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - s)
    return len(rooms)


@pytest.mark.parametrize("capacity, n, seed", [(10, 30, 0), (20, 60, 1), (64, 300, 2), (1024, 800, 3), (1024, 800, 4)])
def test_plan_is_gapless_and_no_worse_than_best_fit(capacity, n, seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, capacity + 1, n) if seed % 2 else np.minimum(capacity, rng.geometric(2.5 / capacity, n))
    counts = np.bincount(sizes, minlength=capacity + 1)
    rows = P.plan(counts, capacity)
    key, used = (rows[:, 0] << 44) + rows[:, 1], {}
    for s in range(1, capacity + 1):
        rank = np.arange(counts[s])
        i = np.searchsorted(key, (s << 44) + rank, side="right") - 1
        assert (rows[i, 0] == s).all()
        for q, o in zip(rows[i, 2] + rank - rows[i, 1], rows[i, 3], strict=True):
            used.setdefault(int(q), []).append((int(o), s))
    for places in used.values():
        end = 0
        for o, s in sorted(places):
            assert o == end
            end += s
        assert end <= capacity
    assert len(used) <= best_fit_decreasing(sizes.tolist(), capacity)


def least_sequences(sizes: list[int], capacity: int) -> int:
    """By search over all ways."""
    best = len(sizes)

    def place(i: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            rooms[k] -= sizes[i]
            place(i + 1, rooms)
            rooms[k] += sizes[i]
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def test_reduction_keeps_an_optimum():
    r = random.Random(5)
    for _ in range(60):
        sizes = sorted((r.randint(1, 12) for _ in range(9)), reverse=True)
        counts = np.bincount(sizes, minlength=13)
        fixed = P.reduce_dominated(counts, 12)
        rest = [int(s) for s in np.repeat(np.arange(13), counts)][::-1]
        assert sum(times for _, times in fixed) + least_sequences(rest, 12) == least_sequences(sizes, 12)


def test_packed_documents(small):
    library = encoder()
    ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in small.collect()}
    got = P.packed_documents(small, with_ids=True).toPandas()
    for doc_id, g in got.sort_values("piece").groupby("doc_id"):
        at = 0
        for x in g.itertuples():
            part = ids[doc_id][at: at + x.length]
            assert (x.start, x.ids_crc32) == (at, crc(part)) and list(x.ids) == part
            at += x.length
        assert at == len(ids[doc_id]) and (g.length.iloc[1:] == 1024).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 1024


@pytest.mark.parametrize("n", [0, 1, 5, R.LANES - 1, R.LANES, R.LANES + 1, 700_000])
def test_coder_round_trip_from_any_checkpoint(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, max(n, 10)), 50_000).astype(np.uint32)
    table = R.Table(*np.unique(ids, return_counts=True))
    assert table.frequency.sum() == 1 << R.SCALE and table.frequency.min() > 0
    words, states, places, checks = table.encode(ids[:n])
    block = {"part": 0, "first": 0, "n_ids": n, "words": words.astype("<u4").tobytes(), "states": states.astype("<u8").tobytes(),
             "places": places.tolist(), "checks": checks}
    assert np.array_equal(table.decode_block(block), ids[:n])
    span = R.CHECKPOINT * R.LANES
    for k in range(len(checks)):
        assert np.array_equal(table.decode_segment(block, k), ids[:n][k * span: (k + 1) * span])
    if n > span:
        broken = block | {"words": bytes(1) + block["words"][1:]}
        with pytest.raises(ValueError, match="checksum"):
            table.decode_block(broken)


def test_a_skewed_table_keeps_every_symbol():
    table = R.Table(np.arange(60_000), np.append(10**12, np.ones(59_999, np.int64)))
    assert table.frequency.sum() == 1 << R.SCALE and table.frequency.min() == 1


def test_files_hold_every_document_in_order(spark, small, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 5000)
    library, path = encoder(), f"{Stages(spark, 'test').root}/files"
    R.write_ids(small.repartition(5), path)
    got = {r["doc_id"]: tuple(r)[1:] for r in R.read_documents(spark, path).collect()}
    start = 0
    for r in small.orderBy("doc_id").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        assert got[r["doc_id"]] == (start, len(ids), crc(ids))
        start += len(ids)


def test_odd_rows(spark, odd, empty):
    assert P.packed_documents(empty).count() == 0
    pieces = P.packed_documents(odd).toPandas()
    assert (pieces.groupby(pieces.doc_id.fillna(-1)).size().drop(2) >= 1).all() and len(pieces[pieces.doc_id == 1]) == 2
    for df in (odd, empty):
        path = f"{Stages(spark, 'test').root}/files"
        R.write_ids(df, path)
        assert R.read_documents(spark, path).count() == df.count()
