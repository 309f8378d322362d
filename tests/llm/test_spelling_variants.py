from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tideline.llm import spelling_variants as V


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def want(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(V.UPPER, V.LOWER))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def got(df):
    rows = V.spelling_variants(df).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r)[1:] for r in rows}


def texts(seed: int, letters: str = "abcé"):
    r, rows = random.Random(seed), []
    base = ["".join(r.choices(letters, k=r.randint(5, 8))) for _ in range(60)] + ["ÀÉßäö×÷ÿ", "x" * 40]
    for i in range(150):
        line = []
        for _ in range(60):
            w = base[min(int(r.expovariate(0.15)), len(base) - 1)]
            if r.random() < 0.2:
                at = r.randrange(len(w))
                w = w[:at] + r.choice(["", r.choice(letters), w[at] + r.choice(letters)]) + w[at + 1:]
            line.append(w.upper() if r.random() < 0.05 else w)
        rows.append((i, r.choice(" .,0ğ\n").join(line)))
    return rows


def test_equals_all_pairs(spark):
    for seed in (1, 2):
        rows = texts(seed)
        found, expected = got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), want(rows)
        assert found == expected
        assert sum(v[0] is not None for v in expected.values()) > 10


def test_forms_in_a_chain(spark):
    chain = ["abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    rows = [(i, " ".join([w] * 5**k * 5)) for i, (k, w) in enumerate((k, w) for k, w in enumerate(chain)) for _ in range(1)]
    found = got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == want(rows)


def test_given_documents(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    assert got(small) == want(rows)


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd) == want(rows) and got(empty) == {}


def test_long_text(spark):
    rows = [(1, "spelling spellling grammar " * 400_000), (2, "spellin " * 30)]
    df = spark.createDataFrame([(*r, 1, "w", 2) for r in rows], "doc_id long, text string, n int, word string, reduced int")
    assert got(df) == want(rows)


def test_neighbourhoods_hold_every_edit():
    r = random.Random(4)
    strings = [[r.randint(1, 3) for _ in range(n)] for n in (0, 1, 2, 5, 13, 14, 15, 20)]
    flat, lengths = np.array([x for s in strings for x in s], np.uint64), np.array([*map(len, strings)])
    row, key = V.neighbourhood(flat, lengths, 3)
    assert len({*zip(row.tolist(), key.tolist())}) == len(row)
    key_of = lambda s: int(V._keys(np.array(s, np.uint64), np.array([len(s)]))[0])
    for i, s in enumerate(strings):
        edits = {tuple(s)} | {tuple(s[:k] + s[k + 1:]) for k in range(len(s))}
        edits |= {tuple(s[:k] + [x] + s[k:]) for k in range(len(s) + 1) for x in (1, 2, 3)}
        edits |= {tuple(s[:k] + [x] + s[k + 1:]) for k in range(len(s)) for x in (1, 2, 3)}
        assert {key_of(list(e)) for e in edits} == set(key[row == i].tolist())


def test_letters_become_symbols():
    flat, lengths = V.coded(pa.array(["aé", "", "xyz"]))
    assert lengths.tolist() == [2, 0, 3] and flat.min() >= 1 and flat.max() <= V.SYMBOLS
