from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from tideline.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
AFTER, ASKED = {0: 2, 1: 2, 2: 3, 3: 2}, {0: "user", 1: "user", 2: "assistant", 3: "user"}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
BLANK = "\t\n\x0b\x0c\r "


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest())
    return sorted(out, key=order)


def one(rows):
    """A conversation repaired by costs to go and a walk that takes the first letter that stays cheapest."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        shown = text.rstrip(BLANK)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)

    def ways(i, q):
        if i < n:
            fault, role = faults[i], rows[i][2]
            short = 3 * (fault == "truncated")
            yield "D", 4, i + 1, q
            if fault not in ("blank", "duplicate"):
                if (q, role[:1]) in KEPT:
                    yield "K", short, i + 1, KEPT[q, role[:1]]
                yield "R", 3 + short, i + 1, AFTER[q]
        yield "I", 3, i, AFTER[q]

    @cache
    def togo(i, q, inserted=0):
        best = 0 if i == n and q in (0, 3) else 10**9
        for letter, cost, j, p in ways(i, q):
            if letter != "I" or inserted < 4:
                best = min(best, cost + togo(j, p, inserted + 1 if letter == "I" else 0))
        return best

    i, q, audit, lines = 0, 0, "", []
    while i < n or q not in (0, 3):
        letter, cost, j, p = min((w for w in ways(i, q) if w[1] + togo(w[2], w[3]) == togo(i, q)), key=lambda w: w[0])
        if letter == "I":
            lines.append(f"{ASKED[q]}:")
        elif letter != "D":
            lines.append(f"{rows[i][2] if letter == 'K' else ASKED[q]}:{rows[i][3]}")
        audit, i, q = audit + letter, j, p
    turns = [t for _, t, _, _ in rows if t is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")}, "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
            "cost": togo(0, 0), "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def want(rows):
    return {c: one(tuple(r for r in damage(rows) if r[0] == c)) for c in {r[0] for r in rows}}


def got(df):
    out = {}
    for r in R.repair_conversations(df).collect():
        assert r["conv_id"] not in out
        out[r["conv_id"]] = {k: r[k] for k in R.RESULT[1:]}
    return out


def conversations(seed, n, longest):
    r, rows = random.Random(seed), []
    for c in range(n):
        turns = sorted(r.sample(range(longest * 2), r.randint(1, longest)))
        for t in turns:
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c, r.choice([t, t, t, None]) if r.random() < 0.1 else t, role,
                         r.choice(["yes.", "no!", "why?", "cut short", "", " \n", None, "é. ", "x.\x85", "same.", "same."])))
    return rows


@pytest.mark.parametrize(("n", "longest", "piece"), [(120, 10, 20_000), (12, 60, 20_000), (12, 60, 7), (60, 6, 3)])
def test_equals_costs_to_go(spark, monkeypatch, n, longest, piece):
    monkeypatch.setattr(R, "PIECE", piece)
    rows = conversations(n + longest + piece, n, longest)
    rows += rows[:5] + [(None, None, None, None), (None, 3, "user", "hm."), (10**15, None, "assistant", "?"), (-4, 2**62, "system", "s.")]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want(rows)


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got(df) == want([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_one_conversation_over_many_tasks(spark):
    """All rows in one conversation, dealt over ranges; half of them alike."""
    rows = [(7, t // 2, ("user", "assistant", "system")[t % 5 % 3], "same." if t % 2 else f"turn {t}.") for t in range(900)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == want(rows)


def test_odd_tables(spark):
    assert R.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows = [(gone, 1, "user", "x")]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], SCHEMA + ", piece int, code string")
    assert got(df) == {gone: {**dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0), "audit": "",
                              "repaired_sha256": hashlib.sha256(b"").hexdigest()}}
    long = [(c, t, "user" if t % 2 else "assistant", "long text. " * 1_000_000) for c in (1, 2) for t in (1, 2)]
    assert got(spark.createDataFrame(long, SCHEMA)) == want(long)


def test_halves_in_any_grouping():
    """Costs and ranks of a stretch do not depend on where it is divided."""
    g = np.random.default_rng(5)
    for _ in range(50):
        codes = g.integers(0, 4, 6) + g.choice([0, 4, 16], 6)
        flat = R.Tree(R.LEAF_COST[codes], R.LEAF_RANK[codes], np.array([0, 6]))
        c, r = R.LEAF_COST[codes[:1]], R.LEAF_RANK[codes[:1]]
        for k in codes[1:]:
            c, r, _ = R.joined(c, r, R.LEAF_COST[k][None], R.LEAF_RANK[k][None])
        assert np.array_equal(c, flat.cost)
        reachable = c < R.NEVER
        assert np.array_equal(r[reachable], flat.rank[reachable])
