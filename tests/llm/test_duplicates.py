from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import Groups, jaccard, repeats, simhash, within

from tideline.llm import components as U
from tideline.llm import simhash_variants as H
from tideline.llm import suffix_sort as S
from tideline.llm import weighted_sampling as W
from tideline.llm.common import Stages


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    got = dict(U.components(Stages(spark, "test"), spark.createDataFrame(links, "u long, v long").repartition(7)).df.collect())
    groups = Groups()
    for a, b in links:
        groups.unite(a, b)
    nodes = {x for link in links for x in link}
    least = {}
    for x in sorted(nodes):
        least.setdefault(groups.find(x), x)
    assert got == {x: least[groups.find(x)] for x in nodes if least[groups.find(x)] != x}


def test_unite_in_numpy():
    nodes, least = U.unite(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(nodes.tolist(), least.tolist())) == {5: 1, 3: 1, 9: 8}


def test_fingerprints_and_components(small):
    rows = small.select("doc_id", "text").orderBy("doc_id").collect()
    marks = [simhash(r["text"]) for r in rows]
    first = within(marks, 2)
    got = {r["doc_id"]: (r["mark"] % 2**64, r["component_id"]) for r in H.simhash_components(small).collect()}
    assert got == {r["doc_id"]: (m, rows[f]["doc_id"]) for r, m, f in zip(rows, marks, first, strict=True)}
    kept = sorted(r["doc_id"] for r in H.keep_one(small).collect())
    assert kept == [rows[i]["doc_id"] for i in sorted(set(first))] and H.keep_one(small).columns == small.columns


@pytest.mark.parametrize("group", [4096, 3])
def test_links_at_every_distance(spark, monkeypatch, group):
    """Fingerprints around a few centres, so that many share a variant."""
    monkeypatch.setattr(H, "GROUP", group)
    r = random.Random(6)
    marks = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(25):
            marks.add(centre ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 3))}))
    marks = sorted(marks)
    signed = [(m - 2**64 if m >= 2**63 else m,) for m in marks]
    st = Stages(spark, "test")
    got = dict(U.components(st, H.links(st, spark.createDataFrame(signed, "mark long"))).df.collect())
    first = within([s[0] % 2**64 for s in sorted(signed)], 2)
    order = [s[0] for s in sorted(signed)]
    assert got == {order[i]: order[f] for i, f in enumerate(first) if i != f}


def test_simhash_of_odd_rows(odd, empty):
    got = [(r["doc_id"], r["component_id"]) for r in H.simhash_components(odd).collect()]
    assert len(got) == odd.count() and (3, 1) in got and (8, 1) in got and got.count((1, 1)) == 2
    assert H.simhash_components(empty).count() == 0 and H.keep_one(empty).count() == 0


def passages() -> list[str]:
    r = random.Random(5)
    base = ["".join(r.choices("abcdefgh ", k=r.randint(300, 1500))) for _ in range(12)]
    texts = []
    for _ in range(90):
        texts.append("".join(
            r.choice(base)[r.randint(0, 200):][: r.randint(100, 900)] if r.random() < 0.6 else "".join(r.choices("abc é", k=r.randint(0, 500)))
            for _ in range(r.randint(1, 5))))
    return texts + ["a" * 2000, "b" + "a" * 450 + "c", "", "ab" * 700, "x" * 399, "x" * 400, "y" * 401] + [base[0][:500] + str(i) * 3 for i in range(25)]


@pytest.mark.parametrize("crowd", [50_000, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)
    texts = passages()
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in S.repeat_report(df).collect()}
    want = repeats([t.encode() for t in texts] + [b""])
    assert got == dict(zip([*range(len(texts)), 999], want, strict=True))


def test_texts_after_removal(spark):
    texts = passages()
    got = {r["doc_id"]: r["text"] for r in S.remove_repeats(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    want = repeats([t.encode() for t in texts])
    for i, (n, removed, _, sha) in enumerate(want):
        if removed == n and n:
            assert i not in got
        elif removed == 0 or all(ord(c) < 128 for c in texts[i]):
            assert hashlib.sha256(got[i].encode()).hexdigest() == sha


@pytest.mark.parametrize("crowd", [50_000, 3])
def test_passages_by_words(spark, monkeypatch, crowd):
    """Shared passages of 51 short words go at any white space, those of 50 stay; 400 bytes in fewer words go as before."""
    monkeypatch.setattr(S, "CROWD", crowd)
    r = random.Random(12)

    def words(n: int, letters: int = 4) -> list[str]:
        return ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, letters))) for _ in range(n)]

    texts = []
    for n, copies in ((51, 2), (50, 2), (51, 5), (70, 2), (50, 4)):
        shared = words(n)
        for k in range(copies):
            texts.append(r.choice(" \n").join([*words(r.randint(0, 30)), *shared, *words(r.randint(0, 30))]))
            assert n > 60 or len(" ".join(shared)) < 400
    equal, wide = " ".join(words(55)), " ".join("".join(r.choices("abcdefgh", k=40)) for _ in range(12))
    texts += [equal, equal, "first " + wide, wide + " last", " ".join(["ha"] * 60), "", "a b"]
    seen = Counter(tuple(x[i: i + 51]) for x in map(str.split, texts) for i in range(len(x) - 50))
    got = {row["doc_id"]: row["text"] for row in S.remove_repeats(
        spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3), 51).collect()}
    want = {}
    for i, (text, by_bytes) in enumerate(zip(texts, repeats([t.encode() for t in texts]), strict=True)):
        x, places = text.split(), [m.span() for m in re.finditer(r"\S+", text)]
        gone = [j for j in range(len(x) - 50) if seen[tuple(x[j: j + 51])] > 1]
        if not by_bytes[1] or gone:
            out = [not any(places[j][0] <= at < places[j + 50][1] for j in gone) for at in range(len(text))]
            want[i] = "".join(c for c, stays in zip(text, out, strict=True) if stays)
    kept = {i: got[i] for i in got if i in want}
    assert kept == {i: t for i, t in want.items() if t or not texts[i]}
    assert "first " in got.values() and " last" in got.values() and equal not in got.values()


def test_report_of_passages_by_words(spark):
    """Bytes in repeated runs of 51 words, next to the removal by bytes, which stays as it is."""
    r = random.Random(14)

    def words(n: int) -> list[str]:
        return ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 5))) for _ in range(n)]

    texts = passages()
    for n, copies in ((51, 2), (50, 3), (80, 3), (200, 2)):
        shared = words(n)
        texts += [" ".join([*words(r.randint(0, 40)), *shared, *words(r.randint(0, 40))]) for _ in range(copies)]
    texts += [(t := " \n " + " ".join(words(60)) + " "), t, " ".join(["ha"] * 60), "a b", ""]
    seen = Counter(tuple(x[i: i + 51]) for x in map(str.split, texts) for i in range(len(x) - 50))
    got = {row["doc_id"]: row for row in S.repeat_report(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3), 51).collect()}
    for i, (text, by_bytes) in enumerate(zip(texts, repeats([t.encode() for t in texts]), strict=True)):
        data = text.encode()
        x, places = text.split(), [m.span() for m in re.finditer(rb"\S+", data)]
        if len(x) != len(places):
            continue
        gone = bytearray(len(data))
        for j in range(len(x) - 50):
            if seen[tuple(x[j: j + 51])] > 1:
                gone[places[j][0]: places[j + 50][1]] = b"\1" * (places[j + 50][1] - places[j][0])
        row = got[i]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) == by_bytes
        assert row["n_passage"] == sum(gone), (i, text[:50])
        assert row["n_passages"] == len(re.findall(rb"\x01+", bytes(gone)))


def test_multikey_order_sorts():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 400):
        group = np.sort(r.integers(0, 1 + n // 20, n))
        symbols = r.integers(0, 3, (n, 2)).astype(np.uint64) << np.uint64(60)
        order = S.multikey_order(group, symbols)
        assert np.array_equal(order, np.lexsort((symbols[:, 1], symbols[:, 0], group)))


def test_blind_trie_sorts():
    r = random.Random(8)
    for _ in range(200):
        strings = ["".join(r.choices("ab", k=r.randint(0, 6))).encode() for _ in range(r.randint(1, 30))]
        order, common = S.blind_trie_order(strings)
        placed = [strings[i] for i in order]
        assert placed == sorted(strings)
        for k in range(1, len(placed)):
            a, b = placed[k - 1], placed[k]
            assert common[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def test_deep_shallow_common_prefixes():
    r = random.Random(9)
    strings = [b"shared prefix that is long" * r.randint(0, 2) + "".join(r.choices("ab\0", k=r.randint(0, 30))).encode() for _ in range(120)]
    group = np.sort(np.array([r.randrange(4) for _ in strings]))
    order, common = S.deep_shallow(group, strings)
    assert sorted(order.tolist()) == list(range(120))
    for k in range(120):
        new = k == 0 or group[order[k]] != group[order[k - 1]]
        assert (common[k] == -1) == new
        if not new:
            a, b = strings[order[k - 1]], strings[order[k]]
            assert common[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def test_removal_of_odd_rows(odd, empty):
    got = [tuple(r)[:4] for r in S.repeat_report(odd).collect()]
    assert len(got) == odd.count() and got.count((2, 12000, 12000, 1)) == 2 and (9, 5000, 5000, 1) in got and (3, 0, 0, 0) in got
    assert S.repeat_report(empty).count() == 0 and S.remove_repeats(empty).columns == empty.columns


def test_weighted_fingerprints(small):
    rows = small.select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in W.document_fingerprints(small).collect()}
    near, truth = [], []
    for i, r in enumerate(rows):
        text, after = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        x = got[r["doc_id"]]
        assert (x["n_chars"], x["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        near += [x["near_edited"], x["near_next"]]
        truth += [jaccard(text, edited), jaccard(text, after)]
    error = np.array(near) - np.array(truth)
    assert abs(error.mean()) < 0.02 and np.sqrt((error**2).mean()) < 0.08
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"], got[r["doc_id"]]["fingerprint"]) == got[r["doc_id"]]["fingerprint"]


def test_weights_matter_to_the_samples(spark):
    """Collision rates over many small texts follow min / max of the weights."""
    pairs = [(2 * i, f"a{i} " * 3 + f"b{i} ") for i in range(300)] + [(2 * i + 1, f"a{i} " + f"b{i} ") for i in range(300)]
    rows = W.document_fingerprints(spark.createDataFrame(pairs, "doc_id long, text string")).filter("doc_id % 2 = 0")
    assert abs(np.mean([r["near_next"] for r in rows.collect()]) - 2 / 4) < 0.03


def test_quantiles():
    for u in (1e-8, 0.001, 0.3, 0.9, 0.9999):
        x = W._gamma_quantile(u)
        assert 1 - np.exp(-x) * (1 + x) == pytest.approx(u, rel=1e-6)


def test_fingerprints_of_odd_rows(odd, empty):
    got = {r["doc_id"]: r for r in W.document_fingerprints(odd).collect()}
    assert set(got) == {None, *range(1, 10)} and got[None]["near_next"] is None
    zero = "0" * W.DIGITS * W.SAMPLES
    assert got[1]["fingerprint"] == got[3]["fingerprint"] == got[8]["fingerprint"] == zero and got[5]["fingerprint"] != zero
    assert W.document_fingerprints(empty).count() == 0
