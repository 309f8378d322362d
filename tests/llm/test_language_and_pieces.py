from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tideline.llm import crf_language as C
from tideline.llm import piece_merges as S


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(3)
    steps, k = 5, 3
    states, moves, first = rng.normal(size=(steps, 1, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    want, pairs, total = np.zeros((steps, k)), np.zeros((k, k)), 0.0
    for path in itertools.product(range(k), repeat=steps):
        score = np.exp(first[path[0]] + sum(states[i, 0, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += score
        for i, y in enumerate(path):
            want[i, y] += score
        for a, b in zip(path, path[1:]):
            pairs[a, b] += score
    got, joint = C.marginals(states, moves, first, np.ones((steps, 1), bool))
    assert np.allclose(got[:, 0], want / total) and np.allclose(joint, pairs / total)
    field = C.Field(["a", "b", "c"])
    field.moves, field.first = moves, first
    assert np.allclose(C._only_marginals(states, field, np.ones((steps, 1), bool))[:, 0], want / total)


def test_short_chains_are_not_touched_by_longer_ones():
    rng = np.random.default_rng(4)
    states, moves, first = rng.normal(size=(6, 2, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    mask = np.array([[True, True]] * 3 + [[True, False]] * 3)
    alone, _ = C.marginals(states[:3, 1:], moves, first, np.ones((3, 1), bool))
    both, _ = C.marginals(states, moves, first, mask)
    assert np.allclose(both[:3, 1], alone[:, 0])


def test_held_out_accuracy(small):
    lang = {r["doc_id"]: r["lang"] for r in small.collect()}
    got = [r for r in C.languages(small).collect() if r["held_out"]]
    assert all(r["held_out"] == C.is_held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.95


def test_code_switched_words(small):
    rows = [(r["lang"], r["text"].encode()) for r in small.filter("lang is not null and length(text) between 200 and 4000").collect()]
    field = C.fit(rows[:120])
    by = {lang: text.decode().split() for lang, text in rows[120:]}
    mixed = by["en"][:30] + by["de"][:30]
    labels = [y for _, y, _ in C.label_words(field, " ".join(mixed))]
    assert labels[:30].count("en") > 24 and labels[30:].count("de") > 24


def test_texts_without_blanks():
    r = random.Random(5)
    han = lambda n: "".join(chr(0x4E00 + r.randrange(300)) for _ in range(n))
    latin = lambda n: [("".join(r.choices("abcdefgh", k=r.randint(2, 8)))) for _ in range(n)]
    field = C.fit([x for _ in range(30) for x in (("en", " ".join(latin(80)).encode()), ("zh", han(500).encode()))])
    texts = ["".join(latin(20))[:40] + han(3000), " ".join([*latin(4), han(3000)]), " ".join(latin(50)), han(30), " ".join([*latin(60), han(100)])]
    best, score = C.labelled(field, pa.array([t.encode() for t in texts], pa.binary()))
    assert [field.labels[i] for i in best] == ["zh", "zh", "en", "zh", "en"] and score[0] > 0.9 and score[1] > 0.9
    assert "".join(w for w, _, _ in C.label_words(field, texts[0])) == texts[0]


def test_long_training_texts_are_cut(spark):
    text = "漢字かな交じり文" * 6000
    rows = [(i, text if i % 2 else "some words of a short text", "ja" if i % 2 else "en") for i in range(30)]
    sample = C.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    long = [t for label, t in sample if label == "ja"]
    assert {label for label, _ in sample} == {"en", "ja"} and all(0 < len(t) <= C.SAMPLE_BYTES and t.decode() in text for t in long)
    assert len(long) == sum(-(-len(text.encode()) // C.SAMPLE_BYTES) for i in range(30) if i % 2 and not C.is_held(i))


def test_workers_get_texts_a_few_megabytes_at_a_time(spark):
    docs = spark.range(1500).selectExpr("id as doc_id", "repeat('some words ', 1000) as text", "'en' as lang").coalesce(1)
    C.fitted(spark, docs.limit(3))
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) == 1500 and max(r["n"] for r in sizes) * 11_000 < 6 << 20


def test_language_of_odd_rows(odd, empty):
    got = {r["doc_id"]: r for r in C.languages(odd).collect()}
    assert all(got[k]["lang_pred"] == C.UNKNOWN and got[k]["score"] == 0 for k in (1, 3, 6, 8)) and got[2]["lang_pred"] in ("en", "es", "fr")
    assert C.languages(odd).count() == odd.count() and C.languages(empty).count() == 0
    assert {r["doc_id"] for r in C.known_language(odd, 0.0).collect()} == {None, 2, 4, 5, 7, 9}


PARTS = ["'", "s", "t", "re", "ve", "m", " ", "  ", "\n", "\t", "a", "Z", "é", "漢", "1", "²", " ", "!", "😀", "the", "ing", "ation", " th",
         "▁", "<0x41>", "<s>", "</s>", "<unk>", "_", "\r\n", "ع", "​", "̀", "aaaaa", "ererer", "\u0001"]


def test_pieces_equal_the_library():
    library, own, r = sentencepiece.SentencePieceProcessor(model_file=S.MODEL), S.load(), random.Random(1)
    texts = ["".join(r.choices(PARTS, k=r.randint(0, 14))) for _ in range(4000)]
    texts += ["", " ", "  ", "ab" * 600, "theing" * 300 + "xyz er" * 50, "a" * 1000] + ["".join(r.choices("etaoinsr", k=500)) for _ in range(20)]
    ids, lengths = own.encode(pa.array([t.encode() for t in texts], pa.binary()))
    ends = np.cumsum(lengths)
    for t, e, n, want in zip(texts, ends, lengths, library.encode(texts, num_threads=1), strict=True):
        got = ids[e - n: e].tolist()
        assert got == want, t
        assert own.decode([*got, 2]) == library.decode([*want, 2]).encode(), t


def test_long_words_merge_as_short_ones(monkeypatch):
    own, r = S.load(), random.Random(2)
    for _ in range(50):
        symbols = own.of_point[np.frombuffer(("▁" + "".join(r.choices("etaoinsrh", k=60))).encode("utf-32-le"), np.uint32)]
        flat, _ = own.merge_words(symbols.copy(), np.array([len(symbols)]))
        assert np.array_equal(flat, own.merge_long(symbols))


def test_pieces_of_documents(small, odd, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    text = {r["doc_id"]: r["text"] or "" for r in small.collect()}
    for r in S.piece_digests(small).collect():
        ids = library.encode(text[r["doc_id"]]) + [2]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    again = {r["doc_id"]: r["text"] for r in S.decode_pieces(S.encode_pieces(small)).collect()}
    assert again == {k: library.decode(library.encode(t)) for k, t in text.items()}
    assert S.piece_digests(odd).count() == odd.count() and S.piece_digests(empty).count() == 0
    assert S.piece_digests(odd.filter("doc_id = 3")).first()["n_tokens"] == 1


@pytest.mark.parametrize("text", ["x" * 5000, "\n" * 3000])
def test_pieces_of_texts_without_blanks(text):
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    assert S.load().encode(pa.array([text.encode()], pa.binary()))[0].tolist() == library.encode(text)
