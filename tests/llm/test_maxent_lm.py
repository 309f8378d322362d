from __future__ import annotations

import numpy as np
import pytest
from brute import base_scores

from tideline.llm import maxent_lm as L


@pytest.fixture(scope="module")
def scored(small):
    return L.model_scores(small).collect()


def test_counts_and_base_score(small, scored):
    want = base_scores({r["doc_id"]: r["text"] for r in small.collect()}, L.is_held)
    assert len(scored) == len(want)
    for r in scored:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, L.is_held(r["doc_id"]))
        assert r["base_score"] == pytest.approx(base)


def test_model_beats_the_base_on_held_out_texts(scored):
    held = [r for r in scored if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(L.ROWS, L.CLASSES + 1)).astype(np.float32)
    rows = rng.integers(0, L.ROWS, (6, 50)).astype(np.uint16)
    every = [np.exp(L.log_odds(weights, rows, np.full(50, k))) for k in range(L.CLASSES + 1)]
    assert np.allclose(np.sum(every, axis=0), 1.0, atol=1e-4)


def test_scores_of_different_texts_are_probabilities(spark):
    """One-word texts: they exclude each other, so their probabilities add up to one at most, and to more than the base's."""
    words = ["alpha", "beta", "gamma", "delta"]
    train = [(i, words[i % 4]) for i in range(400) if not L.is_held(i)]
    ask = [(10_000 + i, w) for i, w in enumerate(words)]
    rows = {r["doc_id"]: r for r in L.model_scores(spark.createDataFrame(train + ask, "doc_id long, text string")).collect()}
    base, model = (sum(10 ** rows[k][c] for k, _ in ask) for c in ("base_score", "score"))
    assert base < model <= 1.0


def test_in_class_probabilities_sum_to_one(spark):
    """With one class per lead the counts of a class and its slot for new words make up all of it."""
    leads = np.array([ord("a") << 8 | ord("b"), ord("x") << 8 | ord("y")])
    classes = L.class_of_leads(leads, np.array([5.0, 5.0]))
    assert classes[leads[0]] != classes[leads[1]] and (np.diff(classes) >= 0).all() and classes.max() < L.CLASSES
    counts = np.array([3, 2])
    assert sum((c + 1) / (counts.sum() + 2 + 1) for c in counts) + 1 / (counts.sum() + 2 + 1) == pytest.approx(1.0)


def test_learning_follows_the_gradient():
    block = {"lengths": np.array([40]), "codes": np.tile([0, 1], 20).astype(np.int32), "leads": np.array([1, 2]),
             "prints": np.array([11, 12], np.uint64)}
    classes = np.zeros(1 << 16, np.int64)
    classes[2] = 1
    tokens = L.Tokens(block, classes, np.array([0]))
    weights = np.zeros((L.ROWS, L.CLASSES + 1), np.float32)

    def gain() -> float:
        return float(L.log_odds(weights, tokens.rows, tokens.target).mean())

    before = gain()
    for _ in range(30):
        L.learn(weights, np.ones(L.ROWS, np.float32), np.zeros(L.ROWS, np.float32), tokens)
    assert gain() > before / 4


def test_odd_rows(odd, empty):
    got = L.model_scores(odd).collect()
    assert len(got) == odd.count() and all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in got)
    assert L.model_scores(empty).count() == 0


def test_sums_of_runs_of_any_length():
    r = np.random.default_rng(3)
    for lengths in ([1] * 300, [7], list(range(1, 400)), [1, 5000, *[3] * 290, 17, 16, 2], r.integers(1, 40, 700).tolist()):
        lengths = np.array(lengths)
        x = r.normal(size=(lengths.sum(), 5)).astype(np.float32)
        first = np.cumsum(lengths) - lengths
        want = np.add.reduceat(x.astype(float), first, axis=0)
        assert np.allclose(L.run_sums(x.copy(), first, lengths), want, atol=1e-3)
