"""The registered queries: contract, and a sample against SQL on the smallest tables.

TIDELINE_ALL=1 compares every query; tests/compare.py does the same as a script.
"""

from __future__ import annotations

import os
import re

import pytest
from compare import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as E
from tideline.operators import anchors as A
from tideline.operators import models as ML
from tideline.operators import splits as S
from tideline.operators import vectors as V
from tideline.operators.features import FEATURE_COLS
from tideline.plans import queries_study as Q
from tideline.session import cut
from tideline.sources.tables import panel_bars

SF = "/root/testdata/sf0.001"
SAMPLE = ["a02_bars_normalize", "b10_snapshot_diff", "b09_partition_fingerprint", "c03_weekly_anchors", "c12_threshold_grid",
          "e01_align_market", "f03_chart_fingerprint", "h02_purge", "k12_trade_ledger_realistic", "l01_compute_summary",
          "n02_first_claim_wins", "n03_compliance_lint", "o01_settle_picks"]


def test_every_oracle_has_a_query():
    queries, oracles = E.queries(), E.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 120
    own = {q for q in queries if not re.match(r"op\d+_|pipeline$", q)}  # without the document operators
    assert own - set(oracles) == {
        "f05_vector_explain", "i02_pca", "i07_lr_baseline", "i08_gbt_vectors", "i09_gbt_engineered",
        "i10_score_folds", "l12_leaderboard_fitted", "n04_report_card_rows", "o03_weekly_forward_picks"}


@pytest.mark.parametrize("name", sorted(E.oracle_sql()) if os.environ.get("TIDELINE_ALL") else SAMPLE)
def test_query_matches_sql(spark, name):
    problem, rows = compare(spark, duck(SF), E.queries()[name], E.oracle_sql()[name], SF)
    assert problem is None and rows > 0


def test_tracks_score_every_test_row_of_sound_folds(spark):
    """Small models (the registered queries fit the full ones): keys, ranges, and no fold without enough training rows."""
    cfg = ML.ModelConfig(pca_dim=8, lr_iterations=50, trees=5, max_depth=3, min_leaf_rows=5)
    rows = cut(Q._training(spark, "/root/testdata/sf0.01"))
    scores = cut(ML.score_folds(rows, "y", Q.YEARS, Q.H, min_train=200, cfg=cfg))
    sizes = {r["fold_year"]: r for r in S.fold_sizes(S.yearly_folds(rows, Q.YEARS, Q.H), "y").collect()}
    sound = {y for y, r in sizes.items() if r["n_train"] >= 200 and min(r["n_pos"], r["n_neg"]) >= 10 and r["n_test"]}
    got = {(r["track"], r["fold_year"]): r for r in scores.groupBy("track", "fold_year").agg(
        F.count("*").alias("n"), F.count_distinct("ticker", "anchor_date").alias("keys"), F.min("score").alias("lo"),
        F.max("score").alias("hi")).collect()}
    assert len(sound) > 1 and set(got) == {(t, y) for t in ML.TRACKS for y in sound}
    for (_, year), r in got.items():
        assert r["n"] == r["keys"] == sizes[year]["n_test"] and 0 <= r["lo"] <= r["hi"] <= 1


def test_calibration_is_monotone(spark):
    cfg = ML.ModelConfig(trees=5, max_depth=3, min_leaf_rows=5)
    train = spark.range(400).select(
        F.concat(F.lit("T"), "id").alias("ticker"), F.to_date(F.lit("2001-01-05")).alias("anchor_date"), (F.col("id") % 3 == 0).cast("int").alias("y"),
        *[((F.col("id") * (i + 3)) % 17 + (F.col("id") % 3 == 0).cast("int") * 4).cast("double").alias(c) for i, c in enumerate(FEATURE_COLS)])
    fit = ML.fit_track(cut(train), "y", "gbt_engineered", cfg)
    raw = fit.classifier.transform(ML.track_features(train, fit.track, fit.bases)).select("ticker", ML.positive("probability").alias("raw"))
    pairs = sorted((r["raw"], r["score"]) for r in ML.score_track(fit, train).join(raw, "ticker").collect())
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(pairs, pairs[1:])) and pairs[0][1] < pairs[-1][1]


def test_the_linear_track_makes_no_features_it_does_not_see(spark):
    """The anchors and labels are those of the rows with features; both vectors come from one cut of the windows."""
    d = "/root/testdata/sf0.001"
    keys = ["ticker", "anchor_date", "anchor_idx", "y", "chart", "volume_vector"]
    lean, whole = Q._training(spark, d, engineered=False), Q._training(spark, d)
    assert "ret_1d" not in lean.columns and "ret_1d" in whole.columns
    rows = sorted(map(repr, lean.select(keys).collect()))
    assert rows and rows == sorted(map(repr, whole.select(keys).collect()))
    bars = panel_bars(spark, d)
    a = A.anchor_frame(bars)
    apart = V.chart_vectors(bars, a).select("ticker", "anchor_date", "chart").join(V.volume_vectors(bars, a), ["ticker", "anchor_date"])
    cols = ["ticker", "anchor_date", "chart", "volume_vector"]
    assert sorted(map(repr, V.window_vectors(bars, a).select(cols).collect())) == sorted(map(repr, apart.select(cols).collect()))
