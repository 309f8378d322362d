"""Windows around anchors: what they cost, and that tickers of one batch do not meet."""

from __future__ import annotations

import numpy as np
import pytest
from panel_data import to_bars, walk

from tideline.config import StudyConfig
from tideline.operators import anchors as A
from tideline.operators import features as X
from tideline.session import tune

SMALL = StudyConfig(horizons=(2, 5), thresholds=(0.1,), warmup=20, ma_window=10, adv_window=5)


def executed(df) -> str:
    tune(df.sparkSession)
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_are_put_in_order_once_and_windows_are_not_walked_in_the_plan(spark):
    bars = to_bars(spark, walk("A", 300, 1))
    marked = executed(A.mark_anchors(bars, SMALL))
    assert marked.count("Sort [") == 1 and marked.count("Exchange ") == 1
    labels = executed(A.build_labels(bars, SMALL))
    assert labels.count("Sort [") == 1 and "zip_with" not in labels and "ObjectHashAggregate" not in labels
    features = executed(X.compute_features(bars, A.anchor_frame(bars), bars.select("date", "close")))
    assert "zip_with" not in features and "-199" not in features and "skewness" not in features


def test_tickers_of_a_batch_do_not_meet(spark):
    frames = [walk(t, n, i) for i, (t, n) in enumerate([("A", 300), ("B", 253), ("C", 320), ("D", 40)])]
    frames[2].loc[100:103, "close"] = np.nan  # to null below
    market = to_bars(spark, walk("M", 330, 9)).select("date", "close")

    def features(*some):
        bars = to_bars(spark, *some).replace(float("nan"), None).coalesce(1)
        anchors = bars.groupBy("ticker").agg({"date": "max", "close": "count"}).selectExpr("ticker", "`max(date)` anchor_date").join(
            spark.createDataFrame([(f["ticker"].iloc[0], i) for f in some for i in {251, 252, len(f) - 1} if i < len(f)], "ticker string, anchor_idx int"), "ticker")
        return {(r["ticker"], r["anchor_idx"]): r.asDict() for r in X.compute_features(bars, anchors, market).collect()}

    together, alone = features(*frames), {}
    for f in frames:
        alone |= features(f)
    assert set(together) == set(alone) == {("A", 251), ("A", 252), ("A", 299), ("B", 251), ("B", 252), ("C", 251), ("C", 252), ("C", 319)}
    for k in alone:
        assert all(together[k][c] == pytest.approx(alone[k][c]) for c in X.FEATURE_COLS)

    def labels(*some):
        return {(r["ticker"], r["anchor_idx"]): r.asDict() for r in A.build_labels(to_bars(spark, *some).replace(float("nan"), None).coalesce(1), SMALL).collect()}

    together, alone = labels(*frames), {}
    for f in frames:
        alone |= labels(f)
    assert together == alone and {t for t, _ in alone} == {"A", "B", "C", "D"}


def test_extremes_pass_over_missing_closes(spark):
    df = walk("A", 60, 3)
    df.loc[31:32, "close"] = np.nan
    got = {r["anchor_idx"]: r for r in A.build_labels(to_bars(spark, df).replace(float("nan"), None), SMALL).collect()}
    c = df["close"].to_numpy()
    with np.errstate(all="ignore"):
        for i, r in got.items():
            near = c[i + 1:i + 6]
            assert r["fwd_mfe_5d"] == pytest.approx(max(0.0, np.nanmax(near) / c[i] - 1)) and r["fwd_mae_5d"] == pytest.approx(min(0.0, np.nanmin(near) / c[i] - 1))
            assert r["fwd_ret_2d"] == (None if np.isnan(c[i + 2]) else pytest.approx(c[i + 2] / c[i] - 1))
            assert r["resolution_date_2d"] == df["date"][i + 2]
    assert any(np.isnan(c[i + 1:i + 6]).any() for i in got)


def test_curves_go_to_the_draws(spark):
    from tideline.operators.inference import resampled

    returns = spark.createDataFrame([(t, float(i), i, 30) for t in "ab" for i in range(30)], "track string, r double, i int, n bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sizes shall not decide it
    try:
        plan = executed(resampled(returns, 50, 5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan


def test_raw_bars_make_the_panel_once(spark):
    from tideline.sources.bars import bars_normalize
    from tideline.sources.tables import raw_bars

    raw = raw_bars(spark, "/root/testdata/sf0.001")
    plan = executed(bars_normalize(raw))
    assert plan.count("FileScan parquet") == 1 and "Union" not in plan and "SortAggregate" not in plan
    r = {x["seq"]: x for x in raw.orderBy("ticker", "date").limit(3).collect()}
    assert r[2]["Close"] is None and r[0]["Close"] is not None and raw.count() == 3 * raw.filter("seq = 0").count()
