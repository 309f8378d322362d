"""All 40 features against a direct numpy statement of their definitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from panel_data import to_bars, walk
from pyspark.sql import functions as F

from tideline.operators import features as X
from tideline.operators import vectors as V


def slope(y: np.ndarray) -> float:
    x = np.arange(len(y)) - (len(y) - 1) / 2
    return float((x * (y - y.mean())).sum() / (x * x).sum())


def definition(c: np.ndarray, v: np.ndarray, m: np.ndarray, i: int) -> dict[str, float]:
    w, q = c[i - 251:i + 1], v[i - 251:i + 1]
    r = np.log(w[1:] / w[:-1])
    mr = np.log(m[i - 62:i + 1] / m[i - 63:i])
    lp = np.log(np.maximum(w, 1e-9))
    peak = np.maximum.accumulate(w / w[0]) * w[0]
    out = {f"ret_{k}d": np.log(w[-1] / w[-1 - b]) if w[-1 - b] > 0 else 0.0 for k, b in ((1, 1), (5, 5), (21, 21), (63, 63), (126, 126), (252, 251))}
    out |= {f"vol_{k}d": r[-n:].std() * 252 ** 0.5 for k, n in ((21, 21), (63, 63), (252, 251))}
    out["max_dd_252d"] = (w / peak - 1).min()
    out["pct_from_252d_high"] = w[-1] / w.max() - 1
    out["current_dd_from_peak"] = w[-1] / peak[-1] - 1
    out["days_since_252d_high"] = 251 - w.argmax()
    out["pct_from_21d_high"] = w[-1] / w[-21:].max() - 1
    out |= {f"ratio_ma{n}": w[-1] / w[-n:].mean() for n in (20, 50, 200)}
    ld = np.log1p(w * q)
    out["log_dollar_vol_z252"] = (ld[-1] - ld.mean()) / (ld.std() + 1e-9)
    out["vol_ratio_20_252"] = q[-20:].mean() / (q.mean() + 1e-9)
    out["vol_trend_slope_60d"] = slope(np.log1p(q[-60:]))
    z = (r - r.mean()) / r.std()
    out["skew_252d"], out["kurt_252d"] = (z ** 3).mean(), (z ** 4).mean() - 3
    k = np.cov(r[-63:], mr)
    out["beta_spy_63d"] = k[0, 1] / (k[1, 1] + 1e-12)
    out["above_ma200_frac_252d"] = sum(w[j] > w[j - 199:j + 1].mean() for j in range(199, 252)) / 252
    out["up_day_frac_63d"] = (r[-63:] > 0).mean()
    out["ret_252d_minus_21d"] = out["ret_252d"] - out["ret_21d"]
    out["vol_21d_div_252d"] = out["vol_21d"] / (out["vol_252d"] + 1e-9)
    out["slope_20"], out["slope_60"] = slope(lp[-20:]), slope(lp[-60:])
    out["slope_accel"] = out["slope_20"] - out["slope_60"]
    y = lp[-60:]
    res = y - (y.mean() + out["slope_60"] * (np.arange(60) - 29.5))
    out["trendline_residual_z_60"] = res[-1] / (res.std() + 1e-12)
    out["r2_log_60"] = 1 - (res ** 2).sum() / (((y - y.mean()) ** 2).sum() + 1e-12)
    tail = w[-120:]
    falls, armed = 0, True
    for x, p in zip(tail, np.maximum.accumulate(tail)):
        if armed and x / p - 1 <= -0.05:
            falls, armed = falls + 1, False
        elif not armed and x / p - 1 >= -0.005:
            armed = True
    out["dd_count_5pct_120d"] = falls
    s = w[-60:]
    out["days_since_60d_high"] = 59 - s.argmax()
    out["pct_from_60d_high"], out["pct_from_60d_low"] = w[-1] / s.max() - 1, w[-1] / s.min() - 1
    near = lambda j: np.delete(s[j - 2:j + 3], 2)
    out["swing_count_60d"] = sum(s[j] > near(j).max() or s[j] < near(j).min() for j in range(2, 58))
    out["bb_width_pct_20"] = 4 * (w[-20:].std() + 1e-12) / w[-20:].mean()
    out["vol_of_vol_ratio_30_120"] = (r[-30:].std() + 1e-12) / (r[-120:-30].std() + 1e-12)
    out["ret_vol_corr_20"] = np.corrcoef(r[-20:], q[-20:])[0, 1]
    return out


def market_for(df: pd.DataFrame, m: pd.DataFrame) -> np.ndarray:
    s = pd.Series(m["close"].to_numpy(), index=m["date"]).reindex(df["date"])
    return s.ffill().bfill().to_numpy()


@pytest.fixture(scope="module")
def computed(spark):
    a, b = walk("A", 300, 1), walk("B", 280, 2, "2018-02-01").drop(index=[100, 101, 200]).reset_index(drop=True)
    m = walk("M", 340, 3, "2018-01-15").drop(index=[50, 51, 120]).reset_index(drop=True)
    picks = [("A", 251), ("A", 299), ("B", 260), ("B", 276), ("A", 250), ("C", 260)]
    frames = {"A": a, "B": b}
    rows = [(t, (frames[t]["date"].iloc[i] if t in frames else a["date"].iloc[i]), i) for t, i in picks]
    anchors = spark.createDataFrame(rows, "ticker string, anchor_date date, anchor_idx int")
    got = X.compute_features(to_bars(spark, a, b), anchors, spark.createDataFrame(m[["date", "close"]]))
    return frames, m, got.toPandas().set_index(["ticker", "anchor_idx"])


def test_features_match_their_definition(computed):
    frames, m, got = computed
    # The row at 250 has no full window and ticker C has no bars.
    assert sorted(got.index) == [("A", 251), ("A", 299), ("B", 260), ("B", 276)]
    for (t, i), row in got.iterrows():
        df = frames[t]
        want = definition(df["close"].to_numpy(), df["volume"].to_numpy(), market_for(df, m), i)
        assert set(want) == set(X.FEATURE_COLS)
        for c in X.FEATURE_COLS:
            assert row[c] == pytest.approx(want[c], rel=1e-9, abs=1e-10), (t, i, c)


def test_zero_prices_spoil_only_what_depends_on_them(spark):
    df = walk("A", 320, 7)
    df.loc[60:64, "close"] = 0.0
    df.loc[250:252, "close"] = 0.0
    idx = [260, 300, 312, 319]  # 312 starts its window on a zero
    a = spark.createDataFrame([("A", df["date"].iloc[i], i) for i in idx], "ticker string, anchor_date date, anchor_idx int")
    got = X.compute_features(to_bars(spark, df), a, spark.createDataFrame(walk("M", 320, 8)[["date", "close"]]))
    m = walk("M", 320, 8)["close"].to_numpy()
    rows = {r["anchor_idx"]: r for r in got.collect()}
    with np.errstate(all="ignore"):
        for i in idx:
            want = definition(df["close"].to_numpy(), df["volume"].to_numpy(), m, i)
            for c in X.FEATURE_COLS:
                value = want[c] if np.isfinite(want[c]) else 0.0
                assert rows[i][c] == pytest.approx(value, rel=1e-8, abs=1e-9), (i, c)


def test_flat_series_and_missing_market_give_zeros(spark):
    df = walk("F", 260, 4)
    df["close"], df["volume"] = 64.0, 1000.0
    a = spark.createDataFrame([("F", df["date"].iloc[255], 255)], "ticker string, anchor_date date, anchor_idx int")
    row = X.compute_features(to_bars(spark, df), a).first()
    for c in ("vol_21d", "skew_252d", "kurt_252d", "beta_spy_63d", "ret_vol_corr_20", "max_dd_252d", "swing_count_60d",
              "slope_60", "above_ma200_frac_252d"):
        assert row[c] == 0.0, c
    assert row["ratio_ma200"] == 1.0
    assert row["days_since_252d_high"] == 251.0  # the earliest of equal maxima


def test_market_beta_of_itself_is_one(spark):
    df = walk("A", 260, 5)
    a = spark.createDataFrame([("A", df["date"].iloc[259], 259)], "ticker string, anchor_date date, anchor_idx int")
    row = X.compute_features(to_bars(spark, df), a, spark.createDataFrame(df[["date", "close"]])).first()
    assert row["beta_spy_63d"] == pytest.approx(1.0, abs=1e-6)


def test_chart_and_volume_vectors(spark):
    df, twin = walk("A", 255, 6), walk("A", 255, 6)
    twin["ticker"], twin["close"] = "T", twin["close"] * 4
    rows = [(t, df["date"].iloc[254], 254) for t in ("A", "T")]
    a = spark.createDataFrame(rows, "ticker string, anchor_date date, anchor_idx int")
    bars = to_bars(spark, df, twin)
    charts = {r["ticker"]: r for r in V.chart_vectors(bars, a).collect()}
    assert charts["A"]["fingerprint"] == charts["T"]["fingerprint"]  # the level does not matter
    c = df["close"].to_numpy()[3:]
    want = np.clip((np.log(c / c[0]) - np.log(0.1)) / (np.log(11) - np.log(0.1)), 0, 1)
    assert np.allclose(charts["A"]["chart"], want)
    z = np.array(V.volume_vectors(bars, a).filter("ticker = 'A'").first()["volume_vector"])
    lv = np.log1p(df["volume"].to_numpy()[3:])
    assert np.allclose(z, (lv - lv.mean()) / (lv.std() + 1e-9))
    flat = spark.range(1).select(V.chart_norm(F.array(F.lit(0.0), F.lit(5.0))).alias("n"), V.chart_norm(
        F.array(F.lit(1.0), F.lit(2.0)), 5.0, 5.0).alias("d")).first()
    assert flat["n"][0] == flat["n"][1] and flat["d"] == [0.5, 0.5]
