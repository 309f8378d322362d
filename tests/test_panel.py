"""Cleaning, anchors and labels against plain loops over tiny series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from panel_data import day, to_bars, walk
from pyspark.sql import functions as F

from tideline.config import StudyConfig
from tideline.operators import anchors as A
from tideline.operators import quality as Q
from tideline.sources import bars as B, text as TX

SMALL = StudyConfig(horizons=(3, 7), thresholds=(0.02, 0.05), warmup=20, ma_window=15, adv_window=5)


def expected_anchors(df: pd.DataFrame, cfg: StudyConfig) -> list[int]:
    keep = [i for i in range(len(df)) if cfg.warmup <= i < len(df) - cfg.max_horizon - 1]
    weeks: dict = {}
    for i in keep:
        weeks.setdefault(df["date"].iloc[i].isocalendar()[:2], []).append(i)
    return [v[-1] for v in weeks.values() if len(v) >= cfg.min_week_bars]


def test_labels_match_a_loop_over_each_series(spark):
    frames = [walk("A", 80, 1), walk("B", 65, 2, "2018-03-07")]
    frames[1] = frames[1].drop(index=[30, 31, 44]).reset_index(drop=True)
    got = A.build_labels(to_bars(spark, *frames), SMALL).toPandas().set_index(["ticker", "anchor_idx"])
    n = 0
    for df in frames:
        t, c, v = df["ticker"].iloc[0], df["close"].to_numpy(), df["volume"].to_numpy()
        for i in expected_anchors(df, SMALL):
            n += 1
            row = got.loc[(t, i)]
            assert row["anchor_date"] == df["date"].iloc[i]
            assert row["ratio_ma250"] == pytest.approx(c[i] / c[i - 14:i + 1].mean())
            assert row["adv20_usd"] == pytest.approx((c * v)[i - 4:i + 1].mean())
            for h in SMALL.horizons:
                ahead = c[i + 1:i + h + 1] / c[i] - 1
                assert row[f"fwd_ret_{h}d"] == pytest.approx(ahead[-1])
                assert row[f"fwd_mfe_{h}d"] == pytest.approx(max(0, ahead.max()))
                assert row[f"fwd_mae_{h}d"] == pytest.approx(min(0, ahead.min()))
                assert row[f"resolution_date_{h}d"] == df["date"].iloc[i + h]
                assert row[f"ret_{h}d_ge_5pct"] == int(ahead[-1] >= 0.05)
    assert len(got) == n > 10


def test_zero_prices_drop_the_anchor_but_keep_a_total_loss(spark):
    df = walk("Z", 70, 3)
    df.loc[40:48, "close"] = 0.0
    got = A.build_labels(to_bars(spark, df), SMALL).toPandas().set_index("anchor_idx")
    assert (got["anchor_close"] > 0).all()
    lost = [i for i in expected_anchors(df, SMALL) if i < 40 <= i + 7 <= 48]
    assert lost
    for i in lost:
        assert got.loc[i, "fwd_ret_7d"] == -1.0
        assert np.isnan(got.loc[i, "fwd_log_ret_7d"])
        assert got.loc[i, "ret_7d_ge_2pct"] == 0


def test_too_short_history_gives_no_anchor(spark):
    assert A.build_labels(to_bars(spark, walk("S", 28, 4)), SMALL).count() == 0
    assert Q.min_history_filter(to_bars(spark, walk("S", 28, 4), walk("L", 29, 5)), 20, 7).select("ticker").distinct().count() == 1


def test_latest_candidates_use_the_newest_bar_without_a_future(spark):
    df = walk("A", 60, 6)
    df.loc[59, "close"] = df["close"].iloc[45:59].mean() * 3
    got = A.latest_candidates(to_bars(spark, df, walk("B", 10, 7)), "2030-01-01", SMALL).collect()
    assert [(r["ticker"], r["anchor_idx"]) for r in got] == [("A", 59)]
    dollars = (df["close"] * df["volume"]).iloc[-5:].mean()
    assert got[0]["adv20_usd"] == pytest.approx(dollars)


def test_normalize_keeps_the_last_emission_and_drops_empty_rows(spark):
    rows = [("A", day("2020-01-02"), 1.0, 10.0, 0), ("A", day("2020-01-02"), 1.0, 11.0, 1),
            ("A", day("2020-01-03"), 2.0, None, 0), ("A", day("2020-01-06"), None, None, 0), ("B", day("2020-01-02"), 3.0, 5.0, 0)]
    raw = spark.createDataFrame(rows, "ticker string, date date, Open double, Close double, seq int")
    got = {(r["ticker"], r["date"].isoformat()): r["close"] for r in B.bars_normalize(raw).collect()}
    assert got == {("A", "2020-01-02"): 11.0, ("B", "2020-01-02"): 5.0}


def test_sink_skips_what_is_stored(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars = to_bars(spark, walk("A", 5, 1), walk("B", 5, 2))
    first = B.bars_sink(bars.filter("ticker = 'A'"), path, buckets=2).first()
    again = B.bars_sink(bars, path, buckets=2).first()
    assert (first["fetched"], first["total_stored"]) == (1, 1)
    assert (again["requested"], again["fetched"], again["total_stored"]) == (2, 1, 2)
    assert B.bars_source(spark, path).count() == 10
    files = str(tmp_path / "files")
    bars.filter("ticker = 'A'").drop("ticker").coalesce(1).write.parquet(files)
    assert B.bars_source(spark, files).filter("ticker like 'part-%'").count() == 5


@pytest.mark.parametrize("name, symbols", [
    ("Acme Corp II  (ACM, ACM-UN, ACM-WT)  (CIK 0000000017)", ["ACM", "ACM-UN", "ACM-WT"]),
    ("No Symbol Ltd  (CIK 0000000018)", []),
    ("lower (abc) (CIK 1)", []),
    ("Dotted (BRK.B) and (X1)", ["BRK.B", "X1"]),
    ("", []),
])
def test_extract_tickers(spark, name, symbols):
    assert spark.range(1).select(Q.extract_tickers(F.lit(name)).alias("t")).first()["t"] == symbols


def test_delisting_signs(spark):
    live, dead, crash, short = walk("LIVE", 40, 1), walk("DEAD", 40, 2), walk("CRASH", 40, 3), walk("SHORT", 19, 4)
    dead.loc[28:, "volume"] = 0
    crash.loc[39, "close"] = 0.05
    end = live["date"].iloc[-1].isoformat()
    got = {r["ticker"]: r["reasons"] for r in Q.delisting_classifier(to_bars(spark, live, dead, crash, short), end).collect()}
    assert got == {"DEAD": "zerovol12", "CRASH": "subdime_close|bagel_drop"}


def test_fingerprints_see_one_changed_price(spark):
    a, b = walk("A", 30, 1), walk("B", 30, 2)
    old = Q.partition_fingerprint(to_bars(spark, a, b))
    b2, c = b.copy(), walk("C", 30, 3)
    b2.loc[7, "close"] += 0.01
    new = Q.partition_fingerprint(to_bars(spark, b2, c))
    assert dict(Q.snapshot_diff(old, new).collect()) == {"A": "missing", "B": "changed", "C": "added"}
    assert Q.combined_fingerprint(old).first() != Q.combined_fingerprint(new).first()
    assert Q.combined_fingerprint(old).first() == Q.combined_fingerprint(Q.partition_fingerprint(to_bars(spark, b, a))).first()


def test_text_sources(spark, tmp_path):
    (tmp_path / "seed.txt").write_text("# head\n\n abc \nXyZ\n  # tail\n")
    assert sorted(r["ticker"] for r in TX.seed_list_source(spark, str(tmp_path / "seed.txt")).collect()) == ["ABC", "XYZ"]
    (tmp_path / "t.jsonl").write_text('{"model": "a", "horizon_d": 5}\n\nnot json\n{"model": "b"}\n')
    assert TX.trial_log_source(spark, str(tmp_path / "t.jsonl")).count() == 2
    (tmp_path / "2024-01-05.csv").write_text(
        "ticker,anchor_date,anchor_close,adv20_usd,score,pick_generated,horizon_days,track\nA,2024-01-04,1,2,0.5,,40,x\n")
    assert TX.picks_source(spark, str(tmp_path / "2024-01-05.csv")).first()["pick_generated"] == "2024-01-05"


def test_universe(spark):
    d = spark.createDataFrame([("A", "N", "N"), ("B", "Y", "N"), ("C", "N", "y"), ("D.X", "N", "N"), ("E", "N", None), (None, "N", "N")],
                              "Symbol string, `Test Issue` string, ETF string")
    u = Q.universe_filter(d)
    assert sorted(r["ticker"] for r in u.collect()) == ["A", "E"]
    old = spark.createDataFrame([("A", False), ("Q", False)], "ticker string, active boolean")
    assert dict(Q.universe_build(u, old).collect()) == {"A": True, "E": True, "Q": False}
