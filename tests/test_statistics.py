"""Resampling statistics, governance tables and increments."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from panel_data import day, to_bars, walk
from pyspark.sql import functions as F

from tideline.functions.normal import norm_cdf
from tideline.operators import governance as G
from tideline.operators import inference as I
from tideline.plans import common as C
from tideline.sources import tables as T
from tideline.streaming import settle as Z


def curve(spark, returns: np.ndarray, track: str = "x"):
    eq = 1e5 * np.cumprod(np.concatenate([[1.0], 1 + returns]))
    days = pd.bdate_range("2020-01-01", periods=len(eq)).date
    return spark.createDataFrame(pd.DataFrame({"track": track, "date": days, "equity": eq}))


def test_normal_distribution(spark):
    xs = [float(x) for x in np.linspace(-8, 8, 41)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(norm_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / 2 ** 0.5) for x in xs], rel=1e-12, abs=1e-14)


def test_draws_are_blocks_and_repeat(spark):
    rets = I.daily_returns(curve(spark, np.full(120, 0.001)))
    d = I.bootstrap_draws(rets, 40, 10).toPandas().sort_values(["resample", "t"])
    again = I.bootstrap_draws(rets.repartition(3), 40, 10).toPandas().sort_values(["resample", "t"])
    assert (d["i"].to_numpy() == again["i"].to_numpy()).all()
    assert d["i"].between(0, 119).all() and (d.groupby("resample").size() == 120).all()
    step = (d["i"].diff() % 120 == 1) & (d["t"] > 0)
    assert 0.86 < step.sum() / (40 * 119) < 0.94  # about nine of ten steps stay in their block


def test_intervals_cover_the_truth_and_short_curves_are_neutral(spark):
    g = np.random.default_rng(1)
    r = g.normal(0.0008, 0.01, 400)
    both = curve(spark, r).unionByName(curve(spark, r[:3], "short"))
    ci = {x["track"]: x for x in I.bootstrap_ci(both, 200, 20).collect()}
    years = 400 / 252
    true = np.prod(1 + r) ** (1 / years) - 1
    assert ci["x"]["cagr_lo"] < true < ci["x"]["cagr_hi"] and ci["x"]["maxdd_hi"] < 0
    assert ci["short"]["cagr_lo"] == ci["short"]["sharpe_hi"] == 0.0


def test_paired_gap_tells_a_better_curve(spark):
    g = np.random.default_rng(2)
    base = g.normal(0, 0.01, 300)
    pair = I.paired_returns(curve(spark, base + 0.002 + g.normal(0, 0.001, 300)), curve(spark, base))
    gap = I.paired_gap(pair, 100, 20).first()
    assert gap["gap_annualized"] == pytest.approx(0.504, abs=0.05) and gap["p_value_gap_le_0"] == 0.0
    assert gap["gap_lo"] > 0 and gap["n_obs"] == 300
    same = I.paired_gap(I.paired_returns(curve(spark, base[:2]), curve(spark, base[:2])), 10).first()
    assert same["p_value_gap_le_0"] == 1.0 and same["n_obs"] == 0


def test_deflated_sharpe_falls_with_trials(spark):
    df = spark.createDataFrame([(1.5, 1000, n) for n in (1, 2, 10, 1000)], "sharpe_annualized double, n_obs int, n_trials int")
    out = I.deflated_sharpe(df).orderBy("n_trials").toPandas()
    p, thr = out["deflated_sharpe_p_value_significant"], out["deflated_sharpe_threshold_annualized"]
    assert thr.is_monotonic_increasing and p.is_monotonic_decreasing and thr[0] == 0.0
    sr = 1.5 / 252 ** 0.5
    assert p[0] == pytest.approx(0.5 * math.erfc(-sr * 999 ** 0.5 / (1 + sr * sr / 2) ** 0.5 / 2 ** 0.5))


def ledger(spark, rows):
    return spark.createDataFrame(rows, "track string, ticker string, entry_date date, exit_date date, trade_return_pct double, cost double")


def test_effective_sample_size(spark):
    together = [("all", f"T{i}", day("2020-01-06"), day("2020-01-31"), 0.1, 1.0) for i in range(20)]
    apart = [("none", f"T{i}", d.date(), (d + pd.Timedelta(days=4)).date(), 0.1, 1.0)
             for i, d in enumerate(pd.date_range("2020-01-06", periods=10, freq="14D"))]
    weekend = [("weekend", "W", day("2020-01-04"), day("2020-01-05"), 0.1, 1.0)]
    got = dict(I.effective_sample_size(ledger(spark, together + apart + weekend)).collect())
    assert got == {"all": pytest.approx(1.0), "none": pytest.approx(10.0), "weekend": 0.0}


def test_tax(spark):
    rows = [("a", "T", day("2020-01-06"), day("2020-03-01"), 0.5, 20000.0), ("a", "T", day("2021-01-06"), day("2021-03-01"), -0.5, 10000.0),
            ("ruin", "T", day("2020-01-06"), day("2020-03-01"), -2.0, 100000.0)]
    got = {r["track"]: r for r in I.post_tax_cagr(ledger(spark, rows)).collect()}
    assert got["a"]["total_tax"] == pytest.approx(4180.0)
    assert got["a"]["pre_tax_cagr"] == pytest.approx(1.05 ** 0.5 - 1) and got["a"]["post_tax_cagr"] == pytest.approx(1.0082 ** 0.5 - 1)
    assert got["ruin"]["post_tax_cagr"] == -1.0


def test_spa_separates_skill_from_noise(spark):
    g = np.random.default_rng(3)
    noise = [g.normal(0, 0.01, 300) for _ in range(4)]
    frames = [I.daily_returns(curve(spark, r, f"n{i}")) for i, r in enumerate(noise)]
    skill = I.daily_returns(curve(spark, noise[0] + 0.004, "skill"))
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    dull, sharp = I.spa_test(union, 100).first(), I.spa_test(union.unionByName(skill), 100).first()
    assert dull["p_consistent"] > 0.05 and sharp["p_consistent"] < 0.02
    assert dull["p_lower"] <= dull["p_consistent"] <= dull["p_upper"] and sharp["n_strategies"] == 5


def test_governance(spark):
    log = spark.createDataFrame([("m", "l", 5, None, "u"), ("m", "l", 5, None, "u"), ("m", "l", 5, 2, "u")],
                                "model string, label string, horizon_d int, threshold_q int, universe string")
    assert G.trial_count(log).first()[0] == 2 and G.trial_count(log.limit(0)).first()[0] == 1
    text = log.select(G.config_json(list(G.TRIAL_KEY))).first()[0]
    assert text == '{"horizon_d":5,"label":"l","model":"m","threshold_q":null,"universe":"u"}'
    claims = spark.createDataFrame([("k", 1, False), ("k", 2, False), ("k", 3, True), ("j", 4, False)], "key string, ts int, force boolean")
    got = {r["ts"]: r["status"] for r in G.first_claim_wins(claims, ["key"], ["ts"], "force").collect()}
    assert got == {1: "accepted", 2: "refused", 3: "accepted", 4: "accepted"}
    docs = spark.createDataFrame([("ok " + " ".join(G.REQUIRED_SECTIONS),), ("Best OF 12 and in the 100th percentile",)], "text string")
    errors = [r["errors"] for r in G.compliance_lint(docs).collect()]
    assert errors[0] == [] and len(errors[1]) == 8 and "forbidden phrase 'Best OF 12'" in errors[1]


PICKS = "pick_generated string, ticker string, horizon_days int, anchor_date date, score double, track string"


def test_settling_is_exact_and_idempotent(spark):
    a = walk("A", 60, 1)
    d = list(a["date"])
    rows = [("p1", "A", 40, d[5], 0.9, "t"), ("p1", "A", 40, d[5], 0.9, "t"), ("p2", "A", 40, d[30], 0.8, "t"),
            ("p3", "A", 10, day("2018-01-06"), 0.7, "t"), ("p4", "GHOST", 10, d[5], 0.6, "t")]
    picks = spark.createDataFrame(rows, PICKS)
    bars = to_bars(spark, a)
    new = Z.settle_picks(picks, bars)
    got = new.collect()
    assert [(r["pick_generated"], r["exit_date"]) for r in got] == [("p1", d[45])]
    assert got[0]["realized_ret"] == pytest.approx(a["close"][45] / a["close"][5] - 1)
    assert Z.settle_picks(picks, bars, new).count() == 0
    assert Z.settle_counts(picks, None, new).first() == (5, 1, 3)
    assert Z.append_new(new, new, Z.PICK_KEY).count() == 1


def test_streams_equal_the_batch_and_survive_a_rerun(spark, tmp_path):
    a, b = walk("A", 60, 1), walk("B", 60, 2)
    bars = to_bars(spark, a, b)
    picks = spark.createDataFrame([(f"p{i}", t, 10, f["date"][i], 0.5, "t") for t, f in (("A", a), ("B", b)) for i in (3, 45, 55)], PICKS)
    base = str(tmp_path)
    cutoff = a["date"][50]

    def run():
        Z.settle_stream(spark, f"{base}/bars", picks, f"{base}/out", f"{base}/ck").awaitTermination()
        return Z.read_realized(spark, f"{base}/out").count()

    bars.filter(F.col("date") <= F.lit(cutoff)).coalesce(1).write.mode("append").parquet(f"{base}/bars")
    assert run() == 2
    assert run() == 2
    bars.filter(F.col("date") > F.lit(cutoff)).coalesce(1).write.mode("append").parquet(f"{base}/bars")
    assert run() == 4 == Z.settle_picks(picks, bars).count()


def test_a_bar_that_is_emitted_again_does_not_shift_the_exit(spark, tmp_path):
    base, a = str(tmp_path), walk("A", 10, 3)
    bars = to_bars(spark, a)
    picks = spark.createDataFrame([("p", "A", 4, a["date"][1], 0.5, "t")], PICKS)
    bars.filter(F.col("date") <= F.lit(a["date"][3])).coalesce(1).write.mode("append").parquet(f"{base}/bars")
    again = bars.filter(F.col("date") == F.lit(a["date"][3])).withColumn("close", F.lit(14.0))
    Z.settle_stream(spark, f"{base}/bars", picks, f"{base}/out", f"{base}/ck").awaitTermination()
    for part in (again, bars.filter(F.col("date") > F.lit(a["date"][3]))):
        part.coalesce(1).write.mode("append").parquet(f"{base}/bars")
        Z.settle_stream(spark, f"{base}/bars", picks, f"{base}/out", f"{base}/ck").awaitTermination()
    got = Z.read_realized(spark, f"{base}/out").collect()
    assert [(r["exit_date"], r["exit_close"]) for r in got] == [(a["date"][5], pytest.approx(a["close"][5]))]


def test_versions_are_switched_when_written(spark, tmp_path):
    base, key = str(tmp_path / "v"), ["k"]
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert Z.newest_version(spark, base) is None
    Z.append_version(spark, base, first, key)
    Z.append_version(spark, base, first.unionByName(spark.createDataFrame([(3, "c")], "k int, v string")), key)
    assert sorted(r["k"] for r in Z.newest_version(spark, base).collect()) == [1, 2, 3]
    (tmp_path / "v" / "version=000009").mkdir()  # a write that did not end
    assert Z.newest_version(spark, base).count() == 3


def test_corrected_bars_replace_old_ones(spark, tmp_path):
    base = str(tmp_path)
    bars = to_bars(spark, walk("A", 5, 1)).withColumn("seq", F.lit(0))
    fix = bars.limit(1).withColumn("close", F.lit(7.0)).withColumn("seq", F.lit(1))
    for part in (bars, fix):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        Z.bars_dedupe_stream(spark, f"{base}/in", f"{base}/store", f"{base}/ck").awaitTermination()
    now = Z.bars_current(spark, f"{base}/store")
    assert now.count() == 5 and now.filter("close = 7.0").count() == 1


def test_the_newest_emission_is_found_without_a_sort(spark, tmp_path):
    """A later batch wins, within it the larger seq, a null seq first; nulls of the winner stay. Numbers only, so the log is hashed."""
    cols = "ticker string, date date, open double, high double, low double, close double, volume double, seq int"
    for batch, rows in enumerate(([("A", 1.0, 9), ("B", 2.0, None), ("C", 3.0, -5)], [("A", 4.0, 0), ("C", 5.0, -1), ("C", 6.0, -2**31), ("D", None, 7)],
                                  [("B", 7.0, -3), ("B", 8.0, None)])):
        data = [(t, day("2020-01-02"), None, c, c, c, 1.0, s) for t, c, s in rows]
        spark.createDataFrame(data, cols).write.parquet(f"{tmp_path}/log/batch={batch}")
    now = Z.bars_current(spark, f"{tmp_path}/log")
    plan = now._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "HashAggregate" in plan
    assert sorted((r["ticker"], r["open"], r["close"]) for r in now.collect()) == [("A", None, 4.0), ("B", None, 7.0), ("C", None, 5.0)]


def test_the_feed_does_not_make_the_panel_for_every_delivery(spark):
    plan = T.raw_bars(spark, "/root/testdata/sf0.001", C.bars(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
