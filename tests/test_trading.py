"""Folds, selection, ledger and equity on small hand-made frames."""

from __future__ import annotations

import random
from dataclasses import replace

import pandas as pd
import pytest
from panel_data import day, to_bars, walk
from pyspark.sql import functions as F

from tideline.config import LedgerConfig, StudyConfig
from tideline.operators import anchors as A
from tideline.operators import ledger as K
from tideline.operators import metrics as M
from tideline.operators import ranking as R
from tideline.operators import splits as S
from tideline.operators.features import compute_features
from tideline.operators.joins import next_bar_join, per_seed
from tideline.plans import common as C
from tideline.plans import study as ST

PICK = "track string, ticker string, anchor_date date, resolution_date date, anchor_close double, adv20_usd double, score double"


def pick(t, a, r, close=10.0, adv=1e9, score=1.0, track="x"):
    return (track, t, day(a), day(r), close, adv, score)


def ledger(picks, bars, cfg=LedgerConfig()):
    return K.trade_ledger(K.purchases(picks, bars, cfg), bars, cfg)


def flat_bars(spark, ticker: str, prices: dict[str, float]):
    rows = [(ticker, day(d), p, p, p, p, 1.0) for d, p in prices.items()]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


def test_folds_never_leak(spark):
    rows = [(f"T{i}", d.date(), (d + pd.Timedelta(days=56)).date()) for i in range(4) for d in pd.date_range("2017-01-06", "2020-12-25", freq="7D")]
    a = spark.createDataFrame(rows, "ticker string, anchor_date date, resolution_date_40d date")
    folds = S.yearly_folds(a, [2016, 2018, 2019, 2020], 40, purge=False)
    sizes = {r["fold_year"]: r for r in S.fold_sizes(folds).collect()}
    assert 2016 not in sizes and sizes[2019]["n_purged"] > 0
    bad = S.leakage_violations(S.drop_empty_folds(folds), 40).collect()
    assert len(bad) == 3 and all(r["future_rows"] == r["overlap_rows"] == 0 < r["train_rows"] for r in bad)
    assert S.embargo_days(40) == 64
    assert S.fold_years([2019, 2020, 2021], 2020) == [2019, 2021]
    assert S.fold_years([2019, 2020, 2021], 2020, unlock=True) == [2019, 2021, 2020]


def test_topk_ties_and_hot_dates(spark):
    rows = [pick(f"T{i:03d}", "2020-01-03", "2020-02-03", score=float(i // 2)) for i in range(200)]
    top = R.weekly_topk(spark.createDataFrame(rows, PICK), 3)
    assert [(r["ticker"], r["rank"]) for r in top.orderBy("rank").collect()] == [("T198", 1), ("T199", 2), ("T196", 3)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # rows are pruned before the shuffle


def test_held_tickers_are_not_bought_again(spark):
    rows = [pick("A", "2020-01-03", "2020-02-03"), pick("A", "2020-01-10", "2020-02-10"), pick("A", "2020-02-03", "2020-03-03"),
            pick("A", "2020-02-10", "2020-03-10"), pick("A", "2020-01-10", "2020-02-10", track="y"), pick("B", "2020-01-10", "2020-02-10")]
    got = R.no_overlap_selection(R.weekly_topk(spark.createDataFrame(rows, PICK), 9))
    # The second pick is blocked and does not block the third one in turn.
    assert sorted((r["track"], r["ticker"], r["anchor_date"].isoformat()) for r in got.collect()) == [
        ("x", "A", "2020-01-03"), ("x", "A", "2020-02-03"), ("x", "B", "2020-01-10"), ("y", "A", "2020-01-10")]


def test_the_next_candidate_moves_up_for_a_held_one(spark):
    """One place a week: A is held over three weeks, so B, then C come up; A is bought again from its exit on."""
    weeks = ["2020-01-03", "2020-01-10", "2020-01-17", "2020-01-24"]
    bars = to_bars(spark, *[walk(t, 40, i, "2020-01-01").assign(close=10.0) for i, t in enumerate("ABCD")])
    rows = [pick(t, w, (pd.Timestamp(w) + pd.Timedelta(days=21)).date().isoformat(), score=float(9 - i))
            for w in weeks for i, t in enumerate("ABCD")]
    got = ledger(spark.createDataFrame(rows, PICK), bars, LedgerConfig(max_new_per_week=1)).orderBy("entry_date").collect()
    assert [(r["entry_date"].isoformat(), r["ticker"]) for r in got] == list(zip(weeks, "ABCA"))


def held_by_walking(rows, k):
    """Day after day over plain lists: (track, day, ticker, free, score) -> what is bought."""
    out = set()
    for track in {r[0] for r in rows}:
        held = {}
        for day_ in sorted({r[1] for r in rows if r[0] == track}):
            held, n = {t: f for t, f in held.items() if f > day_}, 0
            for _, _, t, free, _ in sorted((r for r in rows if r[:2] == (track, day_)), key=lambda r: (-r[4], r[2])):
                if n < k and t not in held:
                    held[t], n = free, n + 1
                    out.add((track, day_, t))
    return out


@pytest.mark.parametrize(("k", "seed"), [(1, 1), (2, 2), (5, 3)])
def test_reach_and_selection_equal_a_walk(spark, k, seed):
    g = random.Random(seed)
    first = day("2020-01-03")
    rows = [(track, first + pd.Timedelta(days=7 * w), f"T{i}", first + pd.Timedelta(days=7 * w + g.choice([3, 7, 10, 30, 90])), round(g.random(), 2))
            for track in "xy" for w in range(30) for i in range(25) if g.random() < 0.8]
    df = spark.createDataFrame(rows, "track string, anchor_date date, ticker string, resolution_date date, score double")
    bounds = R.rank_bounds(df, k)
    near = R.reachable(df, bounds)
    got = {tuple(r) for r in R.no_overlap_selection(near, k).select("track", "anchor_date", "ticker").collect()}
    assert got == held_by_walking(rows, k)


@pytest.mark.parametrize("depth", [1, 3, 1000])
def test_random_purchases_equal_a_walk_of_all_scores(spark, depth):
    """Whatever depth the seeds start from, held tickers and short dates end in the walk over every candidate."""
    rng = random.Random(5)
    days = [f"2020-01-{d:02d}" for d in (1, 3, 6, 8, 13, 20)]
    rows = [(h, f"T{t:02d}", day(d), day(f"2020-02-{rng.randrange(1, 28):02d}" if h == 40 else f"2020-01-{rng.randrange(21, 30)}"))
            for h in (20, 40) for d in days for t in range(12) if rng.random() < (0.2 if d == days[2] else 0.8)]
    closed = spark.createDataFrame(rows, "hold_days int, ticker string, entry_date date, exit_date date")
    got = {tuple(r) for r in ST.random_purchases(closed, 4, 7, 2, depth).select(
        "hold_days", "seed", "entry_date", "ticker").collect()}
    scored = per_seed(closed.withColumnRenamed("entry_date", "anchor_date"), 4, 7).withColumn("score", R.random_score("seed"))
    want, book = set(), {}
    for r in scored.collect():
        book.setdefault((r.hold_days, r.seed), []).append((r.anchor_date, -r.score, r.ticker, r.exit_date))
    for key, rows in book.items():
        held, bought = {}, {}
        for d, _, t, free in sorted(rows):
            if bought.get(d, 0) < 2 and not held.get(t, d) > d:
                held[t], bought[d] = free, bought.get(d, 0) + 1
                want.add((*key, d, t))
    assert got == want and len(want) > 40


def test_random_scores_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([pick(f"T{i}", "2020-01-03", "2020-02-03") for i in range(50)], PICK).select("ticker", "anchor_date")
    one = dict(df.coalesce(1).select("ticker", R.random_score(5)).collect())
    many = dict(df.repartition(7).select("ticker", R.random_score(5)).collect())
    assert one == many and len(set(one.values())) == 50 and all(0 <= v < 1 for v in one.values())


def test_one_trade_to_the_cent(spark):
    bars = flat_bars(spark, "A", {"2020-01-03": 10.0, "2020-01-06": 11.0, "2020-01-07": 12.0})
    p = spark.createDataFrame([pick("A", "2020-01-03", "2020-01-07")], PICK)
    r = ledger(p, bars).first()
    fill = 10 * 1.001
    shares = int(4000 // fill)
    cost = shares * fill + min(shares * 0.005, 0.005 * shares * fill)
    proceeds = shares * 12 * 0.999
    fee = min(shares * 0.005, 0.005 * proceeds)
    assert (r["shares"], r["exit_date"]) == (shares, day("2020-01-07"))
    assert r["cost"] == pytest.approx(cost) and r["proceeds"] == pytest.approx(proceeds)
    assert r["trade_return_pct"] == pytest.approx((proceeds - fee - cost) / cost)


def test_exit_waits_for_the_next_bar_and_never_looks_back(spark):
    bars = flat_bars(spark, "A", {"2020-01-03": 10.0, "2020-01-06": 99.0, "2020-01-13": 12.0}).unionByName(
        flat_bars(spark, "B", {"2020-01-07": 1.0, "2020-01-20": 1.0}))
    p = spark.createDataFrame([pick("A", "2020-01-03", "2020-01-07")], PICK)
    assert ledger(p, bars).first()["exit_date"] == day("2020-01-13")
    req = spark.createDataFrame([("A", day("2020-01-06")), ("A", day("2020-01-14"))], "ticker string, due date")
    got = {r["due"].isoformat(): r["next_close"] for r in next_bar_join(req, bars, "due").collect()}
    assert got == {"2020-01-06": 99.0, "2020-01-14": None}


def test_trailing_stop_uses_the_running_peak(spark):
    bars = flat_bars(spark, "A", {"2020-01-03": 10.0, "2020-01-06": 14.0, "2020-01-07": 11.3, "2020-01-08": 20.0, "2020-01-09": 20.0})
    p = spark.createDataFrame([pick("A", "2020-01-03", "2020-01-09")], PICK)
    stopped = ledger(p, bars, LedgerConfig(trailing_stop_pct=0.18)).first()
    assert stopped["exit_date"] == day("2020-01-07")
    assert ledger(p, bars, LedgerConfig(trailing_stop_pct=0.25)).first()["exit_date"] == day("2020-01-09")


def test_unresolved_trades_close_on_the_last_day(spark):
    bars = flat_bars(spark, "A", {"2020-01-03": 10.0}).unionByName(flat_bars(spark, "B", {"2020-01-03": 10.0, "2020-01-08": 9.0}))
    p = spark.createDataFrame([pick("A", "2020-01-03", "2020-03-01"), pick("B", "2020-01-03", "2020-03-01")], PICK)
    got = {r["ticker"]: r for r in ledger(p, bars).collect()}
    assert all(r["forced_close"] and r["exit_date"] == day("2020-01-08") for r in got.values())
    assert got["B"]["exit_price"] == pytest.approx(9 * 0.999)
    assert got["A"]["exit_price"] == pytest.approx(got["A"]["entry_price"] * 0.999)


def test_untradable_picks_make_no_trade(spark):
    bars = flat_bars(spark, "A", {"2020-01-03": 10.0, "2020-01-07": 12.0})
    bad = [pick("A", "2020-01-03", "2020-01-07", adv=4e6), pick("A", "2020-01-03", "2020-01-07", adv=float("nan")),
           pick("A", "2020-01-03", "2020-01-07", close=0.0), pick("GHOST", "2020-01-03", "2020-01-07")]
    assert ledger(spark.createDataFrame(bad, PICK), bars).count() == 0


@pytest.mark.parametrize("first, second", [
    ({"close": float("nan")}, {"adv": float("nan")}), ({"close": 0.0}, {"close": -5.0}), ({"adv": 1e6}, {"adv": 1e4})])
def test_what_cannot_be_bought_takes_no_place(spark, first, second):
    bars = flat_bars(spark, "C", {"2020-01-03": 10.0, "2020-01-07": 12.0})
    for t in "AB":
        bars = bars.unionByName(flat_bars(spark, t, {"2020-01-03": 10.0, "2020-01-07": 12.0}))
    rows = [pick("A", "2020-01-03", "2020-01-07", score=3.0, **first), pick("B", "2020-01-03", "2020-01-07", score=2.0, **second),
            pick("C", "2020-01-03", "2020-01-07", score=1.0)]
    got = ledger(spark.createDataFrame(rows, PICK), bars, LedgerConfig(max_new_per_week=1)).collect()
    assert [r["ticker"] for r in got] == ["C"]


def test_a_halted_order_takes_no_place(spark):
    cfg = LedgerConfig(max_new_per_week=1, halt_risk=True, min_adv_usd=0.0)
    rows = [pick(f"T{i:03d}", "2020-01-03", "2020-01-07", adv=1e6, score=float(1000 - i)) for i in range(400)]
    picks = spark.createDataFrame(rows, PICK)
    halted = [r["ticker"] for r in picks.filter(K.halt_draw(cfg.halt_seed, "track")).orderBy("ticker").collect()]
    assert halted
    after = f"T{int(halted[0][1:]) + 1:03d}"
    assert after not in halted
    pair = picks.filter(F.col("ticker").isin(halted[0], after))
    bars = flat_bars(spark, halted[0], {"2020-01-03": 10.0, "2020-01-07": 12.0}).unionByName(
        flat_bars(spark, after, {"2020-01-03": 10.0, "2020-01-07": 12.0}))
    assert [r["ticker"] for r in ledger(pair, bars, cfg).collect()] == [after]


def test_a_stopped_ticker_can_be_bought_again(spark):
    bars = flat_bars(spark, "A", {"2020-01-03": 10.0, "2020-01-06": 14.0, "2020-01-07": 11.0, "2020-01-10": 12.0, "2020-01-31": 13.0})
    rows = [pick("A", "2020-01-03", "2020-01-31"), pick("A", "2020-01-06", "2020-01-31", close=14.0), pick("A", "2020-01-10", "2020-01-31", close=12.0)]
    p = spark.createDataFrame(rows, PICK)
    got = ledger(p, bars, LedgerConfig(trailing_stop_pct=0.18)).orderBy("entry_date").collect()
    assert [(r["entry_date"], r["exit_date"]) for r in got] == [
        (day("2020-01-03"), day("2020-01-07")), (day("2020-01-10"), day("2020-01-31"))]
    assert ledger(p, bars).count() == 1  # without a stop it is held to the end


def test_impact_grows_with_participation_within_bounds(spark):
    df = spark.createDataFrame([(float(p),) for p in (0, 1e2, 1e4, 1e6, 1e12)], "p double")
    bps = [r[0] for r in df.select(K.impact_bps(F.col("p"), F.lit(1e7))).collect()]
    assert bps == sorted(bps) and bps[0] == 1.0 and bps[-1] == 500.0
    assert bps[2] == pytest.approx(0.03 * 0.142 * (1e4 / 1e7) ** 0.5 * 1.25 * 1e4)


@pytest.fixture(scope="module")
def book(spark):
    frames = [walk(t, 60, i) for i, t in enumerate("ABCDEF")]
    bars = to_bars(spark, *frames)
    rows = []
    for f in frames:
        for i in (3, 20, 40):
            rows.append(("x", f["ticker"][0], f["date"][i], f["date"][i + 15], float(f["close"][i]), 1e9, 1.0))
    led = ledger(spark.createDataFrame(rows, PICK), bars, LedgerConfig(max_new_per_week=10))
    return bars, led


def test_trade_path_multiplies_to_the_trade_return(spark, book):
    bars, led = book
    path = K.mark_to_market(led, bars).toPandas().sort_values("date")
    trades = led.toPandas().set_index(["ticker", "entry_date"])
    for key, g in path.groupby(["ticker", "entry_date"]):
        v = [trades.loc[key, "cost"], *g["value"]]
        growth = 1.0
        for a, b in zip(v, v[1:]):
            growth *= b / a
        assert growth - 1 == pytest.approx(trades.loc[key, "trade_return_pct"])


def test_positions_equity_and_summary_agree(spark, book):
    bars, led = book
    eq = K.sleeve_equity_curve(led, bars)
    e = eq.toPandas().sort_values("date").reset_index(drop=True)
    pos = K.open_positions_by_day(led, bars).toPandas().sort_values("date").reset_index(drop=True)
    assert list(e["n_positions"]) == list(pos["n_positions"]) and pos["n_positions"].max() == 6
    assert e["equity"].iloc[0] == 100_000.0 and (e["cash"] >= 0).all()
    s = M.compute_summary(eq, led).first()
    r = e["equity"].pct_change().dropna()
    t = led.toPandas()["trade_return_pct"]
    years = (e["date"].iloc[-1] - e["date"].iloc[0]).days / 365.25
    assert s["cagr"] == pytest.approx((e["equity"].iloc[-1] / 1e5) ** (1 / years) - 1)
    assert s["sharpe_annualized"] == pytest.approx(r.mean() / r.std(ddof=0) * 252 ** 0.5)
    assert s["max_drawdown"] == pytest.approx((e["equity"] / e["equity"].cummax() - 1).min())
    assert s["n_trades"] == 18 and s["win_rate"] == pytest.approx((t > 0).mean())
    assert s["profit_factor"] == pytest.approx(t[t > 0].sum() / -t[t <= 0].sum())
    assert s["median_trade_return"] == pytest.approx(t.median())
    assert s["avg_cash_pct"] == pytest.approx((e["cash"] / e["equity"]).mean())


def test_only_trades_of_some_seed_are_marked_day_by_day(spark, monkeypatch):
    from tideline.plans import common as C

    study, marked, returns = C.Study(spark, "/root/testdata/sf0.001"), [], ST.trade_returns
    monkeypatch.setattr(ST, "trade_returns", lambda trades, *a: marked.append(trades.count()) or returns(trades, *a))
    summary, led = ST.random_portfolios(study.lean, study.bars, (20,), 1, cfg=replace(ST.FREE, max_new_per_week=1))
    assert marked == [led.count()] and summary.count() == 1


def test_scores_exits_and_outcomes_come_from_one_pass(spark):
    """The same rows as features joined with labels and the exit looked up in the bars; a null close at the exit gives the next one."""
    cfg = StudyConfig(horizons=(20, 40), warmup=240)
    frames = [walk("A", 420, 1), walk("B", 330, 2), walk("C", 100, 3)]
    frames[0].loc[range(300, 420, 7), "close"] = None
    bars = to_bars(spark, *frames).replace(float("nan"), None)
    got = R.scored_anchors(bars, cfg, 40)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    lab = A.build_labels(bars, cfg)
    want = K.fixed_exit(R.score_frame(compute_features(bars, A.anchor_frame(bars, cfg)), lab, 40), bars.select("ticker", "date", "close"))
    want = want.join(
        lab.select("ticker", "anchor_date", F.col("fwd_ret_40d").alias("fwd_ret")), ["ticker", "anchor_date"]).select(*got.columns)
    rows = sorted(map(repr, got.collect()))
    assert len(rows) > 100 and rows == sorted(map(repr, want.collect()))


def test_the_study_does_not_join_scores(spark):
    plan = C.Study(spark, "/root/testdata/sf0.001").scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
