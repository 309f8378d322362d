"""Whole flows: random portfolios, forward picks, the report card and the full study."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.config import LedgerConfig, StudyConfig
from tideline.operators.anchors import build_labels, latest_candidates
from tideline.operators.features import FEATURE_COLS, compute_features
from tideline.operators.governance import trial_count
from tideline.operators.inference import (bootstrap_ci, effective_sample_size, paired_gap, paired_returns, se_widening)
from tideline.operators.joins import per_seed
from tideline.operators.ledger import booked, exits, fixed_exit, open_trades, purchases, sleeve_equity_curve, trade_ledger, trade_returns
from tideline.operators.metrics import compute_summary
from tideline.operators.models import ModelConfig, fit_track, score_track
from tideline.operators.ranking import forward_topk, no_overlap_selection, random_score
from tideline.operators.splits import resolved_before
from tideline.session import cut

# The comparison of random portfolios runs without costs or a liquidity gate.
FREE = LedgerConfig(slippage_bps=0.0, commission_per_share=0.0, min_adv_usd=0.0, max_adv_pct=1.0)
SEED_KEYS = ("hold_days", "seed")


def random_portfolios(labels: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = (20, 40), n_seeds: int = 200,
                      base_seed: int = 0, cfg: LedgerConfig = FREE) -> tuple[DataFrame, DataFrame]:
    """(summary, ledger) per holding period and seed; all seeds run as rows of one job.

    What can be bought, when it is sold and what it returns day by day do not depend on the seed, so all of it is found
    once (orders are not halted here), the last for trades that some seed makes, and the seeds' purchases are joined with it.
    """
    cells = F.array(*[F.struct(F.lit(h).alias("hold_days"), F.col(f"resolution_date_{h}d").alias("resolution_date"))
                      for h in horizons])
    base = labels.select("ticker", "anchor_date", "anchor_close", "anchor_idx", "adv20_usd", F.inline(cells))
    opened = fixed_exit(open_trades(base, bars, replace(cfg, halt_risk=False), ("hold_days",)), bars)
    closed = exits(opened, bars, cfg, ("hold_days",)).withColumn("score", F.lit(0.0))
    trades = cut(booked(closed, cfg, ("hold_days",)).drop("score"))
    trade = ["hold_days", "ticker", "entry_date"]
    bought = cut(random_purchases(trades, n_seeds, base_seed, cfg.max_new_per_week))
    # Seeds, dates and places bound what is bought, however many tickers there are: only that is marked day by day.
    made = cut(trades.join(bought.select(*trade).distinct(), trade, "left_semi"))
    daily = cut(trade_returns(made, bars, ("hold_days",)))
    led = bought.join(made, trade)
    held = bought.select(*SEED_KEYS, "ticker", "entry_date").join(daily, trade)
    return compute_summary(sleeve_equity_curve(led, bars, cfg, SEED_KEYS, held), led, SEED_KEYS), led


def random_purchases(closed: DataFrame, n_seeds: int, base_seed: int = 0, k: int = 5, depth: int = 0) -> DataFrame:
    """(hold_days, seed, ticker, entry_date, score) that each seed buys among the trades it could make, exits known.

    The scores of n candidates of a date are uniform, so those of at least 1 - depth / n are about `depth` rows and whole
    from the top: a filter before the shuffle, no sort. Seeds that fill all their places from them are done. For the
    others, where held tickers left a place open and candidates lie below, the depth is doubled until it reaches
    every candidate. depth: 0 for four times k.
    """
    counts = cut(closed.groupBy("hold_days", "entry_date").agg(F.count("*").alias("n")))
    most = counts.agg(F.max("n")).first()[0] or 0
    rows = closed.select("hold_days", "ticker", "entry_date", "exit_date").join(F.broadcast(counts), ["hold_days", "entry_date"])
    # The score of a seed is the same for all holding periods, so these lie in one row: one hash for them. The seeds
    # multiply the rows in place, so few rows still have to lie in many tasks.
    rows = rows.repartition(int(closed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ticker", "entry_date").groupBy(
        "ticker", F.col("entry_date").alias("anchor_date")).agg(
        F.collect_list(F.struct("hold_days", "exit_date", "n")).alias("cells"), F.min("n").alias("least"))
    keys = per_seed(counts.select("hold_days").distinct(), n_seeds, base_seed)
    depth, todo, parts = depth or 4 * k, None, []
    while True:
        seeded = per_seed(rows, n_seeds, base_seed)
        if todo is not None:  # at most one row per seed
            seeded = seeded.join(F.broadcast(todo.select("seed").distinct()), "seed", "left_semi")
        near = seeded.withColumn("score", random_score("seed")).filter(F.col("score") >= 1.0 - depth / F.col("least"))
        near = near.select("seed", "ticker", F.col("anchor_date").alias("entry_date"), "score", F.inline("cells"))
        near = near.filter(F.col("score") >= 1.0 - depth / F.col("n")).withColumn("rank", -F.col("score"))
        if todo is not None:  # at most one row per holding period and seed
            near = near.join(F.broadcast(todo), list(SEED_KEYS), "left_semi")
        near = cut(near)  # read twice: hashes once
        bought = cut(no_overlap_selection(near, k, SEED_KEYS, "entry_date", "exit_date"))
        part = bought.select(*SEED_KEYS, "ticker", "entry_date", "score")
        if depth >= most:
            parts.append(part)
            break
        # Dates of which not all candidates were looked at must have given k purchases.
        due = counts.filter(F.col("n") > depth).groupBy("hold_days").agg(F.count("*").alias("due"))
        full = (bought.filter(F.col("n") > depth).groupBy(*SEED_KEYS, "entry_date").count().filter(F.col("count") == k)
                .groupBy(*SEED_KEYS).agg(F.count("*").alias("full")))
        state = keys if todo is None else todo
        left = cut(state.join(due, "hold_days").join(full, list(SEED_KEYS), "left")
                   .filter(F.col("due") > F.coalesce("full", F.lit(0))).select(*SEED_KEYS))
        parts.append(part.join(F.broadcast(left), list(SEED_KEYS), "left_anti"))
        if left.isEmpty():
            break
        todo, depth = left, 2 * depth
    return reduce(DataFrame.unionByName, parts)


def recost(spark, scores_path: str, bars: DataFrame, rules: dict[str, LedgerConfig]) -> DataFrame:
    """Summary of every track under each set of costs, from scores that an earlier run stored; nothing is scored again."""
    out = None
    for name, cfg in rules.items():
        scores = spark.read.parquet(scores_path)
        led = cut(trade_ledger(cut(purchases(scores, bars, cfg)), bars, cfg))
        part = compute_summary(sleeve_equity_curve(led, bars, cfg), led).withColumn("rules", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def weekly_forward_picks(bars: DataFrame, market: DataFrame, today: str, horizon: int = 40, threshold_pct: int = 25,
                         k: int = 5, min_adv: float = 5e6, study: StudyConfig = StudyConfig(),
                         models: ModelConfig = ModelConfig(), prefilter: bool = True) -> DataFrame:
    """Train on everything resolved before ``today`` and rank what can be bought on it."""
    # Of all labels the fit reads one; the longest horizon stays, as it tells which bars are anchors.
    label = f"ret_{horizon}d_ge_{threshold_pct}pct"
    one = replace(study, horizons=tuple(sorted({horizon, study.max_horizon})), thresholds=(threshold_pct / 100,))
    labels = build_labels(bars, one, prefilter)
    known = resolved_before(labels, today, horizon).select("ticker", "anchor_date", "anchor_idx", label)
    feats = compute_features(bars, known.select("ticker", "anchor_date", "anchor_idx"), market)
    train = cut(feats.join(known.drop("anchor_idx"), ["ticker", "anchor_date"]).select("ticker", "anchor_date", label, *FEATURE_COLS))
    cand = latest_candidates(bars, today, study, prefilter)
    cand_feats = compute_features(bars, cand.select("ticker", "anchor_date", "anchor_idx"), market)
    rows = cand_feats.join(cand.drop("anchor_idx"), ["ticker", "anchor_date"])
    if train.count() < study.min_train:
        return rows.limit(0).select("ticker", "anchor_date", "anchor_close", "adv20_usd")
    fit = fit_track(train, label, "gbt_engineered", models)
    picks = forward_topk(score_track(fit, rows), k, min_adv)
    return picks.select("ticker", "anchor_date", "anchor_close", "adv20_usd", "score",
                        F.lit(today).alias("pick_generated"), F.lit(horizon).alias("horizon_days"),
                        F.lit("gbt_engineered").alias("track"))


def report_card_rows(summary: DataFrame, equity: DataFrame, ledger: DataFrame, trials: DataFrame, model: str,
                     baseline: str, n_resamples: int = 2000, block: int = 40) -> DataFrame:
    """One row: point estimates, intervals, paired gap, effective sample and the verdict."""
    best = summary.filter(F.col("track") == model).select(
        "track", "cagr", "sharpe_annualized", "max_drawdown", "n_trades")
    base = summary.filter(F.col("track") == baseline).select(
        F.lit(model).alias("track"), F.col("track").alias("best_baseline"), F.col("cagr").alias("baseline_cagr"))
    mine = equity.filter(F.col("track") == model)
    ci = bootstrap_ci(mine, n_resamples, block)
    pair = paired_returns(mine, equity.filter(F.col("track") == baseline))
    gap = paired_gap(pair, n_resamples, block).withColumn("track", F.lit(model))
    eff = effective_sample_size(ledger.filter(F.col("track") == model))
    n = trial_count(trials).withColumn("track", F.lit(model))
    j = best.join(base, "track").join(ci, "track").join(gap, "track").join(eff, "track").join(n, "track")
    return j.withColumns({
        "gap_point": F.col("cagr") - F.col("baseline_cagr"),
        "se_widen": se_widening(F.col("n_trades"), F.col("n_eff")),
        "gap_significant": F.when((F.col("p_value_gap_le_0") < 0.05) & (F.col("gap_lo") > 0), "Y").otherwise("N"),
    })
