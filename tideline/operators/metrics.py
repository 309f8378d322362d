"""Summary metrics, grouped by track, seed or any other keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANNUAL = math.sqrt(252.0)

#: A spread of returns below this is rounding noise, not risk: such a series has no Sharpe ratio (zero).
NOISE = 1e-12


def cagr(start: Column, end: Column, years: Column) -> Column:
    return F.when(start > 0, F.pow(end / start, 1.0 / years) - 1.0).otherwise(0.0)


def sharpe_of(mean: Column, sd: Column) -> Column:
    return F.when(sd > NOISE, mean / sd * ANNUAL).otherwise(0.0)


def equity_summary(equity: DataFrame, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = equity.withColumns({
        "_ret": F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1.0,
        "_dd": F.try_divide(F.col("equity"), F.max("equity").over(run)) - 1.0,
    })
    g = e.groupBy(*keys).agg(
        F.min_by("equity", "date").alias("start_equity"), F.max_by("equity", "date").alias("end_equity"),
        F.datediff(F.max("date"), F.min("date")).alias("_days"),
        F.avg("_ret").alias("_mean"), F.stddev_pop("_ret").alias("_sd"), F.min("_dd").alias("max_drawdown"),
        F.avg("n_positions").alias("avg_positions"), F.max("n_positions").alias("max_positions"),
        F.avg(F.try_divide("cash", "equity")).alias("avg_cash_pct"))
    years = F.when(F.col("_days") > 0, F.col("_days") / 365.25).otherwise(1e-9)
    daily = F.when(F.col("_sd") > NOISE, F.col("_mean") / F.col("_sd")).otherwise(0.0)
    return g.withColumn("years", years).select(
        *keys, "start_equity", "end_equity",
        (F.col("end_equity") / F.col("start_equity") - 1.0).alias("total_return"), "years",
        cagr(F.col("start_equity"), F.col("end_equity"), F.col("years")).alias("cagr"),
        (daily * ANNUAL).alias("sharpe_annualized"), daily.alias("sharpe_daily"), "max_drawdown",
        "avg_positions", "max_positions", "avg_cash_pct")


def trade_summary(ledger: DataFrame, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    r = F.col("trade_return_pct")
    g = ledger.groupBy(*keys).agg(
        F.count("*").alias("n_trades"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("_wins"),
        F.abs(F.sum(F.when(r <= 0, r).otherwise(0.0))).alias("_losses"),
        F.avg(r).alias("avg_trade_return"), F.percentile(r, F.lit(0.5)).alias("median_trade_return"))
    pf = F.when(F.col("_losses") > 0, F.col("_wins") / F.col("_losses")).otherwise(F.lit(float("inf")))
    return g.select(*keys, "n_trades", "win_rate", pf.alias("profit_factor"),
                    "avg_trade_return", "median_trade_return")


def compute_summary(equity: DataFrame, ledger: DataFrame, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """All sixteen metrics per key; keys without trades get zeros."""
    j = equity_summary(equity, keys).join(trade_summary(ledger, keys), list(keys), "left")
    zeros = ["n_trades", "win_rate", "profit_factor", "avg_trade_return", "median_trade_return"]
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zeros})


def vs_random_percentile(tracks: DataFrame, null: DataFrame, value: str = "end_equity") -> DataFrame:
    """Share of the null runs at or below each track's value. One null value per seed: a parameter's worth."""
    sample = null.agg(F.collect_list(value)).scalar()
    t = tracks.withColumn("_null", sample)
    share = F.try_divide(F.size(F.filter("_null", lambda x: x <= F.col(value))), F.size("_null"))
    return t.withColumn("vs_random_pct", share).drop("_null")


def null_distribution(seeds: DataFrame) -> DataFrame:
    p = lambda c, q: F.percentile(c, F.lit(q))
    return seeds.agg(
        F.count("*").alias("n_seeds"), p("cagr", 0.5).alias("median_cagr"),
        p("end_equity", 0.5).alias("median_end_equity"), p("end_equity", 0.95).alias("p95_end_equity"),
        p("end_equity", 0.99).alias("p99_end_equity"))


def per_horizon_aggregate(seeds: DataFrame) -> DataFrame:
    """Per holding period, the spread over seeds."""
    p = lambda c, q: F.percentile(c, F.lit(q))
    aggs = [F.count("*").alias("n_seeds")]
    for col, name in (("end_equity", "ending_equity"), ("cagr", "cagr"), ("max_drawdown", "max_drawdown")):
        aggs += [p(col, 0.5).alias(f"median_{name}"), p(col, 0.05).alias(f"p5_{name}"), p(col, 0.95).alias(f"p95_{name}")]
    aggs += [p("profit_factor", 0.5).alias("median_profit_factor"), p("win_rate", 0.5).alias("median_win_rate"),
             p("n_trades", 0.5).alias("median_trade_count")]
    return seeds.groupBy("hold_days").agg(*aggs)


def leaderboard(summary: DataFrame) -> DataFrame:
    """Tracks by end equity with the best by CAGR and the best simple baseline marked; a row per track.

    Places compare cents and millionths, so tracks that made the same trades tie, and ties go by name.
    """
    is_base = F.col("track").startswith("rank_")
    digits = {"end_equity": 2, "cagr": 6}
    rank = lambda part, col: F.row_number().over(
        Window.partitionBy(part).orderBy(F.round(col, digits[col]).desc(), "track"))
    one = F.lit(1)
    return summary.select(
        "track", "end_equity", "cagr",
        rank(one, "end_equity").alias("place"),
        F.when(rank(one, "cagr") == 1, 1).otherwise(0).alias("best_by_cagr"),
        F.when(is_base & (rank(is_base, "end_equity") == 1), 1).otherwise(0).alias("best_baseline"))


def cost_impact(flat: DataFrame, real: DataFrame) -> DataFrame:
    a = flat.select("track", F.col("cagr").alias("cagr_flat"), F.col("max_drawdown").alias("dd_flat"))
    b = real.select("track", F.col("cagr").alias("cagr_real"), F.col("max_drawdown").alias("dd_real"))
    return a.join(b, "track").select(
        "track", "cagr_flat", "cagr_real", (F.col("cagr_real") - F.col("cagr_flat")).alias("delta_cagr"),
        (F.col("dd_real") - F.col("dd_flat")).alias("delta_drawdown"))


def oos_report(equity: DataFrame, ledger: DataFrame, year: int, label: str) -> DataFrame:
    """Summary of the held-out year only."""
    s = compute_summary(equity.filter(F.year("date") == year), ledger.filter(F.year("entry_date") == year))
    return s.withColumn("label", F.lit(label)).withColumn("report_type", F.lit("oos_only_last_fold"))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the smallest and the largest value."""
    lo, hi = df.agg(F.min(col)).scalar(), df.agg(F.max(col)).scalar()
    h = df.withColumn("_lo", lo).withColumn("_hi", hi)
    pos = F.floor((F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    b = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(pos, F.lit(bins - 1)))
    return h.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
