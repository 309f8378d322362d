"""Resampling statistics. Resamples are rows; the draws depend on the seed only, not on the plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.exprs import uniforms
from tideline.functions.normal import norm_cdf
from tideline.operators.metrics import NOISE, sharpe_of
from tideline.session import cut

# Fixed value: Euler's constant to the digits the threshold was published with.
EULER_GAMMA = 0.5772156649


def daily_returns(equity: DataFrame, keys: tuple[str, ...] = ("track",), log: bool = False) -> DataFrame:
    """Returns per key with their position ``i`` and the number of returns ``n``."""
    w = Window.partitionBy(*keys).orderBy("date")
    if log:
        level = F.ln(F.greatest(F.col("equity"), F.lit(1e-9)))
        r = level - F.lag(level).over(w)
    else:
        r = F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1.0
    out = equity.withColumn("r", r).filter(F.col("r").isNotNull())
    return out.select(
        *keys, "date", "r", (F.row_number().over(w) - 1).alias("i"),
        F.count("*").over(Window.partitionBy(*keys)).alias("n"))


def bootstrap_draws(returns: DataFrame, n_resamples: int, block: int, seed: int = 42) -> DataFrame:
    """Positions of a stationary bootstrap: (n, resample, t, i).

    Curves of equal length share their draws, so strategies are resampled together. Each resample is
    spread over the tasks first and then unrolled where it lies; its window needs no further shuffle.
    """
    lengths = returns.select("n").distinct()
    parts = int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = lengths.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))))
    runs = runs.repartition(parts, "n", "resample")
    steps = runs.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    u, v = uniforms("boot", seed, "resample", "t")
    p = 1.0 / max(block, 1)
    jump = F.when((F.col("t") == 0) | (u < p), F.floor(v * F.col("n")) - F.col("t"))
    w = Window.partitionBy("n", "resample").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.last(F.col("jump"), ignorenulls=True).over(w)
    return steps.withColumn("jump", jump).select(
        "n", "resample", "t", F.pmod(base + F.col("t"), F.col("n")).cast("int").alias("i"))


def resampled(returns: DataFrame, n_resamples: int, block: int, seed: int = 42,
              keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """(keys, n, resample, t, r). A curve is one array with a value per day; draws are looked up where they lie.

    The curves, one row per key, go to the draws and never the draws to them, as one task would hold all curves; groups by
    (keys, n, resample) need no further shuffle.
    """
    packed = returns.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("c"))
    curves = cut(packed.select(*keys, "n", F.col("c.r").alias("r")))  # an array of its own, or each look-up copies it
    draws = bootstrap_draws(returns, n_resamples, block, seed)
    return draws.join(F.broadcast(curves), "n").select(*keys, "n", "resample", "t", F.get("r", F.col("i")).alias("r"))


def stationary_bootstrap_sharpe(returns: DataFrame, n_resamples: int, block: int, seed: int = 42,
                                keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """Annualised Sharpe of every resample."""
    g = resampled(returns, n_resamples, block, seed, keys).groupBy(*keys, "n", "resample").agg(
        F.avg("r").alias("_m"), F.stddev_pop("r").alias("_s"))
    return g.select(*keys, "resample", sharpe_of(F.col("_m"), F.col("_s")).alias("sharpe"))


def paired_returns(model: DataFrame, base: DataFrame) -> DataFrame:
    """Two equity curves joined by date: both returns and their difference, as one series."""
    j = model.select("date", F.col("equity").alias("equity_m")).join(
        base.select("date", F.col("equity").alias("equity_b")), "date")
    w = Window.orderBy("date")  # one row per calendar day
    rm = F.try_divide(F.col("equity_m"), F.lag("equity_m").over(w)) - 1.0
    rb = F.try_divide(F.col("equity_b"), F.lag("equity_b").over(w)) - 1.0
    d = j.select("date", rm.alias("rm"), rb.alias("rb")).filter("rm IS NOT NULL AND rb IS NOT NULL")
    return d.select("date", "rm", "rb", (F.col("rm") - F.col("rb")).alias("r"),
                    (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"),
                    F.lit("pair").alias("track"))


def paired_bootstrap_p(pair: DataFrame, n_resamples: int, block: int, seed: int = 42) -> DataFrame:
    """Bootstrap of the Sharpe of the difference series, next to the observed difference of Sharpes."""
    boot = stationary_bootstrap_sharpe(pair.select("track", "date", "r", "i", "n"), n_resamples, block, seed)
    stats = boot.groupBy("track").agg(
        F.avg("sharpe").alias("boot_mean_diff"), F.stddev_pop("sharpe").alias("boot_se"),
        F.avg(F.when(F.col("sharpe") <= 0, 1.0).otherwise(0.0)).alias("p_value"))
    obs = pair.groupBy("track").agg(
        (sharpe_of(F.avg("rm"), F.stddev_pop("rm")) - sharpe_of(F.avg("rb"), F.stddev_pop("rb")))
        .alias("obs_sharpe_diff"))
    return obs.join(stats, "track").select("obs_sharpe_diff", "boot_mean_diff", "boot_se", "p_value")


def _ci(col: str, name: str) -> list[Column]:
    return [F.percentile(col, F.lit(q)).alias(f"{name}_{t}")
            for q, t in ((0.025, "lo"), (0.5, "med"), (0.975, "hi"))]


def bootstrap_ci(equity: DataFrame, n_resamples: int, block: int = 40, seed: int = 42,
                 keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """Intervals of CAGR, Sharpe and maximum drawdown; curves below five rows give zeros."""
    rets = daily_returns(equity, keys, log=True)
    rs = resampled(rets, n_resamples, block, seed, keys)
    w = Window.partitionBy(*keys, "n", "resample").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rs = rs.withColumn("cum", F.sum("r").over(w))
    rs = rs.withColumn("dd", F.exp(F.col("cum") - F.max("cum").over(w)) - 1.0)
    g = rs.groupBy(*keys, "n", "resample").agg(
        F.sum("r").alias("_sum"), F.avg("r").alias("_m"), F.stddev_pop("r").alias("_s"),
        F.min("dd").alias("maxdd"))
    years = F.greatest(F.col("n") / 252.0, F.lit(1e-9))
    g = g.select(*keys, "n", (F.exp(F.col("_sum") / years) - 1.0).alias("cagr"),
                 sharpe_of(F.col("_m"), F.col("_s")).alias("sharpe"), "maxdd")
    out = g.groupBy(*keys).agg(F.max("n").alias("_n"), *_ci("cagr", "cagr"), *_ci("sharpe", "sharpe"), *_ci("maxdd", "maxdd"))
    cols = [f"{m}_{t}" for m in ("cagr", "sharpe", "maxdd") for t in ("lo", "med", "hi")]
    short = equity.select(*keys).distinct().join(out, list(keys), "left")
    return short.select(*keys, *[F.when(F.col("_n") >= 4, F.col(c)).otherwise(0.0).alias(c) for c in cols])


def paired_gap(pair: DataFrame, n_resamples: int, block: int = 40, seed: int = 42) -> DataFrame:
    """Annualised mean daily gap, its interval and p(gap <= 0); below six dates a neutral result."""
    rs = resampled(pair.select("track", "date", "r", "i", "n"), n_resamples, block, seed)
    per = rs.groupBy("n", "resample").agg((F.avg("r") * 252.0).alias("ann"))
    boot = per.agg(*_ci("ann", "gap"), F.avg(F.when(F.col("ann") <= 0, 1.0).otherwise(0.0)).alias("p_value_gap_le_0"))
    obs = pair.agg((F.avg("r") * 252.0).alias("gap_annualized"), F.count("*").alias("n_obs"))
    j = obs.withColumn("_k", F.lit(1)).join(boot.withColumn("_k", F.lit(1)), "_k").drop("_k")
    ok = F.col("n_obs") >= 5
    zero = lambda c: F.when(ok, F.col(c)).otherwise(0.0).alias(c)
    return j.select(zero("gap_annualized"), zero("gap_lo"), zero("gap_med"), zero("gap_hi"),
                    F.when(ok, F.col("p_value_gap_le_0")).otherwise(1.0).alias("p_value_gap_le_0"),
                    F.when(ok, F.col("n_obs")).otherwise(0).alias("n_obs"))


def expected_max(n_trials: Column) -> Column:
    """Expected maximum of n standard normals, in units of their spread."""
    n = n_trials.cast("double")
    a = F.sqrt(2.0 * F.ln(F.when(n > 1, n)))
    return F.when(n <= 1, 0.0).when(n <= 2, a).otherwise(a - (F.ln(F.ln(F.when(n > 2, n))) + EULER_GAMMA) / a)


def deflated_sharpe(df: DataFrame, sharpe: str = "sharpe_annualized", n_obs: str = "n_obs",
                    n_trials: Column | str = "n_trials", skew: float = 0.0, kurt: float = 3.0) -> DataFrame:
    """Threshold and probability of the deflated Sharpe ratio, one per row."""
    trials = F.col(n_trials) if isinstance(n_trials, str) else n_trials
    sr = F.col(sharpe) / math.sqrt(252.0)
    spread = 1.0 - skew * sr + ((kurt - 1.0) / 4.0) * sr * sr
    dof = F.greatest(F.col(n_obs) - 1, F.lit(1))
    threshold = expected_max(trials) * F.sqrt(spread / dof)
    z = (sr - threshold) * F.sqrt(dof) / F.sqrt(F.greatest(spread, F.lit(1e-9)))
    return df.withColumns({
        "observed_sharpe_daily": sr,
        "deflated_sharpe_threshold_annualized": threshold * math.sqrt(252.0),
        "deflated_sharpe_p_value_significant": norm_cdf(z),
    })


def effective_sample_size(ledger: DataFrame, keys: tuple[str, ...] = ("track",), hold_days: int = 40) -> DataFrame:
    """Sum over trades of the mean of 1/concurrency on the weekdays from entry to exit."""
    led = ledger
    if "exit_date" not in led.columns:
        led = led.withColumn("exit_date", F.date_add("entry_date", hold_days))
    led = led.dropna(subset=["entry_date", "exit_date"])
    ids = [*keys, "ticker", "entry_date"]
    days = led.filter(F.col("exit_date") >= F.col("entry_date")).select(
        *ids, F.explode(F.sequence("entry_date", "exit_date")).alias("day")).filter(F.weekday("day") < 5)
    conc = days.groupBy(*keys, "day").agg(F.count("*").alias("c"))
    uniq = days.join(conc, [*keys, "day"]).groupBy(*ids).agg(F.avg(1.0 / F.col("c")).alias("u"))
    out = uniq.groupBy(*keys).agg(F.sum("u").alias("n_eff"))
    return led.select(*keys).distinct().join(out, list(keys), "left").select(
        *keys, F.coalesce("n_eff", F.lit(0.0)).alias("n_eff"))


def spa_test(returns: DataFrame, n_resamples: int, block: int = 10, seed: int = 42) -> DataFrame:
    """Superior predictive ability (Hansen 2005) over all tracks against a zero benchmark.

    ``returns`` holds (track, i, n, r) with r the excess over the benchmark. The spread of each mean is
    taken from the same stationary bootstrap. Curves below 50 rows give nulls.
    """
    # Read three times, and one row per track and resample.
    boot = cut(resampled(returns, n_resamples, block, seed).groupBy("track", "n", "resample").agg(F.avg("r").alias("m")).drop("n"))
    obs = returns.groupBy("track").agg(F.avg("r").alias("mean"), F.max("n").alias("n"))
    spread = boot.groupBy("track").agg(F.stddev_pop("m").alias("se"))
    # One row per track.
    par = obs.join(spread, "track").filter(F.col("se") > NOISE).withColumns({
        "g_lower": F.greatest(F.col("mean"), F.lit(0.0)),
        "g_consistent": F.when(F.col("mean") >= -F.col("se") * F.sqrt(2.0 * F.ln(F.ln("n"))), F.col("mean")).otherwise(0.0),
        "g_upper": F.col("mean"),
    })
    z = boot.join(par, "track").groupBy("resample").agg(*[
        F.greatest(F.max((F.col("m") - F.col(f"g_{k}")) / F.col("se")), F.lit(0.0)).alias(k)
        for k in ("lower", "consistent", "upper")])
    top = par.agg(F.greatest(F.max(F.col("mean") / F.col("se")), F.lit(0.0))).scalar()
    size = par.agg(F.count("*").alias("n_strategies"), F.max("n").alias("n_obs")).withColumn("_k", F.lit(1))
    p = z.withColumn("top", top).agg(*[
        F.avg(F.when(F.col(k) > F.col("top"), 1.0).otherwise(0.0)).alias(f"p_{k}")
        for k in ("lower", "consistent", "upper")]).withColumn("_k", F.lit(1))
    ok = F.col("n_obs") >= 50
    return p.join(size, "_k").select(
        *[F.when(ok, F.col(f"p_{k}")).alias(f"p_{k}") for k in ("lower", "consistent", "upper")],
        "n_strategies", "n_obs")


def post_tax_cagr(ledger: DataFrame, federal: float = 0.32, state: float = 0.06, niit: float = 0.038,
                  start_equity: float = 100_000.0, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """Compound growth before and after tax on each year's gain; a wiped-out account is -100%."""
    rate = federal + state + niit
    pnl = F.col("trade_return_pct") * F.col("cost")
    year = ledger.groupBy(*keys, F.year("exit_date").alias("year")).agg(F.sum(pnl).alias("gross"))
    year = year.withColumn("tax", F.greatest(F.col("gross"), F.lit(0.0)) * rate)
    g = year.groupBy(*keys).agg(F.sum("gross").alias("gross"), F.sum("tax").alias("total_tax"),
                                F.count("*").cast("double").alias("years"))
    pre = F.greatest(1.0 + F.col("gross") / start_equity, F.lit(0.0))
    post = F.greatest((start_equity + F.col("gross") - F.col("total_tax")) / start_equity, F.lit(0.0))
    return g.select(*keys, (F.pow(pre, 1.0 / F.col("years")) - 1.0).alias("pre_tax_cagr"),
                    (F.pow(post, 1.0 / F.col("years")) - 1.0).alias("post_tax_cagr"),
                    F.lit(rate).alias("blended_rate"), "total_tax", "years")


def se_widening(n_trades: Column, n_eff: Column) -> Column:
    return F.sqrt(n_trades / F.greatest(n_eff, F.lit(1.0)))
