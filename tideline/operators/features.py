"""Backward-looking features of an anchor over the lookback window ending there."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.exprs import by_ticker, zero_if_bad
from tideline.operators.windows import Bars, LookBack, anchor_rows, around, deviation, mean, slices, unnested

# The feature names, in the order models expect them.
FEATURE_COLS = [
    "ret_1d", "ret_5d", "ret_21d", "ret_63d", "ret_126d", "ret_252d",
    "vol_21d", "vol_63d", "vol_252d",
    "max_dd_252d", "current_dd_from_peak", "days_since_252d_high",
    "pct_from_252d_high", "pct_from_21d_high",
    "ratio_ma20", "ratio_ma50", "ratio_ma200",
    "log_dollar_vol_z252", "vol_ratio_20_252", "vol_trend_slope_60d",
    "skew_252d", "kurt_252d",
    "beta_spy_63d",
    "above_ma200_frac_252d", "up_day_frac_63d",
    "ret_252d_minus_21d", "vol_21d_div_252d",
    "slope_20", "slope_60", "slope_accel",
    "trendline_residual_z_60", "r2_log_60",
    "dd_count_5pct_120d", "days_since_60d_high",
    "pct_from_60d_high", "pct_from_60d_low",
    "swing_count_60d", "bb_width_pct_20",
    "vol_of_vol_ratio_30_120", "ret_vol_corr_20",
]

LOOKBACK = 252
ANNUAL = math.sqrt(252.0)
# Offset k is k bars before the anchor minus one, so ret_252d reaches the first bar of the window.
RETURN_OFFSETS = {"ret_1d": 1, "ret_5d": 5, "ret_21d": 21, "ret_63d": 63, "ret_126d": 126, "ret_252d": 251}


# What a task finds in the windows, in the order it gives it back.
STATISTICS = [
    "hi252", "hi60", "hi21", "lo60", "dd252", "days_since_252d_high", "days_since_60d_high", "dd_count_5pct_120d",
    *[f"_c{k}" for k in (0, *RETURN_OFFSETS.values())], "_sd_r21", "_sd_r63", "_sd_r251", "_sd_r30", "_sd_r20", "_sd_r_prior",
    "_skew", "_kurt", "_ma20", "_ma50", "_ma200", "_sd20", "_ldv0", "_ldv_avg", "_ldv_sd", "_v20", "_v252", "_lv_slope",
    "_cov_m", "_var_m", "_n_m", "_above", "_up", "_swings", "_slope20", "_slope60", "_icpt60", "_lp0", "_syy60", "_sxx60",
    "_cov_rv", "_sd_v20",
]


def calendar_broadcast(market: DataFrame) -> DataFrame:
    """A market series has one row per calendar day (365 a year, 16 bytes each), whatever the panel.

    The max per date makes that bound hold for any input before the frame is broadcast.
    """
    return F.broadcast(market.groupBy("date").agg(F.max("close").alias("mkt")))


def align_market(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Market close on each ticker's own calendar, matched by date, filled forward, then back."""
    j = bars.join(calendar_broadcast(market), "date", "left")
    w = by_ticker().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_ticker().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return j.withColumn("mkt", F.coalesce(
        F.last("mkt", ignorenulls=True).over(w), F.first("mkt", ignorenulls=True).over(whole)))


def log_return() -> Column:
    """Log return; a step from or to a price of zero is infinite, so that it spoils its windows."""
    prev, c = F.lag("close", 1).over(by_ticker()), F.col("close")
    return (F.when((prev > 0) & (c > 0), F.ln(c / prev)).when((prev <= 0) & (c > 0), float("inf"))
            .when((prev > 0) & (c <= 0), float("-inf")).when(prev.isNotNull(), float("nan")))


def swing_flag() -> Column:
    """1 where a close is above (or below) both neighbours on each side."""
    w = by_ticker()
    near = [F.lag("close", 1).over(w), F.lag("close", 2).over(w),
            F.lead("close", 1).over(w), F.lead("close", 2).over(w)]
    c = F.col("close")
    high = (c > near[0]) & (c > near[1]) & (c > near[2]) & (c > near[3])
    low = (c < near[0]) & (c < near[1]) & (c < near[2]) & (c < near[3])
    return F.when(high | low, 1.0).otherwise(0.0)


def prepare_series(bars: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """Per-bar inputs of the features: log returns of the ticker and of the market, and the swing flag."""
    b = align_market(bars, market) if market is not None else bars.withColumn("mkt", F.lit(None).cast("double"))
    prev_mkt = F.lag("mkt", 1).over(by_ticker())
    return b.select("ticker", "date", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"),
                    log_return().alias("r"), F.when((prev_mkt > 0) & (F.col("mkt") > 0), F.ln(F.col("mkt") / prev_mkt)).alias("mr"),
                    swing_flag().alias("swing"))


def drawdown_entries(path: np.ndarray, enter: float = -0.05, leave: float = -0.005) -> np.ndarray:
    """How often each row of closes falls into a drawdown, re-armed once it has recovered. All rows go bar by bar together."""
    peak, inside, n = np.zeros(len(path)), np.zeros(len(path), bool), np.zeros(len(path))
    for x in path.T:
        peak = np.fmax(peak, x)
        dd = np.where(peak != 0, x / peak - 1.0, np.nan)
        entered = (dd <= enter) & ~inside
        inside = entered | (inside & ~(dd >= leave))
        n += entered
    return n


def ticker_paths(bars: DataFrame, cols: list[str]) -> DataFrame:
    """One row per ticker with its columns as arrays in date order.

    A ticker has one bar per date, so an array is as long as the calendar (2,500 entries in ten
    years) and cannot be made longer by a busy ticker.
    """
    packed = bars.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", *cols))).alias("p"))
    return packed.select("ticker", *[F.col("p")[c].alias(f"{c}_path") for c in cols])


def anchor_slices(bars: DataFrame, anchors: DataFrame, cols: list[str], length: int = LOOKBACK,
                  keep: list[str] | None = None) -> DataFrame:
    """Anchors with the last ``length`` values of each column as arrays; short histories vanish.

    Slices exist for anchor rows only: on every bar they would be ``length`` times the data.
    """
    keep = keep or ["ticker", "anchor_date", "anchor_idx"]
    others = [c for c in keep if c != "ticker"]
    grouped = anchors.filter(F.col("anchor_idx") >= length - 1).groupBy("ticker").agg(
        F.collect_list(F.struct(*others)).alias("a"))
    joined = grouped.join(ticker_paths(bars, cols), "ticker")
    cut = F.transform("a", lambda a: F.struct(
        *[a[c].alias(c) for c in others],
        *[F.slice(F.col(f"{c}_path"), a["anchor_idx"] - (length - 2), length).alias(f"{c}_w") for c in cols]))
    return joined.select("ticker", F.inline(cut))


def _above_mean(close: Bars, n: int) -> np.ndarray:
    """Per bar, whether its close is above the mean of the n closes that end there; bars with fewer before them are not read.

    Sums over 2^j bars are made from two of half as many, and n bars are put together from one sum per binary digit.
    """
    total, count = np.zeros(len(close.values)), np.zeros(len(close.values))
    sums, counts, length, done = np.where(close.there, close.values, 0.0), close.there.astype(float), 1, 0
    earlier = lambda a, k: np.concatenate([np.zeros(min(k, len(a))), a[:max(len(a) - k, 0)]])
    while length <= n:
        if n & length:
            total, count, done = total + earlier(sums, done), count + earlier(counts, done), done + length
        sums, counts, length = sums + earlier(sums, length), counts + earlier(counts, length), 2 * length
    return close.values > total / count


def _slope(y: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least squares of the values on their offsets (the last is 0): slope, intercept, syy and sxx."""
    x = np.broadcast_to(np.arange(1.0 - y.shape[1], 1.0), y.shape)
    dx, dy = around(x, there), around(y, there)
    sxx = (dx * dx).sum(axis=1)
    slope = (dx * dy).sum(axis=1) / sxx
    return slope, mean(y, there) - slope * mean(x, there), (dy * dy).sum(axis=1), sxx


def _statistics(part: pa.RecordBatch) -> pa.RecordBatch:
    """What the features of some tickers' anchors are made of: closes, extremes, falls, sums and moments of their windows."""
    size, bar = unnested(part.column("p"))
    per, anchor = unnested(part.column("a"))
    owner, idx = np.repeat(np.arange(len(size)), per), np.asarray(anchor["anchor_idx"])
    real = idx < size[owner]
    owner, idx, dates = owner[real], idx[real], anchor["anchor_date"].filter(pa.array(real))
    at = (np.cumsum(size) - size)[owner] + idx
    close, volume, ret, mkt, swing = (Bars(bar[c]) for c in ("close", "volume", "r", "mr", "swing"))
    c, c_in = close.window(at, 1 - LOOKBACK, 0)
    v, v_in = volume.window(at, 1 - LOOKBACK, 0)
    r, r_in = ret.window(at, 2 - LOOKBACK, 0)
    mr, mr_in = mkt.window(at, -62, 0)
    # Extremes and falls in Spark's order: NaN above all; nulls are passed over.
    hi, lo = np.where(c_in, c, -np.inf), np.where(c_in & ~np.isnan(c), c, np.inf)
    peak = np.fmax.accumulate(hi, axis=1)
    out = {"hi252": hi.max(axis=1), "hi60": hi[:, -60:].max(axis=1), "hi21": hi[:, -21:].max(axis=1), "lo60": lo[:, -60:].min(axis=1),
           "dd252": np.fmin.reduce(np.where(c_in & (peak != 0), c / peak - 1.0, 0.0), axis=1),
           "days_since_252d_high": LOOKBACK - 1.0 - hi.argmax(axis=1), "days_since_60d_high": 59.0 - hi[:, -60:].argmax(axis=1),
           "dd_count_5pct_120d": drawdown_entries(c[:, -120:])}
    out |= {f"_c{k}": c[:, -1 - k] for k in (0, *RETURN_OFFSETS.values())}
    out |= {f"_sd_r{n}": deviation(r[:, -n:], r_in[:, -n:]) for n in (21, 63, 251, 30, 20)}
    out["_sd_r_prior"] = deviation(r[:, -120:-30], r_in[:, -120:-30])
    d, n = around(r, r_in), r_in.sum(axis=1)
    square = d * d
    m2 = square.sum(axis=1)
    out |= {"_skew": np.sqrt(n) * (square * d).sum(axis=1) / m2 ** 1.5, "_kurt": n * (square * square).sum(axis=1) / m2 ** 2 - 3.0}
    out |= {f"_ma{n}": mean(c[:, -n:], c_in[:, -n:]) for n in (20, 50, 200)}
    out["_sd20"] = deviation(c[:, -20:], c_in[:, -20:])
    # As in Spark, log1p has no value from -1 down.
    dollars, ldv_in = c * v, c_in & v_in & ~(c * v <= -1.0)
    ldv, lv, lv_in = np.log1p(dollars), np.log1p(v[:, -60:]), v_in[:, -60:] & ~(v[:, -60:] <= -1.0)
    out |= {"_ldv0": ldv[:, -1], "_ldv_avg": mean(ldv, ldv_in), "_ldv_sd": deviation(ldv, ldv_in),
            "_v20": mean(v[:, -20:], v_in[:, -20:]), "_v252": mean(v, v_in), "_lv_slope": _slope(lv, lv_in)[0]}
    pair = r_in[:, -63:] & mr_in
    dr, dm, n_m = around(r[:, -63:], pair), around(mr, pair), pair.sum(axis=1)
    out |= {"_cov_m": (dr * dm).sum(axis=1) / (n_m - 1.0), "_var_m": (dm * dm).sum(axis=1) / (n_m - 1.0), "_n_m": n_m.astype(float)}
    bar_at = np.clip(at[:, None] + np.arange(-52, 1), 0, None)
    out |= {"_above": _above_mean(close, 200)[bar_at].sum(axis=1).astype(float), "_up": (r[:, -63:] > 0).sum(axis=1).astype(float),
            "_swings": swing.window(at, -57, -2)[0].sum(axis=1)}
    lp = np.log(np.maximum(np.where(c_in, c, 1e-9), 1e-9))
    all_in = np.ones_like(c_in)
    out["_slope20"] = _slope(lp[:, -20:], all_in[:, -20:])[0]
    slope60, icpt60, syy60, sxx60 = _slope(lp[:, -60:], all_in[:, -60:])
    out |= {"_slope60": slope60, "_icpt60": icpt60, "_lp0": lp[:, -1], "_syy60": syy60, "_sxx60": sxx60}
    both = r_in[:, -20:] & v_in[:, -20:]
    out |= {"_cov_rv": (around(r[:, -20:], both) * around(v[:, -20:], both)).sum(axis=1) / both.sum(axis=1),
            "_sd_v20": deviation(v[:, -20:], v_in[:, -20:])}
    return anchor_rows(part, {"anchor_date": dates, "anchor_idx": pa.array(idx.astype(np.int32)),
                              **{k: pa.array(out[k]) for k in STATISTICS}}, owner)


def _window_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, lambda b: np.asarray(pc.list_value_length(b.column("a")))):
            with np.errstate(all="ignore"):
                yield _statistics(part)


def _features_from_aggregates() -> dict[str, Column]:
    a = lambda k: F.col(f"_{k}")
    f: dict[str, Column] = {}
    for name, k in RETURN_OFFSETS.items():
        f[name] = F.when(a(f"c{k}") > 0, F.ln(F.when(a("c0") > 0, a("c0") / a(f"c{k}")))).otherwise(0.0)
    for n, k in (("21d", 21), ("63d", 63), ("252d", 251)):
        f[f"vol_{n}"] = a(f"sd_r{k}") * ANNUAL
    # A window that starts at zero has no scale to fall from.
    f["max_dd_252d"] = F.when(a("c251") > 0, F.col("dd252")).otherwise(0.0)
    f["pct_from_252d_high"] = F.try_divide(a("c0"), F.col("hi252")) - 1.0
    f["current_dd_from_peak"] = F.when(a("c251") > 0, f["pct_from_252d_high"])
    f["pct_from_21d_high"] = F.try_divide(a("c0"), F.col("hi21")) - 1.0
    for n in (20, 50, 200):
        f[f"ratio_ma{n}"] = F.when(a(f"ma{n}") > 0, a("c0") / a(f"ma{n}")).otherwise(1.0)
    f["log_dollar_vol_z252"] = (a("ldv0") - a("ldv_avg")) / (a("ldv_sd") + 1e-9)
    f["vol_ratio_20_252"] = a("v20") / (a("v252") + 1e-9)
    f["vol_trend_slope_60d"] = a("lv_slope")
    f["skew_252d"] = F.when(a("sd_r251") > 0, a("skew"))
    f["kurt_252d"] = F.when(a("sd_r251") > 0, a("kurt"))
    f["beta_spy_63d"] = F.when((a("n_m") == 63) & (a("var_m") > 0), a("cov_m") / (a("var_m") + 1e-12))
    f["above_ma200_frac_252d"] = a("above") / float(LOOKBACK)
    f["up_day_frac_63d"] = a("up") / 63.0
    f["ret_252d_minus_21d"] = f["ret_252d"] - f["ret_21d"]
    f["vol_21d_div_252d"] = f["vol_21d"] / (f["vol_252d"] + 1e-9)
    f["slope_20"] = a("slope20")
    f["slope_60"] = a("slope60")
    f["slope_accel"] = a("slope20") - a("slope60")
    # Residual sum of squares of the 60-bar line: syy - slope^2 * sxx, never below 0.
    ssr = F.greatest(a("syy60") - a("slope60") * a("slope60") * a("sxx60"), F.lit(0.0))
    f["trendline_residual_z_60"] = (a("lp0") - a("icpt60")) / (F.sqrt(ssr / 60.0) + 1e-12)
    f["r2_log_60"] = 1.0 - ssr / (a("syy60") + 1e-12)
    f["pct_from_60d_high"] = F.try_divide(a("c0"), F.col("hi60")) - 1.0
    f["pct_from_60d_low"] = F.try_divide(a("c0"), F.col("lo60")) - 1.0
    f["swing_count_60d"] = a("swings")
    f["bb_width_pct_20"] = 4.0 * (a("sd20") + 1e-12) / F.greatest(a("ma20"), F.lit(1e-9))
    f["vol_of_vol_ratio_30_120"] = (a("sd_r30") + 1e-12) / (a("sd_r_prior") + 1e-12)
    f["ret_vol_corr_20"] = F.when(
        (a("sd_r20") > 0) & (a("sd_v20") > 0), a("cov_rv") / (a("sd_r20") * a("sd_v20")))
    return f


def compute_features(bars: DataFrame, anchors: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """The 40 features of every anchor (ticker, anchor_date, anchor_idx).

    Anchors without a full window, or whose ticker has no bars, vanish. A ticker's prepared bars and its anchors are one row;
    windows are cut at anchors only, and their statistics become features as plain columns.
    """
    full = anchors.filter(F.col("anchor_idx") >= LOOKBACK - 1).groupBy("ticker").agg(
        F.collect_list(F.struct("anchor_date", F.col("anchor_idx").cast("int").alias("anchor_idx"))).alias("a"))
    series = ["date", "close", "volume", "r", "mr", "swing"]
    packed = prepare_series(bars, market).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct(*series))).alias("p"))
    schema = (f"ticker {bars.schema['ticker'].dataType.simpleString()}, anchor_date {anchors.schema['anchor_date'].dataType.simpleString()}, "
              "anchor_idx int, " + ", ".join(f"{k} double" for k in STATISTICS))
    g = full.join(packed, "ticker").select("ticker", "a", "p").mapInArrow(_window_statistics, schema)
    feats = _features_from_aggregates()
    return g.select("ticker", "anchor_date", "anchor_idx", *[
        zero_if_bad(feats.get(c, F.col(c))).alias(c) for c in FEATURE_COLS])


def _price_statistics(bar: dict[str, Bars], at: np.ndarray) -> dict[str, np.ndarray]:
    c, c_in = bar["close"].window(at, 1 - LOOKBACK, 0)
    r, r_in = bar["r"].window(at, -62, 0)
    return {"hi252": np.where(c_in, c, -np.inf).max(axis=1), **{f"_c{k}": c[:, -1 - k] for k in (0, 63, 251)},
            "_ma200": mean(c[:, -200:], c_in[:, -200:]), "_sd_r63": deviation(r, r_in)}


#: The features that price_look_back() is enough for.
PRICE_FEATURES = ["ret_63d", "ret_252d", "vol_63d", "pct_from_252d_high", "ratio_ma200"]


def price_look_back() -> LookBack:
    """What PRICE_FEATURES are made of, to be found in the pass that makes the labels."""
    return LookBack({"r": log_return()}, ["hi252", "_c0", "_c63", "_c251", "_ma200", "_sd_r63"], _price_statistics)


def with_price_features(rows: DataFrame) -> DataFrame:
    """rows of build_labels(look_back=price_look_back()) that have a full window, with PRICE_FEATURES, as compute_features has them."""
    feats = _features_from_aggregates()
    return rows.filter(F.col("anchor_idx") >= LOOKBACK - 1).withColumns({c: zero_if_bad(feats[c]) for c in PRICE_FEATURES}).drop(
        *price_look_back().statistics)


def sanitize_features(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null, NaN and infinity become 0."""
    names = cols or [c for c in FEATURE_COLS if c in df.columns]
    return df.withColumns({c: zero_if_bad(c) for c in names})
