"""Anchor selection and forward-looking labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.config import BARRIER_PAIRS, StudyConfig, pct_tag
from tideline.functions.exprs import by_ticker, finite, flag, frame
from tideline.operators.quality import with_bar_index
from tideline.operators.windows import Bars, LookBack, anchor_rows, mean, slices, unnested


def eligible_bars(bars: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """Bars with enough history and a resolvable future: warmup <= idx < n - Hmax - 1."""
    n = F.count("*").over(Window.partitionBy("ticker"))
    return (
        with_bar_index(bars).withColumn("n_bars", n)
        .filter((F.col("idx") >= cfg.warmup) & (F.col("idx") < F.col("n_bars") - cfg.max_horizon - 1))
    )


def mark_anchors(bars: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """All bars with idx and anchor: the last eligible bar of each ISO week with at least min_week_bars eligible bars.

    Eligible bars, and those of a week, are neighbours in date order, so a look at the bars before and after tells: one
    order for all of it, no window per week.
    """
    w, more = by_ticker(), max(cfg.min_week_bars, 1) - 1
    future = cfg.max_horizon + 1  # bars that must follow
    week = F.date_trunc("week", F.col("date")).cast("date")
    b = with_bar_index(bars).withColumn("_week", week).withColumns({
        "_open": F.lead("date", future).over(w), "_next_open": F.lead("date", future + 1).over(w),
        "_next_week": F.lead("_week", 1).over(w), "_first_week": F.lag("_week", more).over(w) if more else F.col("_week")})
    ok = (F.col("idx") >= cfg.warmup) & F.col("_open").isNotNull()
    last = F.col("_next_open").isNull() | (F.col("_next_week") != F.col("_week"))
    enough = (F.col("idx") - more >= cfg.warmup) & (F.col("_first_week") == F.col("_week"))
    return b.withColumn("anchor", F.coalesce(ok & last & enough, F.lit(False))).drop(
        "_week", "_open", "_next_open", "_next_week", "_first_week")


def weekly_anchors(bars: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """Last eligible bar of each ISO week with at least min_week_bars eligible bars."""
    return mark_anchors(bars, cfg).filter("anchor").drop("anchor")


def ma_extension(window: int = 250) -> Column:
    """close over its moving average, null until the window is full."""
    w = frame(-(window - 1), 0)
    return F.when(F.count("close").over(w) == window, F.try_divide("close", F.avg("close").over(w)))


def adv(window: int = 20) -> Column:
    """Mean dollar volume, null until the window is full."""
    w = frame(-(window - 1), 0)
    dollars = F.col("close") * F.col("volume")
    return F.when(F.count(dollars).over(w) == window, F.avg(dollars).over(w))


def forward_close(h: int) -> Column:
    return F.lead("close", h).over(by_ticker())


def forward_return(h: int) -> Column:
    """Null where the anchor close is not positive; a zero end close is a real loss of 100%."""
    return F.when(F.col("close") > 0, forward_close(h) / F.col("close") - 1.0)


def forward_log_return(h: int) -> Column:
    ratio = forward_close(h) / F.when(F.col("close") > 0, F.col("close"))
    return finite(F.ln(F.when(ratio > 0, ratio)))


def resolution_date(h: int) -> Column:
    return F.lead("date", h).over(by_ticker())


#: Bars of one block of a window join.
BLOCK = 252


def anchor_windows(bars: DataFrame, anchors: DataFrame, lo: int, hi: int, cols: list[str]) -> DataFrame:
    """Every anchor row with the bars at offsets lo..hi around it, as ``off`` and ``cols``.

    Both sides are keyed by ticker and block of BLOCK bars, an anchor once for each block that its window meets, so an
    anchor meets at most those blocks, whatever the length of the history, and a long ticker is spread over tasks. The
    pairs are never stored but flow into the aggregate that follows, and only anchors pay for their window: a sliding
    frame would evaluate it for every bar.
    """
    block = lambda i: F.floor(i / BLOCK)
    b = bars.select(F.col("ticker").alias("_bticker"), F.col("idx").alias("_bidx"), block(F.col("idx")).alias("_bblock"),
                    *[F.col(c).alias(f"w_{c}") for c in cols])
    a = anchors.withColumn("_block", F.explode(F.sequence(block(F.col("anchor_idx") + lo), block(F.col("anchor_idx") + hi))))
    off = F.col("_bidx") - F.col("anchor_idx")
    joined = a.join(b, (F.col("ticker") == F.col("_bticker")) & (F.col("_block") == F.col("_bblock")) & off.between(lo, hi))
    return joined.withColumn("off", off).drop("_bidx", "_bticker", "_block", "_bblock")


def path_label_columns(h: int) -> dict[str, Column]:
    """Labels that are plain algebra on fwd_ret, fwd_mfe and fwd_mae."""
    up, down, ret = F.col(f"fwd_mfe_{h}d"), F.col(f"fwd_mae_{h}d"), F.col(f"fwd_ret_{h}d")
    loss = F.greatest(F.abs(down), F.lit(1e-4))
    out = {
        f"tb_approx_{h}d_T{pct_tag(t)}_S{pct_tag(s)}": flag((up >= t) & (down > -s)).cast("tinyint")
        for t, s in BARRIER_PAIRS
    }
    out[f"mfe_mae_ratio_{h}d"] = (up / loss).cast("float")
    out[f"sortino_label_{h}d"] = (F.greatest(ret, F.lit(0.0)) / loss).cast("float")
    out[f"upside_dominance_{h}d"] = flag(up > loss).cast("tinyint")
    out[f"clean_run_{h}d"] = flag((up >= 0.05) & (down > -0.02)).cast("tinyint")
    return out


def threshold_columns(h: int, thresholds: tuple[float, ...]) -> dict[str, Column]:
    return {f"ret_{h}d_ge_{pct_tag(t)}pct": flag(F.col(f"fwd_ret_{h}d") >= t).cast("tinyint")
            for t in thresholds}


def anchor_frame(bars: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """Weekly anchors with their keys only."""
    return weekly_anchors(bars, cfg).filter(F.col("close") > 0).select(
        "ticker", F.col("date").alias("anchor_date"), F.col("close").alias("anchor_close"),
        F.col("idx").alias("anchor_idx"))


def _later_close(close: Bars, at: np.ndarray, last: np.ndarray) -> pa.Array:
    """The first close that is not null among the bars from `at` to `last`."""
    n = len(close.there)
    following = np.minimum.accumulate(np.where(close.there, np.arange(n), n)[::-1])[::-1]
    found = following[np.minimum(at, n - 1)]
    return pa.array(close.values[np.minimum(found, n - 1)], mask=(at > last) | (found > last))


def _outcomes(part: pa.RecordBatch, cfg: StudyConfig, find: Callable | None) -> pa.RecordBatch:
    """What lies around the anchors of some tickers: means before, closes, dates and extremes after them."""
    size, bar = unnested(part.column("p"))
    at = np.flatnonzero(np.asarray(bar["anchor"]))
    owner = np.repeat(np.arange(len(size)), size)[at]
    first = (np.cumsum(size) - size)[owner]
    idx, left = at - first, (first + size[owner])[:, None] - at[:, None]
    close, dates = Bars(bar["close"]), bar["date"]
    dollars = Bars(pc.multiply(bar["close"], bar["volume"]))

    def before(b: Bars, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean and number of the n bars ending at each anchor; none where the history is shorter."""
        x, there = b.window(at, 1 - n, 0)
        there &= (idx >= n - 1)[:, None]
        return mean(x, there), there.sum(axis=1)

    ma, n_ma = before(close, cfg.ma_window)
    adv20, n_adv = before(dollars, cfg.adv_window)
    found = {"anchor_date": dates.take(pa.array(at)), "anchor_close": pa.array(close.values[at]), "anchor_idx": pa.array(idx, pa.int32()),
             "_ma": pa.array(ma, mask=n_ma == 0), "_ma_n": pa.array(n_ma.astype(float)), "adv20_usd": pa.array(adv20, mask=n_adv == 0)}
    after = np.arange(1, cfg.max_horizon + 1)
    x, there = close.window(at, 1, cfg.max_horizon, after < left)
    hi, lo = np.where(there, x, -np.inf), np.where(there & ~np.isnan(x), x, np.inf)  # Spark's order: NaN above all
    for h in cfg.horizons:
        none = ~there[:, :h].any(axis=1)
        found |= {f"_end_{h}": pa.array(x[:, h - 1], mask=~there[:, h - 1]),
                  f"resolution_date_{h}d": dates.take(pa.array(at + h, mask=left[:, 0] <= h)),
                  f"_hi_{h}": pa.array(hi[:, :h].max(axis=1), mask=none), f"_lo_{h}": pa.array(lo[:, :h].min(axis=1), mask=none)}
        if find is not None:
            found[f"exit_close_{h}d"] = _later_close(close, at + h, first + size[owner] - 1)
    if find is not None:
        columns = {k: close if k == "close" else Bars(v) for k, v in bar.items() if k not in ("date", "volume", "anchor")}
        found |= {k: pa.array(v) for k, v in find(columns, at).items()}
    return anchor_rows(part, found, owner)


def build_labels(bars: DataFrame, cfg: StudyConfig = StudyConfig(), prefilter_only: bool = False,
                 look_back: LookBack | None = None) -> DataFrame:
    """All labels of every weekly anchor. A ticker's bars are one row, as long as the calendar; windows are cut at anchors
    only, and what follows from them is plain columns.

    With look_back its statistics are columns too, and exit_close_*d: the close at the resolution date, or the next there is.
    """
    series = look_back.series if look_back else {}
    extra = look_back.statistics if look_back else []
    kept = mark_anchors(bars, cfg).select(
        "ticker", "date", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"),
        (F.col("anchor") & F.coalesce(F.col("close") > 0, F.lit(False))).alias("anchor"), *[c.alias(k) for k, c in series.items()])
    packed = kept.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", "close", "volume", "anchor", *series))).alias("p"),
                                        F.count_if("anchor").alias("n")).filter("n > 0")
    cells = [f"_end_{h} double, resolution_date_{h}d date, _hi_{h} double, _lo_{h} double" + (f", exit_close_{h}d double" if look_back else "")
             for h in cfg.horizons]
    schema = ", ".join([f"ticker {bars.schema['ticker'].dataType.simpleString()}", "anchor_date date", "anchor_close double",
                        "anchor_idx int", "_ma double", "_ma_n double", "adv20_usd double", *cells, *[f"{k} double" for k in extra]])
    find = look_back.find if look_back else None

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, lambda b: np.asarray(b.column("n"))):
                with np.errstate(all="ignore"):
                    yield _outcomes(part, cfg, find)

    g = packed.mapInArrow(look, schema)
    base = F.col("anchor_close")
    g = g.withColumn("ratio_ma250", F.when(F.col("_ma_n") == cfg.ma_window, base / F.col("_ma")))
    level1 = {"prefilter_ma250_15": flag(F.col("ratio_ma250") > cfg.ma_extension).cast("tinyint")}
    for h in cfg.horizons:
        end = F.col(f"_end_{h}")
        level1[f"fwd_ret_{h}d"] = end / base - 1.0
        level1[f"fwd_log_ret_{h}d"] = F.ln(F.when(end > 0, end / base))
        level1[f"fwd_mfe_{h}d"] = F.greatest(F.lit(0.0), F.col(f"_hi_{h}") / base - 1.0)
        level1[f"fwd_mae_{h}d"] = F.least(F.lit(0.0), F.col(f"_lo_{h}") / base - 1.0)
    g = g.withColumns(level1)
    if prefilter_only:
        g = g.filter(F.col("prefilter_ma250_15") == 1)
    level2: dict[str, Column] = {}
    for h in cfg.horizons:
        level2.update(threshold_columns(h, cfg.thresholds))
        level2.update(path_label_columns(h))
    return g.withColumns(level2).drop(
        "_ma", "_ma_n", *[f"_{k}_{h}" for h in cfg.horizons for k in ("end", "hi", "lo")])


def long_labels(labels: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """One row per anchor, horizon and threshold."""
    cells = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lit(int(round(t * 100))).alias("threshold_pct"),
                 F.col(f"fwd_ret_{h}d").alias("fwd_ret"),
                 F.col(f"ret_{h}d_ge_{pct_tag(t)}pct").cast("int").alias("hit"))
        for h in cfg.horizons for t in cfg.thresholds])
    return labels.select("ticker", "anchor_date", F.inline(cells))


def latest_candidates(bars: DataFrame, today: str, cfg: StudyConfig = StudyConfig(),
                      prefilter: bool = True) -> DataFrame:
    """The newest bar up to ``today`` of every ticker, where it can be bought now.

    Not trimmed by any horizon: the future of such a row is still open. The newest position is a
    mergeable aggregate; only the windows ending there are then read.
    """
    seen = with_bar_index(bars.filter(F.col("date") <= F.to_date(F.lit(today))))
    newest = seen.groupBy("ticker").agg(F.max("idx").alias("anchor_idx"), F.max("date").alias("anchor_date"))
    newest = newest.filter(F.col("anchor_idx") >= max(cfg.warmup, cfg.ma_window) - 1)
    win = anchor_windows(seen, newest, 1 - cfg.ma_window, 0, ["close", "volume"])
    off, close = F.col("off"), F.col("w_close")
    g = win.groupBy("ticker", "anchor_date", "anchor_idx").agg(
        F.max(F.when(off == 0, close)).alias("anchor_close"),
        F.avg(close).alias("_ma"),
        F.avg(F.when(off > -cfg.adv_window, close * F.col("w_volume"))).alias("adv20_usd"),
    )
    ok = finite("anchor_close").isNotNull() & (F.col("anchor_close") > 0) & (F.col("_ma") > 0)
    if prefilter:
        ok = ok & (F.try_divide("anchor_close", "_ma") > cfg.ma_extension)
    return g.filter(ok).select("ticker", "anchor_date", "anchor_idx", "anchor_close", "adv20_usd",
                               F.try_divide("anchor_close", "_ma").alias("ratio_ma250"))
