"""Costing of picks: a ledger of independent trades and the equity curve of the sleeve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.config import LedgerConfig
from tideline.functions.exprs import finite, uniform
from tideline.operators.joins import dates_inside, next_bar_join
from tideline.operators.quality import has_bars, with_bar_index
from tideline.operators.ranking import no_overlap_selection, rank_bounds, reachable
from tideline.session import cut

# Probability that an order of a liquidity tier is missed.
HALT_RATES = {"micro": 0.018, "small": 0.008, "mid": 0.003, "large": 0.001}


def bars_of(bars: DataFrame, rows: DataFrame) -> DataFrame:
    """Bars of the tickers in ``rows`` only.

    Selection leaves a few tickers out of many, so this keeps the panel from being shuffled for them;
    whether the ticker list is broadcast is left to its measured size.
    """
    return bars.join(rows.select("ticker").distinct(), "ticker", "left_semi")


def tradable_filter(picks: DataFrame, bars: DataFrame | None, cfg: LedgerConfig = LedgerConfig()) -> DataFrame:
    ok = picks.filter(
        finite("adv20_usd").isNotNull() & (F.col("adv20_usd") >= cfg.min_adv_usd)
        & finite("anchor_close").isNotNull() & (F.col("anchor_close") > 0))
    return ok if bars is None else has_bars(ok, bars)


def position_size(cfg: LedgerConfig = LedgerConfig(), equity: Column | None = None) -> Column:
    base = F.lit(cfg.start_equity) if equity is None else equity
    return F.least(base * cfg.max_position_pct, F.col("adv20_usd") * cfg.max_adv_pct)


def impact_bps(position: Column, adv: Column, cfg: LedgerConfig = LedgerConfig()) -> Column:
    """One-way impact in basis points, square-root law with a permanent share."""
    temporary = F.lit(cfg.daily_vol * cfg.impact_eta) * F.pow(position / adv, F.lit(cfg.impact_beta))
    bps = temporary * (1.0 + cfg.permanent_frac / 2.0) * 1e4
    clamped = F.greatest(F.lit(cfg.impact_min_bps), F.least(F.lit(cfg.impact_max_bps), bps))
    return F.when((adv > 0) & (position > 0), clamped).otherwise(cfg.impact_min_bps)


def slippage_bps(position: Column, adv: Column, cfg: LedgerConfig = LedgerConfig()) -> Column:
    return impact_bps(position, adv, cfg) if cfg.use_impact else F.lit(cfg.slippage_bps)


def slipped(price: Column, bps: Column, side: str) -> Column:
    return price * (1.0 + bps / 1e4) if side == "buy" else price * (1.0 - bps / 1e4)


def commission(shares: Column, value: Column, cfg: LedgerConfig = LedgerConfig()) -> Column:
    return F.least(shares * cfg.commission_per_share, cfg.commission_cap * value)


def cap_tier(adv: Column | str = "adv20_usd") -> Column:
    a = F.col(adv) if isinstance(adv, str) else adv
    return F.when(a < 5e6, "micro").when(a < 50e6, "small").when(a < 500e6, "mid").otherwise("large")


def halt_draw(seed: int, *keys: str) -> Column:
    """True where the entry order of a pick is missed."""
    tier = cap_tier()
    rate = F.coalesce(*[F.when(tier == t, F.lit(r)) for t, r in HALT_RATES.items()])
    day = F.date_format("anchor_date", "yyyy-MM-dd")
    return uniform("halt", seed, *keys, "ticker", day) < rate


def integer_shares(target: Column, fill: Column) -> Column:
    return F.floor(target / fill).cast("bigint")


def open_trades(picks: DataFrame, bars: DataFrame | None, cfg: LedgerConfig = LedgerConfig(),
                keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """Entry side: size, fill, shares and cost of each pick that can be bought."""
    p = tradable_filter(picks, bars, cfg).withColumn("target_usd", position_size(cfg))
    p = p.filter(F.col("target_usd") >= cfg.min_position_usd)
    if cfg.halt_risk:
        p = p.filter(~halt_draw(cfg.halt_seed, *keys))
    p = p.withColumn("entry_slippage_bps", slippage_bps(F.col("target_usd"), F.col("adv20_usd"), cfg))
    p = p.withColumn("entry_price", slipped(F.col("anchor_close"), F.col("entry_slippage_bps"), "buy"))
    p = p.withColumn("shares", integer_shares(F.col("target_usd"), F.col("entry_price"))).filter("shares > 0")
    value = F.col("shares") * F.col("entry_price")
    return p.withColumn("cost", value + commission(F.col("shares"), value, cfg)).withColumnRenamed(
        "anchor_date", "entry_date")


def fixed_exit(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Exit bar: the resolution date or the next bar the ticker has, never an earlier one."""
    return next_bar_join(trades, bars, "resolution_date").withColumnsRenamed(
        {"next_date": "exit_date", "next_close": "exit_close"})


def trailing_stop(trades: DataFrame, bars: DataFrame, pct: float, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """First bar after entry and before the scheduled exit that closes ``pct`` below the running peak.

    The peak starts at the entry fill. Returns the keys of stopped trades with stop_date, stop_close.
    """
    ids = [*keys, "ticker", "entry_date"]
    t = trades.select(*ids, "entry_price", "resolution_date")
    b = bars.select(F.col("ticker").alias("_bt"), F.col("date").alias("_d"), F.col("close").alias("_c"))
    path = t.join(b, (F.col("ticker") == F.col("_bt")) & (F.col("_d") > F.col("entry_date"))
                  & (F.col("_d") < F.col("resolution_date")))
    w = Window.partitionBy(*ids).orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peak = F.greatest(F.col("entry_price"), F.max("_c").over(w), F.lit(1e-9))
    hit = path.withColumn("_peak", peak).filter(F.col("_c") / F.col("_peak") - 1.0 <= -pct)
    return hit.groupBy(*ids).agg(F.min("_d").alias("stop_date"), F.min_by("_c", "_d").alias("stop_close"))


def forced_close(trades: DataFrame, bars: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Trades without an exit bar close on the last day of all bars, at the close or the entry price."""
    last = bars.agg(F.max("date")).scalar()
    final = bars_of(bars, trades if tickers is None else tickers).filter(F.col("date") == last).select("ticker", F.col("close").alias("_final"))
    j = trades.join(final, "ticker", "left").withColumn("forced_close", F.col("exit_date").isNull())
    return j.withColumns({
        "exit_close": F.when(F.col("forced_close"), F.coalesce("_final", "entry_price")).otherwise(F.col("exit_close")),
        "exit_date": F.coalesce("exit_date", bars.agg(F.max("date")).scalar()),
    }).drop("_final")


def purchases(scores: DataFrame, bars: DataFrame, cfg: LedgerConfig = LedgerConfig(),
              keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """The candidates that purchases can come to, with their rank and scheduled exit (null: none in the bars).

    What fails a gate, is too small, is halted or gives no share takes no place. Of the others each date keeps as many as
    its purchases can reach past tickers that are still held; a stop only frees tickers earlier. Scores that bring exit_date
    and exit_close were made from these bars, which are not read again then.
    """
    known = {"exit_date", "exit_close"} <= set(scores.columns)
    closed = cut(open_trades(scores, None, cfg, keys) if known else fixed_exit(open_trades(scores, bars, cfg, keys), bars))
    bounds = rank_bounds(closed, cfg.max_new_per_week, keys, "entry_date", "exit_date")
    return reachable(closed, cut(bounds), keys, "entry_date")


def exits(trades: DataFrame, bars: DataFrame, cfg: LedgerConfig = LedgerConfig(), keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """exit_date, exit_close and forced_close of each trade: the stop, the scheduled bar, or the end of all bars."""
    own = bars_of(bars, trades)
    t = trades if "exit_date" in trades.columns else fixed_exit(trades, own)
    if cfg.trailing_stop_pct > 0:
        stops = trailing_stop(t, own, cfg.trailing_stop_pct, keys)
        t = t.join(stops, [*keys, "ticker", "entry_date"], "left").withColumns({
            "exit_close": F.coalesce("stop_close", "exit_close"),
            "exit_date": F.coalesce("stop_date", "exit_date"),
        }).drop("stop_date", "stop_close")
    return forced_close(t, bars, trades)


def held_trades(candidates: DataFrame, bars: DataFrame, cfg: LedgerConfig = LedgerConfig(),
                keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """The trades that are made, with their exits: a held ticker is passed over until its real exit, the next moves up."""
    return no_overlap_selection(exits(candidates, bars, cfg, keys), cfg.max_new_per_week, keys, "entry_date", "exit_date")


def trade_ledger(bought: DataFrame, bars: DataFrame, cfg: LedgerConfig = LedgerConfig(),
                 keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """All trades with both fills, costs and the return after costs. bought: purchases(), cut, as they are read often."""
    return booked(held_trades(bought, bars, cfg, keys), cfg, keys)


def booked(trades: DataFrame, cfg: LedgerConfig = LedgerConfig(), keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """Ledger rows of trades that are made: the exit fill, costs and the return after costs."""
    t = trades.withColumn("exit_slippage_bps", slippage_bps(F.col("cost"), F.col("adv20_usd"), cfg))
    t = t.withColumn("exit_price", slipped(F.col("exit_close"), F.col("exit_slippage_bps"), "sell"))
    t = t.withColumn("proceeds", F.col("shares") * F.col("exit_price"))
    t = t.withColumn("commission_total", commission(F.col("shares"), F.col("proceeds"), cfg))
    ret = (F.col("proceeds") - F.col("commission_total") - F.col("cost")) / F.col("cost")
    return t.withColumn("trade_return_pct", ret).select(
        *keys, "ticker", "entry_date", "exit_date", "entry_price", "exit_price", "shares", "cost", "proceeds",
        "commission_total", "trade_return_pct", "exit_slippage_bps", "forced_close", "score")


def mark_to_market(ledger: DataFrame, bars: DataFrame, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """Value of each trade on every calendar day after entry up to the exit.

    A day without a bar of the ticker is valued at the entry price, the exit day at the net proceeds.
    """
    held = ledger.filter(F.col("exit_date") > F.col("entry_date")).withColumn("_from", F.date_add("entry_date", 1))
    days = dates_inside(held, "_from", "exit_date", bars)
    b = bars_of(bars, ledger).select("ticker", F.col("date").alias("day"), "close")
    j = days.join(b, ["ticker", "day"], "left")
    value = F.when(F.col("day") == F.col("exit_date"), F.col("proceeds") - F.col("commission_total")).otherwise(
        F.col("shares") * F.coalesce("close", "entry_price"))
    return j.select(*keys, "ticker", "entry_date", "exit_date", "cost", F.col("day").alias("date"),
                    value.alias("value"))


def key_calendar(ledger: DataFrame, bars: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Every key with every calendar day; the calendar is an array of distinct days, bounded by time."""
    cal = bars.agg(F.array_sort(F.collect_set("date"))).scalar()
    return ledger.select(*keys).distinct().withColumn("date", F.explode(cal))


def open_positions_by_day(ledger: DataFrame, bars: DataFrame, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """Trades open on each calendar day: entered before it and not yet closed on it."""
    events = ledger.select(*keys, F.explode(F.array(
        F.struct(F.date_add("entry_date", 1).alias("date"), F.lit(1).alias("step")),
        F.struct(F.col("exit_date").alias("date"), F.lit(-1).alias("step")))).alias("e")).select(*keys, "e.*")
    days = key_calendar(ledger, bars, keys).withColumn("step", F.lit(0)).withColumn("on_calendar", F.lit(1))
    line = days.unionByName(events, allowMissingColumns=True).groupBy(*keys, "date").agg(
        F.sum("step").alias("step"), F.max("on_calendar").alias("on_calendar"))
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return line.withColumn("n_positions", F.sum("step").over(w)).filter("on_calendar = 1").select(
        *keys, "date", "n_positions")


def trade_returns(ledger: DataFrame, bars: DataFrame, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """(keys, ticker, entry_date, exit_date, date, ret): each trade's return on every day it is held."""
    mtm = mark_to_market(ledger, bars, keys)
    prev = F.lag("value").over(Window.partitionBy(*keys, "ticker", "entry_date").orderBy("date"))
    # A trade that was worth nothing the day before has no further return.
    ret = F.coalesce(F.try_divide(F.col("value"), F.coalesce(prev, "cost")) - 1.0, F.lit(0.0))
    return mtm.select(*keys, "ticker", "entry_date", "exit_date", "date", ret.alias("ret"))


def sleeve_equity_curve(ledger: DataFrame, bars: DataFrame, cfg: LedgerConfig = LedgerConfig(),
                        keys: tuple[str, ...] = ("track",), daily: DataFrame | None = None) -> DataFrame:
    """Daily equity of a sleeve holding every open trade at a fixed weight, gross at most 100%.

    daily: the ledger's trade_returns, where the caller has them.
    """
    daily = trade_returns(ledger, bars, keys) if daily is None else daily
    per_day = daily.groupBy(*keys, "date").agg(
        F.sum("ret").alias("sum_ret"), F.count("*").alias("n_active"),
        F.count_if(F.col("date") < F.col("exit_date")).alias("n_open"))
    weight = F.least(F.lit(cfg.max_position_pct), 1.0 / F.col("n_active"))
    day = key_calendar(ledger, bars, keys).join(per_day, [*keys, "date"], "left").select(
        *keys, "date",
        F.coalesce(F.col("sum_ret") * weight, F.lit(0.0)).alias("ret"),
        F.coalesce(F.col("n_active") * weight, F.lit(0.0)).alias("gross"),
        F.coalesce("n_open", F.lit(0)).cast("bigint").alias("n_positions"))
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return day.withColumn("equity", cfg.start_equity * F.exp(F.sum(F.log1p("ret")).over(w))).withColumn(
        "cash", F.col("equity") * (1.0 - F.col("gross")))
