"""SQL building blocks of the result checks, written independently of the DataFrame plans."""

from __future__ import annotations

import re

from tideline.config import BARRIER_PAIRS, HORIZONS, THRESHOLDS, LedgerConfig, pct_tag
from tideline.functions.normal import norm_cdf_sql

# Fixed values, written out again so that an error in the engine's tables shows.
HALT_RATES = {"micro": 0.018, "small": 0.008, "mid": 0.003, "large": 0.001}
BASELINES = {
    "rank_252d_return": "ret_252d",
    "rank_60d_return": "ret_63d",
    "rank_ma250_extension": "ratio_ma200",
    "rank_52w_high_distance": "-abs(pct_from_252d_high)",
    "rank_inv_60d_vol": "-vol_63d",
}
LEDGER = {
    "start_equity": 100_000.0, "max_position_pct": 0.04, "max_new_per_week": 5, "max_adv_pct": 0.005, "min_adv_usd": 5_000_000.0,
    "min_position_usd": 100.0, "slippage_bps": 10.0, "commission_per_share": 0.005, "commission_cap": 0.005, "trailing_stop_pct": 0.0,
    "use_impact": False, "impact_eta": 0.142, "impact_beta": 0.5, "permanent_frac": 0.5, "daily_vol": 0.03, "impact_min_bps": 1.0,
    "impact_max_bps": 500.0, "halt_risk": False, "halt_seed": 42}


def r(x: str, n: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE), {n}) + 0.0)"


def u01(*parts: str, start: int = 1) -> str:
    key = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5({key}), {start}, 12) AS BIGINT) / 281474976710656.0)"


def win(lo: int, hi: int) -> str:
    def edge(k: int) -> str:
        return "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"

    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {edge(lo)} AND {edge(hi)})"


W = "OVER (PARTITION BY ticker ORDER BY date)"
DAY = "CAST(CAST(l_shipdate AS DATE) - greatest(CAST(isodow(CAST(l_shipdate AS DATE)) AS INT) - 5, 0) AS DATE)"
FRIDAY = "CAST(CAST(date_trunc('week', l_shipdate) AS DATE) + 4 AS DATE)"
TICKER = "'S' || lpad(CAST({} AS VARCHAR), 9, '0')"


def _walk(src: str, part: str, key: str) -> str:
    return f"""SELECT {key} date, coalesce(lag(close) OVER ({part} ORDER BY date), 100.0) open,
      greatest(close, coalesce(lag(close) OVER ({part} ORDER BY date), 100.0)) high,
      least(close, coalesce(lag(close) OVER ({part} ORDER BY date), 100.0)) low, close, volume FROM (
      SELECT {key} date, q * 1000.0 volume,
        round(100.0 * exp(sum((sdc - 5 * n) / (CAST(100.0 AS DOUBLE) * sqrt(n))) OVER ({part} ORDER BY date)), 4) close
      FROM {src})"""


def _daily(key: str, day: str) -> str:
    return f"""SELECT {key} {day} date, count(*) n, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) sdc,
      sum(l_quantity) q FROM lineitem GROUP BY ALL"""


CTES: dict[str, str] = {
    "g_bars": _daily(TICKER.format("l_suppkey") + " ticker,", DAY),
    "bars": _walk("g_bars", "PARTITION BY ticker", "ticker,"),
    "g_market": _daily("", DAY),
    "market": _walk("g_market", "", ""),
    "g_wmarket": _daily("", FRIDAY),
    "wmarket": _walk("g_wmarket", "", ""),
    "ix": f"SELECT *, CAST(row_number() {W} - 1 AS INT) idx, count(*) OVER (PARTITION BY ticker) n_bars FROM bars",
    "elig": "SELECT * FROM ix WHERE idx >= 252 AND idx < n_bars - 41",
    "weekly": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ticker, date_trunc('week', date)) wn,
        max(date) OVER (PARTITION BY ticker, date_trunc('week', date)) wl FROM elig) WHERE wn >= 3 AND date = wl""",
    "univ": f"SELECT {TICKER.format('s_suppkey')} ticker, s_acctbal >= 0 active FROM supplier",
}


def _labels_sql() -> str:
    cols = [
        f"CASE WHEN count(*) {win(-249, 0)} = 250 THEN close / avg(close) {win(-249, 0)} END ratio_ma250",
        f"CASE WHEN count(*) {win(-19, 0)} = 20 THEN avg(close * volume) {win(-19, 0)} END adv20_usd",
    ]
    for h in HORIZONS:
        cols += [
            f"lead(close, {h}) {W} / close - 1 fwd_ret_{h}d",
            f"ln(CASE WHEN lead(close, {h}) {W} > 0 THEN lead(close, {h}) {W} / close END) fwd_log_ret_{h}d",
            f"lead(date, {h}) {W} resolution_date_{h}d",
            f"greatest(0.0, max(close) {win(1, h)} / close - 1) fwd_mfe_{h}d",
            f"least(0.0, min(close) {win(1, h)} / close - 1) fwd_mae_{h}d",
        ]
    return f"SELECT *, {', '.join(cols)} FROM ix"


CTES["future"] = _labels_sql()
CTES["outcomes"] = """SELECT f.ticker, f.date anchor_date, f.close anchor_close, f.idx anchor_idx,
    f.* EXCLUDE (ticker, date, open, high, low, close, volume, idx, n_bars) FROM future f
    SEMI JOIN weekly w ON f.ticker = w.ticker AND f.date = w.date WHERE f.close > 0"""


def path_label_sql(h: int) -> dict[str, str]:
    up, dn, rt = f"fwd_mfe_{h}d", f"fwd_mae_{h}d", f"fwd_ret_{h}d"
    loss = f"greatest(abs({dn}), 1e-4)"
    out = {f"tb_approx_{h}d_T{pct_tag(t)}_S{pct_tag(s)}": f"CAST(({up} >= {t} AND {dn} > -{s}) AS INT)"
           for t, s in BARRIER_PAIRS}
    out[f"mfe_mae_ratio_{h}d"] = f"{up} / {loss}"
    out[f"sortino_label_{h}d"] = f"greatest({rt}, 0.0) / {loss}"
    out[f"upside_dominance_{h}d"] = f"CAST({up} > {loss} AS INT)"
    out[f"clean_run_{h}d"] = f"CAST(({up} >= 0.05 AND {dn} > -0.02) AS INT)"
    return out


def flag_sql(h: int, t: float) -> str:
    return f"CAST(coalesce(fwd_ret_{h}d >= {t}, false) AS INT)"


CTES["aligned"] = f"""SELECT i.*, coalesce(last_value(m.close IGNORE NULLS) OVER (PARTITION BY i.ticker ORDER BY i.date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(m.close IGNORE NULLS) OVER (PARTITION BY i.ticker ORDER BY i.date
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) mkt
    FROM ix i LEFT JOIN market m ON i.date = m.date"""
CTES["walign"] = CTES["aligned"].replace("JOIN market", "JOIN wmarket")
CTES["steps"] = f"""SELECT *, ln(close / lag(close) {W}) ret1, ln(mkt / lag(mkt) {W}) mr,
    avg(close) {win(-199, 0)} m200, ln(1 + volume) lv, ln(1 + close * volume) ldv, ln(greatest(close, 1e-9)) lp,
    CASE WHEN (close > lag(close, 1) {W} AND close > lag(close, 2) {W} AND close > lead(close, 1) {W} AND close > lead(close, 2) {W})
      OR (close < lag(close, 1) {W} AND close < lag(close, 2) {W} AND close < lead(close, 1) {W} AND close < lead(close, 2) {W})
    THEN 1 ELSE 0 END swing FROM aligned"""


def _feature_sql() -> str:
    w = win
    ret = {n: f"ln(close / lag(close, {k}) {W})" for n, k in
           (("1d", 1), ("5d", 5), ("21d", 21), ("63d", 63), ("126d", 126), ("252d", 251))}
    vol = {n: f"stddev_pop(ret1) {w(1 - k, 0)} * sqrt(252)" for n, k in (("21d", 21), ("63d", 63), ("252d", 251))}
    m = {k: f"avg(ret1 ** {k}) {w(-250, 0)}" for k in (1, 2, 3)}
    var = f"({m[2]} - ({m[1]}) ** 2)"
    s20, s60 = f"regr_slope(lp, idx) {w(-19, 0)}", f"regr_slope(lp, idx) {w(-59, 0)}"
    ssr = (f"greatest(regr_syy(lp, idx) {w(-59, 0)} - ({s60}) ** 2 * regr_sxx(lp, idx) {w(-59, 0)}, 0.0)")
    f = {f"ret_{n}": e for n, e in ret.items()}
    f |= {f"vol_{n}": e for n, e in vol.items()}
    f["current_dd_from_peak"] = f["pct_from_252d_high"] = f"close / max(close) {w(-251, 0)} - 1"
    f["pct_from_21d_high"] = f"close / max(close) {w(-20, 0)} - 1"
    for n in (20, 50, 200):
        f[f"ratio_ma{n}"] = f"close / avg(close) {w(1 - n, 0)}"
    f["log_dollar_vol_z252"] = f"(ldv - avg(ldv) {w(-251, 0)}) / (stddev_pop(ldv) {w(-251, 0)} + 1e-9)"
    f["vol_ratio_20_252"] = f"avg(volume) {w(-19, 0)} / (avg(volume) {w(-251, 0)} + 1e-9)"
    f["vol_trend_slope_60d"] = f"regr_slope(lv, idx) {w(-59, 0)}"
    f["skew_252d"] = f"({m[3]} - 3 * ({m[1]}) * ({m[2]}) + 2 * ({m[1]}) ** 3) / {var} ** 1.5"
    f["kurt_252d"] = f"kurtosis_pop(ret1) {w(-250, 0)}"
    f["beta_spy_63d"] = f"covar_samp(ret1, mr) {w(-62, 0)} / (var_samp(mr) {w(-62, 0)} + 1e-12)"
    f["above_ma200_frac_252d"] = f"sum(CAST(close > m200 AS INT)) {w(-52, 0)} / 252.0"
    f["up_day_frac_63d"] = f"avg(CAST(ret1 > 0 AS INT)) {w(-62, 0)}"
    f["ret_252d_minus_21d"] = f"{ret['252d']} - {ret['21d']}"
    f["vol_21d_div_252d"] = f"{vol['21d']} / ({vol['252d']} + 1e-9)"
    f["slope_20"], f["slope_60"], f["slope_accel"] = s20, s60, f"{s20} - {s60}"
    f["trendline_residual_z_60"] = (
        f"(lp - ({s60} * idx + regr_intercept(lp, idx) {w(-59, 0)})) / (sqrt({ssr} / 60) + 1e-12)")
    f["r2_log_60"] = f"1 - {ssr} / (regr_syy(lp, idx) {w(-59, 0)} + 1e-12)"
    f["pct_from_60d_high"] = f"close / max(close) {w(-59, 0)} - 1"
    f["pct_from_60d_low"] = f"close / min(close) {w(-59, 0)} - 1"
    f["swing_count_60d"] = f"sum(swing) {w(-57, -2)}"
    f["bb_width_pct_20"] = f"4 * (stddev_pop(close) {w(-19, 0)} + 1e-12) / greatest(avg(close) {w(-19, 0)}, 1e-9)"
    f["vol_of_vol_ratio_30_120"] = f"(stddev_pop(ret1) {w(-29, 0)} + 1e-12) / (stddev_pop(ret1) {w(-119, -30)} + 1e-12)"
    f["ret_vol_corr_20"] = f"coalesce(corr(ret1, volume) {w(-19, 0)}, 0)"
    f["arr"] = f"list(close) {w(-251, 0)}"
    f["varr"] = f"list(lv) {w(-251, 0)}"
    return "SELECT *, " + ", ".join(f"{e} {n}" for n, e in f.items()) + " FROM steps"


CTES["allfeat"] = _feature_sql()
CTES["anchfeat"] = """SELECT a.* FROM allfeat a SEMI JOIN outcomes l ON a.ticker = l.ticker AND a.date = l.anchor_date
    WHERE a.idx >= 251"""
CTES["feats"] = """SELECT * RENAME (date AS anchor_date, idx AS anchor_idx),
    list_reduce(list_transform(arr, lambda v: {'p': v, 'd': CAST(0.0 AS DOUBLE)}),
      lambda a, b: {'p': greatest(a.p, b.p), 'd': least(a.d, b.p / greatest(a.p, b.p) - 1)}).d max_dd_252d,
    CAST(252 - list_position(arr, list_max(arr)) AS DOUBLE) days_since_252d_high,
    CAST(60 - list_position(arr[193:252], list_max(arr[193:252])) AS DOUBLE) days_since_60d_high,
    CAST(list_reduce(list_transform(arr[133:252], lambda v: {'p': v, 'i': 0, 'n': 0}),
      lambda a, b: {'p': greatest(a.p, b.p),
        'i': CASE WHEN a.i = 0 AND b.p / greatest(a.p, b.p) - 1 <= -0.05 THEN 1
                  WHEN a.i = 1 AND b.p / greatest(a.p, b.p) - 1 >= -0.005 THEN 0 ELSE a.i END,
        'n': a.n + CASE WHEN a.i = 0 AND b.p / greatest(a.p, b.p) - 1 <= -0.05 THEN 1 ELSE 0 END}).n AS DOUBLE)
      dd_count_5pct_120d
    FROM anchfeat"""

# --- selection and ledger ------------------------------------------------------------------------

CTES["scores"] = " UNION ALL ".join(
    f"""SELECT '{t}' track, f.ticker, f.anchor_date, f.anchor_idx, l.anchor_close, l.adv20_usd,
    l.resolution_date_40d resolution_date, {e} score FROM feats f JOIN outcomes l USING (ticker, anchor_date)"""
    for t, e in BASELINES.items())
CTES["picks"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track, anchor_date ORDER BY score DESC, ticker) rank
    FROM scores) WHERE rank <= 5"""


def no_overlap_ctes(name: str, src: str, keys: str, k: int) -> dict[str, str]:
    """Day by day: what has been sold by today is free, the best k that are not held are bought and held."""
    ks = [x.strip() for x in keys.split(",")]
    dk, on = ", ".join("d." + x for x in ks), " AND ".join(f"d.{x} = w.{x}" for x in ks)
    return {
        f"{name}_d": f"""SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY entry_date) dn FROM (SELECT {keys}, entry_date,
            list({{'ticker': ticker, 'free': exit_date}} ORDER BY score DESC, ticker) cands FROM {src} GROUP BY {keys}, entry_date)""",
        f"{name}_w": f"""SELECT {keys}, entry_date, dn, cands[1:{k}] taken, cands[1:{k}] held FROM {name}_d WHERE dn = 1
            UNION ALL SELECT {keys}, entry_date, dn, avail[1:{k}], list_concat(live, avail[1:{k}]) FROM (
            SELECT *, list_filter(cands, lambda c: NOT list_contains(list_transform(live, lambda h: h.ticker), c.ticker)) avail FROM (
            SELECT {dk}, d.entry_date, d.dn, d.cands, list_filter(w.held, lambda h: h.free > d.entry_date) live
            FROM {name}_w w JOIN {name}_d d ON {on} AND d.dn = w.dn + 1))""",
        name: f"""SELECT n.* FROM {src} n SEMI JOIN (SELECT {keys}, entry_date, unnest(taken).ticker ticker FROM {name}_w) k
            ON n.ticker = k.ticker AND n.entry_date = k.entry_date AND {' AND '.join(f'n.{x} = k.{x}' for x in ks)}""",
    }


def impact_sql(pos: str, adv: str, c: LedgerConfig) -> str:
    return (f"CASE WHEN {adv} > 0 AND {pos} > 0 THEN greatest({c.impact_min_bps}, least({c.impact_max_bps}, "
            f"{c.daily_vol * c.impact_eta!r} * pow({pos} / {adv}, {c.impact_beta}) * {1 + c.permanent_frac / 2} * 1e4)) "
            f"ELSE {c.impact_min_bps} END")


TIER = ("CASE WHEN adv20_usd < 5e6 THEN 'micro' WHEN adv20_usd < 50e6 THEN 'small' "
        "WHEN adv20_usd < 500e6 THEN 'mid' ELSE 'large' END")
RATE = "CASE " + TIER.replace("CASE ", "(CASE ", 1) + ") " + " ".join(
    f"WHEN '{t}' THEN {v}" for t, v in HALT_RATES.items()) + " END"


def halt_sql(seed: int, *keys: str) -> str:
    parts = ["'halt'", str(seed), *keys, "ticker", "strftime(anchor_date, '%Y-%m-%d')"]
    return f"{u01(*parts)} < {RATE}"


def ledger_ctes(p: str, src: str, c: LedgerConfig, keys: str = "track") -> dict[str, str]:
    """CTEs {p}open (all that can be bought), {p}exit, {p}held (what is bought) and {p}ledger."""
    ks = [k.strip() for k in keys.split(",")]
    bps = (lambda pos: impact_sql(pos, "adv20_usd", c)) if c.use_impact else (lambda pos: f"{c.slippage_bps}")
    halt = f"AND NOT ({halt_sql(c.halt_seed, *ks)})" if c.halt_risk else ""
    fee = lambda v: f"least(shares * {c.commission_per_share}, {c.commission_cap} * {v})"
    same = " AND ".join(f"s.{k} = t.{k}" for k in (*ks, "ticker", "entry_date"))
    out = {
        f"{p}open": f"""SELECT * RENAME (anchor_date AS entry_date), shares * entry_price + {fee('(shares * entry_price)')} cost FROM (
            SELECT *, CAST(floor(target_usd / entry_price) AS BIGINT) shares FROM (
            SELECT *, anchor_close * (1 + ({bps('target_usd')}) / 1e4) entry_price FROM (
            SELECT *, least({c.start_equity * c.max_position_pct}, adv20_usd * {c.max_adv_pct}) target_usd FROM {src}
            WHERE adv20_usd >= {c.min_adv_usd} AND anchor_close > 0 {halt})
            WHERE target_usd >= {c.min_position_usd})) WHERE shares > 0""",
        f"{p}next": f"""SELECT t.*, b.date next_date, b.close next_close FROM {p}open t ASOF LEFT JOIN bars b
            ON t.ticker = b.ticker AND t.resolution_date <= b.date""",
    }
    if c.trailing_stop_pct > 0:
        out[f"{p}hit"] = f"""SELECT {', '.join(ks)}, ticker, entry_date, min(d) stop_date, arg_min(c, d) stop_close FROM (
            SELECT {', '.join('t.' + k for k in ks)}, t.ticker, t.entry_date, b.date d, b.close c, greatest(t.entry_price,
              max(b.close) OVER (PARTITION BY {', '.join('t.' + k for k in ks)}, t.ticker, t.entry_date ORDER BY b.date), 1e-9) peak
            FROM {p}next t JOIN bars b ON b.ticker = t.ticker AND b.date > t.entry_date AND b.date < t.resolution_date)
            WHERE c / peak - 1 <= -{c.trailing_stop_pct} GROUP BY ALL"""
        stop_sel, stop_join = "s.stop_date, s.stop_close", f"LEFT JOIN {p}hit s ON {same}"
    else:
        stop_sel, stop_join = "NULL stop_date, NULL stop_close", ""
    out[f"{p}exit"] = f"""SELECT t.*, coalesce(stop_date, next_date, (SELECT max(date) FROM bars)) exit_date,
            coalesce(stop_close, next_close, final, entry_price) exit_close,
            stop_date IS NULL AND next_date IS NULL forced_close FROM (
            SELECT t.*, {stop_sel}, f.close final FROM {p}next t {stop_join}
            LEFT JOIN (SELECT ticker, close FROM bars WHERE date = (SELECT max(date) FROM bars)) f ON f.ticker = t.ticker) t"""
    out |= no_overlap_ctes(f"{p}held", f"{p}exit", keys, c.max_new_per_week)
    out[f"{p}ledger"] = f"""SELECT *, (proceeds - commission_total - cost) / cost trade_return_pct FROM (
            SELECT *, {fee('proceeds')} commission_total FROM (
            SELECT *, shares * exit_price proceeds FROM (
            SELECT *, exit_close * (1 - exit_slippage_bps / 1e4) exit_price FROM (
            SELECT *, {bps('cost')} exit_slippage_bps FROM {p}held))))"""
    return out


def equity_ctes(p: str, c: LedgerConfig, keys: str = "track") -> dict[str, str]:
    """CTEs {p}mtm, {p}equity, {p}summary on top of {p}ledger."""
    ks = [k.strip() for k in keys.split(",")]
    k_ = ", ".join(ks)
    lk = ", ".join("l." + k for k in ks)
    on = " AND ".join(f"e.{k} = t.{k}" for k in ks)
    return {
        f"{p}mtm": f"""SELECT {lk}, l.ticker, l.entry_date, l.exit_date, l.cost, c.date,
            CASE WHEN c.date = l.exit_date THEN l.proceeds - l.commission_total
                 ELSE l.shares * coalesce(b.close, l.entry_price) END "value"
            FROM {p}ledger l JOIN (SELECT DISTINCT date FROM bars) c ON c.date > l.entry_date AND c.date <= l.exit_date
            LEFT JOIN bars b ON b.ticker = l.ticker AND b.date = c.date""",
        f"{p}day": f"""SELECT {k_}, date, sum(ret) sum_ret, count(*) n_active, count(*) FILTER (WHERE date < exit_date) n_open FROM (
            SELECT *, "value" / coalesce(lag("value") OVER (PARTITION BY {k_}, ticker, entry_date ORDER BY date), cost) - 1 ret
            FROM {p}mtm) GROUP BY {k_}, date""",
        f"{p}equity": f"""SELECT *, equity * (1 - gross) cash FROM (
            SELECT *, {c.start_equity} * exp(sum(ln(1 + ret)) OVER (PARTITION BY {k_} ORDER BY date)) equity FROM (
            SELECT {', '.join('k.' + x for x in ks)}, k.date, coalesce(sum_ret * least({c.max_position_pct}, 1.0 / n_active), 0.0) ret,
              coalesce(n_active * least({c.max_position_pct}, 1.0 / n_active), 0.0) gross, coalesce(n_open, 0) n_positions
            FROM (SELECT * FROM (SELECT DISTINCT {k_} FROM {p}ledger), (SELECT DISTINCT date FROM bars)) k
            LEFT JOIN {p}day d ON d.date = k.date AND {' AND '.join(f'd.{x} = k.{x}' for x in ks)}))""",
        **summary_ctes(f"{p}summary", f"{p}equity", f"{p}ledger", keys),
    }


def summary_ctes(name: str, equity: str, ledger: str, keys: str = "track") -> dict[str, str]:
    ks = [k.strip() for k in keys.split(",")]
    k_ = ", ".join(ks)
    return {
        name: f"""SELECT {', '.join('e.' + k for k in ks)}, start_equity, end_equity, end_equity / start_equity - 1 total_return,
            years, pow(end_equity / start_equity, 1 / years) - 1 cagr,
            CASE WHEN sd > 1e-12 THEN m / sd * sqrt(252) ELSE 0 END sharpe_annualized,
            CASE WHEN sd > 1e-12 THEN m / sd ELSE 0 END sharpe_daily,
            max_drawdown, avg_positions, max_positions, avg_cash_pct, coalesce(n_trades, 0) n_trades,
            coalesce(win_rate, 0) win_rate, coalesce(profit_factor, 0) profit_factor,
            coalesce(avg_trade_return, 0) avg_trade_return, coalesce(median_trade_return, 0) median_trade_return
            FROM (SELECT {k_}, arg_min(equity, date) start_equity, arg_max(equity, date) end_equity,
              CASE WHEN max(date) > min(date) THEN (max(date) - min(date)) / 365.25 ELSE 1e-9 END AS years,
              avg(rt) m, stddev_pop(rt) sd, min(dd) max_drawdown, avg(n_positions) avg_positions,
              max(n_positions) max_positions, avg(cash / equity) avg_cash_pct FROM (
              SELECT *, equity / lag(equity) OVER (PARTITION BY {k_} ORDER BY date) - 1 rt,
                equity / max(equity) OVER (PARTITION BY {k_} ORDER BY date) - 1 dd FROM {equity}) GROUP BY {k_}) e
            LEFT JOIN (SELECT {k_}, count(*) n_trades, avg(CAST(trade_return_pct > 0 AS INT)) win_rate,
              CASE WHEN sum(trade_return_pct) FILTER (WHERE trade_return_pct <= 0) < 0
                THEN coalesce(sum(trade_return_pct) FILTER (WHERE trade_return_pct > 0), 0)
                     / abs(sum(trade_return_pct) FILTER (WHERE trade_return_pct <= 0)) ELSE 'inf'::DOUBLE END profit_factor,
              avg(trade_return_pct) avg_trade_return, median(trade_return_pct) median_trade_return
              FROM {ledger} GROUP BY {k_}) t USING ({k_})""",
    }


FLAT = LedgerConfig(**LEDGER)
REAL = LedgerConfig(**LEDGER | {"trailing_stop_pct": 0.18, "use_impact": True, "halt_risk": True})
CTES |= ledger_ctes("f_", "scores", FLAT) | equity_ctes("f_", FLAT)
CTES |= ledger_ctes("x_", "scores", REAL) | equity_ctes("x_", REAL)

# --- resampling ----------------------------------------------------------------------------------


def returns_cte(src: str, log: bool = False) -> str:
    ret = ("ln(greatest(equity, 1e-9)) - lag(ln(greatest(equity, 1e-9))) OVER (PARTITION BY track ORDER BY date)" if log
           else "equity / lag(equity) OVER (PARTITION BY track ORDER BY date) - 1")
    return f"""SELECT *, row_number() OVER (PARTITION BY track ORDER BY date) - 1 i, count(*) OVER (PARTITION BY track) n
        FROM (SELECT track, date, {ret} r FROM {src}) WHERE r IS NOT NULL"""


def draws_cte(src: str, n_resamples: int, block: int, seed: int = 42) -> str:
    u = u01("'boot'", str(seed), "resample", "t")
    v = u01("'boot'", str(seed), "resample", "t", start=13)
    return f"""SELECT n, resample, t, ((base + t) % n + n) % n i FROM (
        SELECT *, last_value(jump IGNORE NULLS) OVER (PARTITION BY n, resample ORDER BY t
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) base FROM (
        SELECT *, CASE WHEN t = 0 OR {u} < {1.0 / block!r} THEN CAST(floor({v} * n) AS BIGINT) - t END jump FROM (
        SELECT n, resample, unnest(range(0, n)) t FROM (
        SELECT n, unnest(range(0, {n_resamples})) resample FROM (SELECT DISTINCT n FROM {src})))))"""


def sql(body: str, **extra: str) -> str:
    """The statement with exactly the CTEs it needs, in dependency order."""
    pool = CTES | extra
    order: list[str] = []

    def need(text: str, skip: frozenset[str]) -> None:
        words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text))
        for name in [n for n in pool if n in words and n not in skip and n not in order]:
            need(pool[name], skip | {name})
            order.append(name)

    need(body, frozenset())
    ctes = ",\n".join(f"{n} AS ({pool[n]})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{body}" if order else body


PHI = norm_cdf_sql
GRID = (HORIZONS, THRESHOLDS)
