"""Registered queries: splits, models, ranking, ledger, metrics, statistics, governance, increments, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.exprs import flag, rnd, uniform
from tideline.operators import anchors as A
from tideline.operators import governance as G
from tideline.operators import inference as I
from tideline.operators import joins as J
from tideline.operators import ledger as K
from tideline.operators import metrics as M
from tideline.operators import models as ML
from tideline.operators import moments as MO
from tideline.operators import ranking as R
from tideline.operators import splits as S
from tideline.operators import vectors as V
from tideline.operators.features import FEATURE_COLS, LOOKBACK
from tideline.plans import common as C
from tideline.plans import reports as P
from tideline.plans import study as ST
from tideline.plans.checks import (CTES, FLAT, PHI, REAL, TIER, draws_cte, equity_ctes, flag_sql, halt_sql, impact_sql,
                                   ledger_ctes, r, returns_cte, sql, summary_ctes, u01)
from tideline.plans.registry import query
from tideline.session import cut, scratch_path
from tideline.sources import bars as B, tables as T
from tideline.sources.artifacts import write_artifacts
from tideline.streaming import settle as Z

# --- H: splits -----------------------------------------------------------------------------------

YEARS = [1998, 1999, 2000, 2001]
H = 40
EMBARGO = S.embargo_days(H)
_YEARS_SQL = "[" + ", ".join(map(str, YEARS)) + "]"
_FOLDS = f"""SELECT *, CASE WHEN year(anchor_date) = fold_year THEN 'test'
    WHEN anchor_date < make_date(fold_year, 1, 1) AND resolution_date_40d < make_date(fold_year, 1, 1) - {EMBARGO} THEN 'train'
    WHEN anchor_date < make_date(fold_year, 1, 1) THEN 'purged' END role, {flag_sql(40, 0.10)} y
    FROM (SELECT *, unnest({_YEARS_SQL}) fold_year FROM outcomes)"""


def _hsql(body: str) -> str:
    return sql(body, folds=_FOLDS)


def _folds(spark, d, purge: bool = True) -> DataFrame:
    lab = C.lean(spark, d).withColumn("y", F.col("ret_40d_ge_10pct").cast("int"))
    return S.yearly_folds(lab, YEARS, H, purge=purge)


@query("h01_yearly_folds", _hsql("SELECT ticker, anchor_date, fold_year, role FROM folds WHERE role IN ('train', 'test')"))
def h01(spark, d) -> DataFrame:
    return _folds(spark, d).select("ticker", "anchor_date", "fold_year", "role")


@query("h02_purge", _hsql("SELECT fold_year, role, count(*) n FROM folds WHERE role IS NOT NULL GROUP BY ALL"))
def h02(spark, d) -> DataFrame:
    return _folds(spark, d, purge=False).groupBy("fold_year", "role").agg(F.count("*").alias("n"))


@query("h03_embargo", sql("""SELECT anchor_date, CAST(anchor_date - CAST(floor(40 * 1.6) AS INT) AS DATE) edge, count(*) n FROM outcomes GROUP BY ALL"""))
def h03(spark, d) -> DataFrame:
    a = A.anchor_frame(C.bars(spark, d))
    return a.groupBy("anchor_date").agg(F.count("*").alias("n")).withColumn(
        "edge", F.date_sub("anchor_date", S.embargo_days(40)))


@query("h04_lockbox_year", sql("""SELECT year(anchor_date) fold_year, count(*) n FROM outcomes
    WHERE year(anchor_date) IN (1998, 1999, 2000) GROUP BY ALL"""))
def h04(spark, d) -> DataFrame:
    years = S.fold_years(YEARS, lockbox_year=2001)
    f = S.yearly_folds(C.lean(spark, d), years, H).filter("role = 'test'")
    return f.groupBy(F.col("fold_year").cast("bigint").alias("fold_year")).agg(F.count("*").alias("n"))


@query("h05_drop_empty_folds", _hsql("""SELECT fold_year, count(*) FILTER (WHERE role = 'train') n_train,
    count(*) FILTER (WHERE role = 'test') n_test FROM folds GROUP BY ALL HAVING n_train > 0 AND n_test > 0"""))
def h05(spark, d) -> DataFrame:
    return S.fold_sizes(S.drop_empty_folds(_folds(spark, d))).select("fold_year", "n_train", "n_test")


@query("h06_leakage_violations", _hsql(f"""SELECT f.fold_year, count(*) FILTER (WHERE anchor_date >= first_test) future_rows,
    count(*) FILTER (WHERE resolution_date_40d >= first_test - {EMBARGO}) overlap_rows, count(*) train_rows
    FROM folds f JOIN (SELECT fold_year, min(anchor_date) first_test FROM folds WHERE role = 'test' GROUP BY ALL) t
    ON f.fold_year = t.fold_year WHERE role = 'train' GROUP BY ALL"""))
def h06(spark, d) -> DataFrame:
    return S.leakage_violations(_folds(spark, d), H)


@query("h07_fold_guards", _hsql("""SELECT fold_year, count(*) n_train, count(*) FILTER (WHERE y = 1) n_pos FROM folds WHERE role = 'train'
    GROUP BY ALL HAVING count(*) >= 50 AND count(*) FILTER (WHERE y = 1) >= 10 AND count(*) FILTER (WHERE y = 0) >= 10"""))
def h07(spark, d) -> DataFrame:
    f = S.fold_guards(_folds(spark, d), "y", min_train=50)
    return S.fold_sizes(f, "y").select("fold_year", "n_train", "n_pos")


@query("h08_resolved_before", sql("SELECT ticker, anchor_date, resolution_date_40d FROM outcomes WHERE resolution_date_40d < DATE '2001-03-01'"))
def h08(spark, d) -> DataFrame:
    return S.resolved_before(C.lean(spark, d), "2001-03-01", H).select("ticker", "anchor_date", "resolution_date_40d")


@query("h09_fold_purge_report", _hsql("""SELECT fold_year, count(*) FILTER (WHERE role = 'train') n_train,
    count(*) FILTER (WHERE role = 'test') n_test, count(*) FILTER (WHERE role = 'purged') n_purged FROM folds
    WHERE role IS NOT NULL GROUP BY ALL"""))
def h09(spark, d) -> DataFrame:
    return S.fold_sizes(_folds(spark, d, purge=False))


# --- I: models -----------------------------------------------------------------------------------



def _training(spark, d, vectors: bool = True, engineered: bool = True) -> DataFrame:
    """Labels and, where a track sees them, features and vectors of all anchors with a full window, cut so that every fit
    starts from files."""
    bars = C.bars(spark, d)
    keys = ["ticker", "anchor_date"]
    rows = C.lean(spark, d).withColumn("y", F.col("ret_40d_ge_10pct").cast("int")).withColumn(
        "resolution_date", F.col("resolution_date_40d")).filter(F.col("anchor_idx") >= LOOKBACK - 1)
    if engineered:
        rows = C.features(spark, d).drop("anchor_idx").join(rows, keys)
    if vectors:
        rows = rows.join(V.window_vectors(bars, A.anchor_frame(bars)), keys)
    return cut(rows)


_UNNESTED = "SELECT vec_id, unnest(range(0, len(embedding))) component, unnest(embedding)::DOUBLE x FROM embeddings"


def _embedding_moments(spark, d) -> tuple[DataFrame, MO.Moments]:
    e = T.table(spark, d, "embeddings").withColumn("_fold", F.lit(0))
    return e, MO.expanding(MO.moments_by_fold(e, "_fold", "embedding"), [0])[0]


@query("i01_standardise", f"""SELECT vec_id, CAST(component AS INT) component, {r('(x - avg(x) OVER w) / stddev_pop(x) OVER w')} scaled FROM ({_UNNESTED})
    WINDOW w AS (PARTITION BY component)""")
def i01(spark, d) -> DataFrame:
    e, m = _embedding_moments(spark, d)
    mean, sd = (F.array(*map(F.lit, x.tolist())) for x in (m.mean, m.deviation))
    scaled = F.transform("embedding", lambda x, i: (x.cast("double") - F.get(mean, i)) / F.get(sd, i))
    return e.select("vec_id", F.posexplode(scaled).alias("component", "scaled")).withColumn("scaled", rnd("scaled"))


@query("i01_fold_moments", sql(f"""SELECT fold_year, CAST(component AS INT) component, count(*) n_rows, {r('avg(x)')} mean, {r('stddev_pop(x)')} deviation FROM (
    SELECT f.fold_year, unnest(range(0, {len(FEATURE_COLS)})) component, unnest([{', '.join(f'z.{c}' for c in FEATURE_COLS)}]) x
    FROM folds f JOIN clean z USING (ticker, anchor_date) WHERE role = 'train') GROUP BY ALL""", folds=_FOLDS,
    clean="SELECT ticker, anchor_date, " + ", ".join(f"coalesce(CASE WHEN isfinite({c}) THEN {c} END, 0)::DOUBLE {c}" for c in FEATURE_COLS) + " FROM feats"))
def i01b(spark, d) -> DataFrame:
    rows = C.features(spark, d).drop("anchor_idx").join(C.lean(spark, d), ["ticker", "anchor_date"]).select(
        MO.first_fold(YEARS, H).alias("_first"), F.array(*FEATURE_COLS).alias("v"))
    return C.rounded(MO.moment_table(spark, MO.expanding(MO.moments_by_fold(rows, "_first", "v"), YEARS)), ["mean", "deviation"])


@query("i02_pca")
def i02(spark, d) -> DataFrame:
    e, m = _embedding_moments(spark, d)
    return e.select("vec_id", MO.projected(["embedding"], [MO.Basis.of(m, 16)]).alias("components"))


# What any right answer shows: all variance kept, in falling order, by unit axes at right angles that the correlations only stretch.
@query("i02_pca_checks", f"""SELECT 'variance' "check", {r('sum(s * s) / (SELECT count(*) FROM embeddings)')} "value" FROM (
    SELECT (x - avg(x) OVER w) / stddev_pop(x) OVER w s FROM ({_UNNESTED}) WINDOW w AS (PARTITION BY component))
    UNION ALL SELECT unnest(['disorder', 'angle', 'bend']), 0.0""")
def i02b(spark, d) -> DataFrame:
    e, m = _embedding_moments(spark, d)
    b = MO.Basis.of(m, len(m.mean))
    kept = e.select(F.explode(F.transform(MO.projected(["embedding"], [b]), lambda x: x * x)).alias("s")).agg(
        (F.sum("s") / F.lit(m.n)).alias("value")).select(F.lit("variance").alias("check"), rnd("value").alias("value"))
    return kept.unionByName(spark.createDataFrame([(k, round(v, 6) + 0.0) for k, v in b.errors(m).items()], "check string, value double"))


@query("i03_balanced_weights", "SELECT label % 2 target, count(*) n, " + r(
    "(SELECT count(*) FROM embeddings) / (2.0 * count(*))") + " weight FROM embeddings GROUP BY label % 2")
def i03(spark, d) -> DataFrame:
    e = T.table(spark, d, "embeddings").withColumn("target", F.col("label") % 2).select("vec_id", "target")
    return ML.class_weights(e, "target").groupBy("target").agg(F.count("*").alias("n"), rnd(F.max("weight")).alias("weight"))


_CALIB = f"""SELECT {flag_sql(40, 0.10)} y, {u01("'calib'", '42', 'ticker', "strftime(anchor_date, '%Y-%m-%d')")} u FROM outcomes"""


@query("i05_calibration_holdout", sql("""SELECT c.y, u <= bound holdout, count(*) n FROM calib c JOIN (
    SELECT y, quantile_cont(u, 0.1) bound FROM calib GROUP BY y) b ON b.y = c.y GROUP BY ALL""", calib=_CALIB))
def i05(spark, d) -> DataFrame:
    lab = C.lean(spark, d).withColumn("y", F.col("ret_40d_ge_10pct").cast("int"))
    return ML.calibration_split(lab, "y").groupBy("y", "holdout").agg(F.count("*").alias("n"))


def _scores(spark, d, *tracks: str) -> DataFrame:
    unseen = {} if "gbt_engineered" in tracks else {"engineered": False}
    rows = _training(spark, d, vectors=set(tracks) != {"gbt_engineered"}, **unseen)
    return ML.score_folds(rows, "y", YEARS, H, tracks)


@query("i07_lr_baseline")
def i07(spark, d) -> DataFrame:
    return _scores(spark, d, "lr_baseline")


@query("i08_gbt_vectors")
def i08(spark, d) -> DataFrame:
    return _scores(spark, d, "gbt_vectors")


@query("i09_gbt_engineered")
def i09(spark, d) -> DataFrame:
    return _scores(spark, d, "gbt_engineered")


@query("i10_score_folds")
def i10(spark, d) -> DataFrame:
    return _scores(spark, d, *ML.TRACKS).groupBy("track", "fold_year").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.min("score").alias("lo"), F.max("score").alias("hi"))


_USCORE = f"SELECT 'u' track, ticker, anchor_date, {u01(chr(39) + 'score' + chr(39), '7', 'ticker', 'strftime(anchor_date, ' + chr(39) + '%Y-%m-%d' + chr(39) + ')')} score FROM outcomes"


def _uscores(spark, d) -> DataFrame:
    return A.anchor_frame(C.bars(spark, d)).select(
        F.lit("u").alias("track"), "ticker", "anchor_date", R.random_score(7).alias("score"))


@query("i11_score_distribution", sql("""SELECT track, CAST(date_trunc('week', anchor_date) AS DATE) "week",
    CAST(least(floor(score * 40), 39) AS INT) bin, count(*) n FROM uscores GROUP BY ALL""", uscores=_USCORE))
def i11(spark, d) -> DataFrame:
    return ML.score_distribution(_uscores(spark, d))


@query("i11_score_rank", sql(f"""SELECT s.track, s.anchor_date, count(*) FILTER (WHERE s.score > m.score) + 1 rank, count(*) n,
    {r('median(s.score)')} median_score FROM uscores s JOIN uscores m ON m.ticker = 'S000000003' AND m.anchor_date = s.anchor_date GROUP BY ALL""",
    uscores=_USCORE))
def i11b(spark, d) -> DataFrame:
    return C.rounded(ML.score_rank(_uscores(spark, d), "S000000003"), ["median_score"])


# --- J: ranking and selection --------------------------------------------------------------------

for _id, _track in zip(("j01", "j02", "j03", "j04", "j05"), R.BASELINES):
    query(f"{_id}_{_track}", sql(f"SELECT ticker, anchor_date, {r(R.BASELINES[_track])} score FROM feats"))(
        lambda spark, d, t=_track: C.features(spark, d).select(
            "ticker", "anchor_date", rnd(R.baseline_score(t)).alias("score")))


@query("j06_random_score", sql(f"SELECT ticker, anchor_date, {r('score', 9)} score FROM uscores", uscores=_USCORE))
def j06(spark, d) -> DataFrame:
    return _uscores(spark, d).select("ticker", "anchor_date", rnd("score", 9).alias("score"))


@query("j07_weekly_topk", sql(f"""SELECT track, ticker, anchor_date, {r('score')} score, CAST(rank AS INT) rank FROM (
    SELECT *, row_number() OVER (PARTITION BY track, anchor_date ORDER BY score DESC, ticker) rank FROM scores) WHERE rank <= 2"""))
def j07(spark, d) -> DataFrame:
    return R.weekly_topk(C.scores(spark, d), 2).select("track", "ticker", "anchor_date", rnd("score").alias("score"), "rank")


@query("j08_no_overlap_selection", sql("SELECT track, ticker, entry_date, exit_date FROM x_held"))
def j08(spark, d) -> DataFrame:
    return K.held_trades(C.bought(spark, d, C.REAL), C.bars(spark, d), C.REAL).select("track", "ticker", "entry_date", "exit_date")


@query("j09_forward_topk", sql(f"""SELECT ticker, anchor_date, {r('score')} score FROM (SELECT ticker, date anchor_date, close / ma score, adv
    FROM latest) WHERE adv >= 2e6 ORDER BY score DESC, ticker LIMIT 5""", latest="""SELECT * FROM (
    SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 idx, close,
      avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 249 PRECEDING) ma,
      avg(close * volume) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) adv, max(date) OVER (PARTITION BY ticker) newest
    FROM bars WHERE date <= DATE '2001-06-15') WHERE date = newest AND idx >= 251"""))
def j09(spark, d) -> DataFrame:
    c = A.latest_candidates(C.bars(spark, d), "2001-06-15", prefilter=False).withColumn("score", F.col("ratio_ma250"))
    return R.forward_topk(c, 5, 2e6).select("ticker", "anchor_date", rnd("score").alias("score"))


@query("j10_entry_window_filter", sql("""SELECT ticker, anchor_date FROM outcomes WHERE ratio_ma250 > 1.5
    AND anchor_date BETWEEN DATE '1999-01-04' AND DATE '2001-02-20' AND resolution_date_40d <= DATE '2001-06-20'"""))
def j10(spark, d) -> DataFrame:
    return R.entry_window_filter(C.lean(spark, d), 40, "1999-01-04", "2001-02-20", "2001-06-20").select("ticker", "anchor_date")


# --- K: ledger -----------------------------------------------------------------------------------


def _meta(spark, d) -> DataFrame:
    return C.lean(spark, d).select("ticker", "anchor_date", "anchor_close", "adv20_usd",
                                     F.col("resolution_date_40d").alias("resolution_date"))


@query("k01_tradable_filter", sql("SELECT ticker, anchor_date FROM outcomes WHERE adv20_usd >= 5e6 AND anchor_close > 0"))
def k01(spark, d) -> DataFrame:
    return K.tradable_filter(_meta(spark, d), C.bars(spark, d)).select("ticker", "anchor_date")


@query("k02_position_size", sql(f"SELECT ticker, anchor_date, {r('least(4000.0, adv20_usd * 0.005)', 3)} target_usd FROM outcomes"))
def k02(spark, d) -> DataFrame:
    return _meta(spark, d).select("ticker", "anchor_date", rnd(K.position_size(), 3).alias("target_usd"))


@query("k03_impact_bps", sql(f"SELECT ticker, anchor_date, {r(impact_sql('50000.0', 'adv20_usd', REAL))} bps FROM outcomes"))
def k03(spark, d) -> DataFrame:
    return _meta(spark, d).select("ticker", "anchor_date", rnd(K.impact_bps(F.lit(50000.0), F.col("adv20_usd"))).alias("bps"))


@query("k04_flat_slippage", sql(f"""SELECT ticker, date, {r('close * (1 + 10.0 / 1e4)', 8)} buy_fill, {r('close * (1 - 10.0 / 1e4)', 8)} sell_fill FROM bars"""))
def k04(spark, d) -> DataFrame:
    return C.bars(spark, d).select("ticker", "date", rnd(K.slipped(F.col("close"), F.lit(10.0), "buy"), 8).alias("buy_fill"),
                                         rnd(K.slipped(F.col("close"), F.lit(10.0), "sell"), 8).alias("sell_fill"))


@query("k05_commission", sql(f"SELECT ticker, date, {r('least(volume * 0.005, 0.005 * (volume * close / 100))', 6)} fee FROM bars"))
def k05(spark, d) -> DataFrame:
    return C.bars(spark, d).select("ticker", "date", rnd(K.commission(
        F.col("volume"), F.col("volume") * F.col("close") / 100), 6).alias("fee"))


@query("k06_cap_tier", sql(f"SELECT tier, count(*) n FROM (SELECT {TIER} tier FROM outcomes) GROUP BY tier"))
def k06(spark, d) -> DataFrame:
    return _meta(spark, d).groupBy(K.cap_tier().alias("tier")).agg(F.count("*").alias("n"))


@query("k07_halt_draw", sql(f"SELECT ticker, anchor_date, CAST({halt_sql(42)} AS INT) missed FROM outcomes"))
def k07(spark, d) -> DataFrame:
    return _meta(spark, d).select("ticker", "anchor_date", flag(K.halt_draw(42)).alias("missed"))


@query("k08_integer_shares", sql("""SELECT track, ticker, entry_date, shares FROM f_open"""))
def k08(spark, d) -> DataFrame:
    return K.open_trades(C.scores(spark, d), C.bars(spark, d)).select("track", "ticker", "entry_date", "shares")


@query("k09_fixed_exit", sql("""SELECT a.ticker, a.anchor_date entry_date, b.date exit_date, b.close exit_close FROM (
    SELECT ticker, anchor_date, anchor_date + 63 due FROM outcomes) a ASOF LEFT JOIN bars b ON a.ticker = b.ticker AND a.due <= b.date"""))
def k09(spark, d) -> DataFrame:
    t = _meta(spark, d).select("ticker", F.col("anchor_date").alias("entry_date"), F.date_add("anchor_date", 63).alias("resolution_date"))
    return K.fixed_exit(t, C.bars(spark, d)).drop("resolution_date")


@query("k10_trailing_stop", sql("SELECT track, ticker, entry_date, stop_date, stop_close FROM x_hit"))
def k10(spark, d) -> DataFrame:
    return K.trailing_stop(cut(K.open_trades(C.scores(spark, d), C.bars(spark, d), C.REAL)), C.bars(spark, d), 0.18)


@query("k11_forced_close", sql("""SELECT a.ticker, a.anchor_date entry_date, coalesce(b.date, (SELECT max(date) FROM bars)) exit_date,
    coalesce(b.close, f.close, a.anchor_close) exit_close, b.date IS NULL forced_close
    FROM (SELECT ticker, anchor_date, anchor_close, anchor_date + 500 due FROM outcomes) a
    ASOF LEFT JOIN bars b ON a.ticker = b.ticker AND a.due <= b.date
    LEFT JOIN (SELECT ticker, close FROM bars WHERE date = (SELECT max(date) FROM bars)) f ON f.ticker = a.ticker"""))
def k11(spark, d) -> DataFrame:
    bars = C.bars(spark, d)
    t = _meta(spark, d).select("ticker", F.col("anchor_date").alias("entry_date"), F.col("anchor_close").alias("entry_price"),
                               F.date_add("anchor_date", 500).alias("resolution_date"))
    return K.forced_close(K.fixed_exit(t, bars), bars).select("ticker", "entry_date", "exit_date", "exit_close", "forced_close")


def _ledger_sql(p: str) -> str:
    return sql(f"""SELECT track, ticker, entry_date, exit_date, {r('entry_price', 8)} entry_price, {r('exit_price', 8)} exit_price, shares,
    {r('cost', 8)} cost, {r('proceeds', 8)} proceeds, {r('commission_total', 8)} commission_total, {r('trade_return_pct', 8)} trade_return_pct,
    {r('exit_slippage_bps', 8)} exit_slippage_bps, forced_close FROM {p}ledger""")


_MONEY = ["entry_price", "exit_price", "cost", "proceeds", "commission_total", "trade_return_pct", "exit_slippage_bps"]
query("k12_trade_ledger", _ledger_sql("f_"))(lambda spark, d: C.rounded(C.ledger(spark, d).drop("score"), _MONEY, 8))
query("k12_trade_ledger_realistic", _ledger_sql("x_"))(
    lambda spark, d: C.rounded(C.ledger(spark, d, C.REAL).drop("score"), _MONEY, 8))


@query("k13_mark_to_market", sql(f"""SELECT track, ticker, entry_date, date, {r(chr(34) + 'value' + chr(34), 4)} "value" FROM f_mtm"""))
def k13(spark, d) -> DataFrame:
    return K.mark_to_market(C.ledger(spark, d), C.bars(spark, d)).select(
        "track", "ticker", "entry_date", "date", rnd("value", 4).alias("value"))


@query("k14_open_positions_by_day", sql("""SELECT k.track, c.date, CAST((SELECT count(*) FROM f_ledger l WHERE l.track = k.track AND l.entry_date < c.date AND l.exit_date > c.date) AS BIGINT) n_positions
    FROM (SELECT DISTINCT track FROM f_ledger) k, (SELECT DISTINCT date FROM bars) c"""))
def k14(spark, d) -> DataFrame:
    return K.open_positions_by_day(C.ledger(spark, d), C.bars(spark, d))


@query("k15_sleeve_equity_curve", sql(f"""SELECT track, date, {r('equity', 4)} equity, {r('ret', 8)} ret, {r('cash', 4)} cash, n_positions FROM f_equity"""))
def k15(spark, d) -> DataFrame:
    return C.equity(spark, d).select("track", "date", rnd("equity", 4).alias("equity"), rnd("ret", 8).alias("ret"),
                                     rnd("cash", 4).alias("cash"), "n_positions")


@query("a12_blotter_page", sql(f"""SELECT ticker, strftime(entry_date, '%Y-%m-%d') entry_date, strftime(exit_date, '%Y-%m-%d') exit_date, shares,
    {r('trade_return_pct')} trade_return_pct FROM (SELECT * FROM f_ledger WHERE track = 'rank_252d_return' ORDER BY entry_date, ticker LIMIT 500)"""))
def a12(spark, d) -> DataFrame:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    led = C.ledger(spark, d).filter("track = 'rank_252d_return'").orderBy("entry_date", "ticker").limit(500)
    return led.select("ticker", iso("entry_date"), iso("exit_date"), "shares", rnd("trade_return_pct").alias("trade_return_pct"))


@query("g03_equity_join_equity", sql(f"""SELECT a.date, {r('a.equity', 4)} equity_m, {r('b.equity', 4)} equity_b FROM f_equity a JOIN f_equity b
    ON a.date = b.date AND a.track = 'rank_252d_return' AND b.track = 'rank_inv_60d_vol'"""))
def g03(spark, d) -> DataFrame:
    e = cut(C.equity(spark, d))
    one = lambda t, n: e.filter(F.col("track") == t).select("date", rnd("equity", 4).alias(n))
    return one("rank_252d_return", "equity_m").join(one("rank_inv_60d_vol", "equity_b"), "date")


# --- L: summary metrics --------------------------------------------------------------------------

_SUM = {"start_equity": 2, "end_equity": 2, "total_return": 6, "years": 6, "cagr": 6, "sharpe_annualized": 6, "sharpe_daily": 6,
        "max_drawdown": 6, "win_rate": 6, "profit_factor": 6, "avg_trade_return": 6, "median_trade_return": 6,
        "avg_positions": 6, "avg_cash_pct": 6}
_COUNTS = ["n_trades", "max_positions"]


def _summary_sql(src: str, cols: list[str] | None = None, keys: str = "track") -> str:
    names = cols or [*_SUM, *_COUNTS]
    return f"SELECT {keys}, " + ", ".join(
        f"{r(c, _SUM[c])} AS {c}" if c in _SUM else f"CAST({c} AS BIGINT) AS {c}" for c in names) + f" FROM {src}"


def _summary_out(df: DataFrame, cols: list[str] | None = None, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    names = cols or [*_SUM, *_COUNTS]
    return df.select(*keys, *[rnd(c, _SUM[c]).alias(c) if c in _SUM else F.col(c).cast("bigint").alias(c) for c in names])


query("l01_compute_summary", sql(_summary_sql("f_summary")))(lambda spark, d: _summary_out(C.summary(spark, d)))
query("l01_compute_summary_realistic", sql(_summary_sql("x_summary")))(
    lambda spark, d: _summary_out(C.summary(spark, d, C.REAL)))

for _id, _slug, _cols in (("l02", "years_cagr", ["years", "cagr"]), ("l03", "sharpe", ["sharpe_daily", "sharpe_annualized"]),
                          ("l04", "max_drawdown", ["max_drawdown"]), ("l08", "positions_cash", ["avg_positions", "max_positions", "avg_cash_pct"])):
    query(f"{_id}_{_slug}", sql(_summary_sql("f_summary", _cols)))(
        lambda spark, d, c=_cols: _summary_out(M.equity_summary(C.equity(spark, d)), c))
_cols = ["n_trades", "win_rate", "profit_factor", "avg_trade_return", "median_trade_return"]
query("l05_trade_summary", sql(_summary_sql("f_summary", _cols)))(
    lambda spark, d, c=_cols: _summary_out(M.trade_summary(C.ledger(spark, d)), c))

# Random portfolios: two holding periods, each seed a row.
N_SEEDS = 200
SK = "hold_days, seed"
_RSCORE = u01("'score'", "seed", "ticker", "strftime(anchor_date, '%Y-%m-%d')")
_RANDOM = {
    "rbase": f"""SELECT hold_days, seed, ticker, anchor_date, anchor_idx, anchor_close, adv20_usd, resolution_date, {_RSCORE} score FROM (
        SELECT *, unnest(range(0, {N_SEEDS})) seed FROM (
        SELECT 20 hold_days, *, resolution_date_20d resolution_date FROM outcomes UNION ALL SELECT 40, *, resolution_date_40d FROM outcomes))""",
    **ledger_ctes("r_", "rbase", ST.FREE, SK), **equity_ctes("r_", ST.FREE, SK),
}


def _seeds(spark, d) -> DataFrame:
    return ST.random_portfolios(C.lean(spark, d), C.bars(spark, d), (20, 40), N_SEEDS)[0]


@query("l09_vs_random_percentile", sql(f"""SELECT track, {r('end_equity', 2)} end_equity,
    {r('(SELECT avg(CAST(n.end_equity <= f.end_equity AS INT)) FROM r_summary n WHERE hold_days = 40)')} vs_random_pct FROM f_summary f""", **_RANDOM))
def l09(spark, d) -> DataFrame:
    null = _seeds(spark, d).filter("hold_days = 40")
    return M.vs_random_percentile(C.summary(spark, d), null).select(
        "track", rnd("end_equity", 2).alias("end_equity"), rnd("vs_random_pct").alias("vs_random_pct"))


_NULL = {"median_cagr": ("cagr", 0.5, 6), "median_end_equity": ("end_equity", 0.5, 2),
         "p95_end_equity": ("end_equity", 0.95, 2), "p99_end_equity": ("end_equity", 0.99, 2)}


@query("l10_null_distribution", sql("SELECT count(*) n_seeds, " + ", ".join(
    f"{r(f'quantile_cont({c}, {q})', n)} {k}" for k, (c, q, n) in _NULL.items()) + " FROM r_summary WHERE hold_days = 40", **_RANDOM))
def l10(spark, d) -> DataFrame:
    n = M.null_distribution(_seeds(spark, d).filter("hold_days = 40"))
    return n.select("n_seeds", *[rnd(k, v[2]).alias(k) for k, v in _NULL.items()])


_AGG = {f"{t}_{n}": (c, q, dg) for c, n, dg in (("end_equity", "ending_equity", 2), ("cagr", "cagr", 6), ("max_drawdown", "max_drawdown", 6))
        for t, q in (("median", 0.5), ("p5", 0.05), ("p95", 0.95))}
_AGG |= {"median_profit_factor": ("profit_factor", 0.5, 6), "median_win_rate": ("win_rate", 0.5, 6), "median_trade_count": ("n_trades", 0.5, 2)}


@query("l11_per_horizon_aggregate", sql("SELECT hold_days, count(*) n_seeds, " + ", ".join(
    f"{r(f'quantile_cont({c}, {q})', n)} {k}" for k, (c, q, n) in _AGG.items()) + " FROM r_summary GROUP BY hold_days", **_RANDOM))
def l11(spark, d) -> DataFrame:
    g = M.per_horizon_aggregate(_seeds(spark, d))
    return g.select("hold_days", "n_seeds", *[rnd(k, v[2]).alias(k) for k, v in _AGG.items()])


@query("l11_random_portfolios", sql(_summary_sql("r_summary", keys="hold_days, CAST(seed AS INT) seed"), **_RANDOM))
def l11b(spark, d) -> DataFrame:
    return _summary_out(_seeds(spark, d), keys=("hold_days", "seed"))


@query("l12_leaderboard", sql(f"""SELECT track, {r('end_equity', 2)} end_equity, {r('cagr')} cagr,
    CAST(row_number() OVER (ORDER BY round(end_equity, 2) DESC, track) AS INT) place,
    CAST(row_number() OVER (ORDER BY round(cagr, 6) DESC, track) = 1 AS INT) best_by_cagr,
    CAST(row_number() OVER (ORDER BY round(end_equity, 2) DESC, track) = 1 AS INT) best_baseline FROM f_summary"""))
def l12(spark, d) -> DataFrame:
    return M.leaderboard(C.summary(spark, d)).withColumn("end_equity", rnd("end_equity", 2)).withColumn("cagr", rnd("cagr"))


def _fitted(spark, d) -> tuple[DataFrame, DataFrame]:
    """Ledger and equity of a fitted track next to the baselines, on the dates that the fitted track was scored for."""
    own = C.study(spark, d)
    own.features, own.lean = cut(own.features), cut(own.lean)  # read by the fits and by the baselines' scores
    model = _scores(spark, d, "gbt_engineered").drop("fold_year")
    dates = model.select("anchor_date").distinct()
    scored = cut(model.unionByName(C.scores(spark, d).join(dates, "anchor_date", "left_semi")))
    led = cut(K.trade_ledger(cut(K.purchases(scored, C.bars(spark, d))), C.bars(spark, d)))
    return led, cut(K.sleeve_equity_curve(led, C.bars(spark, d)))


@query("l12_leaderboard_fitted")
def l12b(spark, d) -> DataFrame:
    led, eq = _fitted(spark, d)
    return M.leaderboard(M.compute_summary(eq, led))


@query("l13_cost_impact", sql(f"""SELECT track, {r('a.cagr')} cagr_flat, {r('b.cagr')} cagr_real, {r('b.cagr - a.cagr')} delta_cagr,
    {r('b.max_drawdown - a.max_drawdown')} delta_drawdown FROM f_summary a JOIN x_summary b USING (track)"""))
def l13(spark, d) -> DataFrame:
    return C.rounded(M.cost_impact(C.summary(spark, d), C.summary(spark, d, C.REAL)),
                     ["cagr_flat", "cagr_real", "delta_cagr", "delta_drawdown"])


@query("l13_recosted_scores", sql(_summary_sql("costed", keys="rules, track"), costed="""SELECT 'flat' rules, * FROM f_summary
    UNION ALL SELECT 'real', * FROM x_summary"""))
def l13b(spark, d) -> DataFrame:
    path = scratch_path(spark, "scores")
    write_artifacts(path, scores=C.scores(spark, d))
    return _summary_out(ST.recost(spark, f"{path}/scores", C.bars(spark, d), {"flat": C.FLAT, "real": C.REAL}), keys=("rules", "track"))


@query("l14_oos_report", sql(_summary_sql("o_summary", keys="track, 'final' \"label\", 'oos_only_last_fold' report_type"),
    o_eq="SELECT * FROM f_equity WHERE year(date) = 2001", o_led="SELECT * FROM f_ledger WHERE year(entry_date) = 2001",
    **summary_ctes("o_summary", "o_eq", "o_led")))
def l14(spark, d) -> DataFrame:
    led = C.ledger(spark, d)
    eq = K.sleeve_equity_curve(led, C.bars(spark, d))
    return _summary_out(M.oos_report(eq, led, 2001, "final"), keys=("track", "label", "report_type"))


@query("l15_null_histogram", sql("""SELECT CAST(least(floor((end_equity - lo) / (hi - lo) * 30), 29) AS INT) bin, count(*) n FROM (
    SELECT end_equity, min(end_equity) OVER () lo, max(end_equity) OVER () hi FROM r_summary) GROUP BY bin""", **_RANDOM))
def l15(spark, d) -> DataFrame:
    return M.histogram(cut(_seeds(spark, d)), "end_equity", 30)


# --- M: statistics -------------------------------------------------------------------------------

N_BOOT = 2000
BLOCK = 40


@query("m01_daily_returns", sql(f"SELECT track, date, {r('r', 8)} r, CAST(i AS INT) i, n FROM rets", rets=returns_cte("f_equity")))
def m01(spark, d) -> DataFrame:
    return I.daily_returns(C.equity(spark, d)).withColumn("r", rnd("r", 8))


_BOOT = {"rets": returns_cte("f_equity"), "draws": draws_cte("rets", N_BOOT, BLOCK),
         "samples": "SELECT x.track, d.resample, d.t, x.r, x.n FROM draws d JOIN rets x ON x.n = d.n AND x.i = d.i"}
_LBOOT = {**_BOOT, "rets": returns_cte("f_equity", log=True)}
_PAIR = {
    "rets": """SELECT *, rm - rb r, row_number() OVER (ORDER BY date) - 1 i, count(*) OVER () n, 'pair' track FROM (
        SELECT date, a / lag(a) OVER (ORDER BY date) - 1 rm, b / lag(b) OVER (ORDER BY date) - 1 rb FROM (
        SELECT x.date, x.equity a, y.equity b FROM f_equity x JOIN f_equity y ON x.date = y.date
        AND x.track = 'rank_252d_return' AND y.track = 'rank_inv_60d_vol')) WHERE rm IS NOT NULL""",
    "draws": draws_cte("rets", N_BOOT, BLOCK), "samples": _BOOT["samples"]}
_SR = "CASE WHEN stddev_pop({0}) > 1e-12 THEN avg({0}) / stddev_pop({0}) * sqrt(252) ELSE 0 END"


def _pair(spark, d) -> DataFrame:
    e = cut(C.equity(spark, d))
    return I.paired_returns(e.filter("track = 'rank_252d_return'"), e.filter("track = 'rank_inv_60d_vol'"))


@query("m02_stationary_bootstrap_sharpe", sql(f"SELECT track, CAST(resample AS INT) resample, {r(_SR.format('r'))} sharpe FROM samples GROUP BY track, resample", **_BOOT))
def m02(spark, d) -> DataFrame:
    rets = cut(I.daily_returns(C.equity(spark, d)))
    return C.rounded(I.stationary_bootstrap_sharpe(rets, N_BOOT, BLOCK), ["sharpe"])


@query("m03_paired_bootstrap_p", sql(f"""SELECT {r('(SELECT ' + _SR.format('rm') + ' - ' + _SR.format('rb') + ' FROM rets)')} obs_sharpe_diff,
    {r('avg(s)')} boot_mean_diff, {r('stddev_pop(s)')} boot_se, {r('avg(CAST(s <= 0 AS INT))')} p_value FROM (
    SELECT {_SR.format('r')} s FROM samples GROUP BY resample)""", **_PAIR))
def m03(spark, d) -> DataFrame:
    return C.rounded(I.paired_bootstrap_p(cut(_pair(spark, d)), N_BOOT, BLOCK),
                     ["obs_sharpe_diff", "boot_mean_diff", "boot_se", "p_value"])


_CI = [f"{m}_{t}" for m in ("cagr", "sharpe", "maxdd") for t in ("lo", "med", "hi")]
_Q = {"lo": 0.025, "med": 0.5, "hi": 0.975}


@query("m04_bootstrap_ci", sql("SELECT track, " + ", ".join(
    f"{r(f'quantile_cont({c.split(chr(95))[0]}, {_Q[c.split(chr(95))[1]]})')} {c}" for c in _CI) + f""" FROM (
    SELECT track, resample, exp(sum(r) / (max(n) / 252.0)) - 1 cagr, {_SR.format('r')} sharpe, min(dd) maxdd FROM (
    SELECT *, exp(cum - max(cum) OVER (PARTITION BY track, resample ORDER BY t)) - 1 dd FROM (
    SELECT *, sum(r) OVER (PARTITION BY track, resample ORDER BY t) cum FROM samples)) GROUP BY track, resample) GROUP BY track""", **_LBOOT))
def m04(spark, d) -> DataFrame:
    return C.rounded(I.bootstrap_ci(cut(C.equity(spark, d)), N_BOOT, BLOCK), _CI)


@query("m05_paired_gap", sql(f"""SELECT {r('(SELECT avg(r) * 252 FROM rets)')} gap_annualized, {r('quantile_cont(a, 0.025)')} gap_lo,
    {r('quantile_cont(a, 0.5)')} gap_med, {r('quantile_cont(a, 0.975)')} gap_hi, {r('avg(CAST(a <= 0 AS INT))')} p_value_gap_le_0,
    (SELECT count(*) FROM rets) n_obs FROM (SELECT avg(r) * 252 a FROM samples GROUP BY resample)""", **_PAIR))
def m05(spark, d) -> DataFrame:
    return C.rounded(I.paired_gap(cut(_pair(spark, d)), N_BOOT, BLOCK),
                     ["gap_annualized", "gap_lo", "gap_med", "gap_hi", "p_value_gap_le_0"])


_TRIALS = """SELECT event_id, ts, event_type model, 'ret_' || (user_id % 6) "label", user_id % 6 horizon_d,
    CASE WHEN user_id % 5 <> 4 THEN user_id % 5 END threshold_q, 'all' universe, "value" headline_sharpe FROM events"""
_NTRIALS = f"""SELECT greatest(count(*), 1) k FROM (SELECT DISTINCT model, "label", horizon_d, threshold_q, universe FROM ({_TRIALS}))"""
_EMAX = "(SELECT CASE WHEN k <= 1 THEN 0 WHEN k <= 2 THEN sqrt(2 * ln(k)) ELSE sqrt(2 * ln(k)) - (ln(ln(k)) + 0.5772156649) / sqrt(2 * ln(k)) END FROM ntrials)"


@query("m06_deflated_sharpe", sql(f"""SELECT track, {r('sr')} observed_sharpe_daily, {r('thr * sqrt(252)')} deflated_sharpe_threshold_annualized,
    {r(PHI('z'))} deflated_sharpe_p_value_significant FROM (SELECT *, (sr - thr) * sqrt(n - 1) / sqrt(1 + 0.5 * sr * sr) z FROM (
    SELECT *, {_EMAX} * sqrt((1 + 0.5 * sr * sr) / (n - 1)) thr FROM (
    SELECT track, sharpe_annualized / sqrt(252) sr, (SELECT count(DISTINCT date) - 1 FROM bars) n FROM f_summary)))""", ntrials=_NTRIALS))
def m06(spark, d) -> DataFrame:
    e = cut(C.equity(spark, d))
    s = M.equity_summary(e).join(e.groupBy("track").agg((F.count("*") - 1).alias("n_obs")), "track")
    out = I.deflated_sharpe(s, n_trials=G.trial_count(T.trial_log(spark, d)).scalar())
    cols = ["observed_sharpe_daily", "deflated_sharpe_threshold_annualized", "deflated_sharpe_p_value_significant"]
    return C.rounded(out.select("track", *cols), cols)


@query("m07_effective_sample_size", sql(f"""SELECT track, {r('sum(u)')} n_eff FROM (SELECT d.track, d.ticker, d.entry_date, avg(1.0 / c) u FROM days d
    JOIN (SELECT track, held, count(*) c FROM days GROUP BY ALL) x ON x.track = d.track AND x.held = d.held GROUP BY ALL) GROUP BY track""",
    days="""SELECT * FROM (SELECT track, ticker, entry_date, CAST(unnest(generate_series(entry_date, exit_date, INTERVAL 1 DAY)) AS DATE) held
    FROM f_ledger) WHERE isodow(held) <= 5"""))
def m07(spark, d) -> DataFrame:
    return C.rounded(I.effective_sample_size(C.ledger(spark, d)), ["n_eff"])


@query("m08_spa_test", sql(f"""SELECT {', '.join(r(f'avg(CAST({k} > top AS INT))') + f' p_{k}' for k in ('lower', 'consistent', 'upper'))},
    (SELECT count(*) FROM par) n_strategies, (SELECT max(n) FROM par) n_obs FROM (
    SELECT resample, (SELECT greatest(max(mean / se), 0) FROM par) top, greatest(max((m - greatest(mean, 0)) / se), 0) lower,
      greatest(max((m - CASE WHEN mean >= -se * sqrt(2 * ln(ln(n))) THEN mean ELSE 0 END) / se), 0) consistent,
      greatest(max((m - mean) / se), 0) upper FROM boot JOIN par USING (track) GROUP BY resample)""", **_BOOT,
    boot="SELECT track, resample, avg(r) m FROM samples GROUP BY ALL",
    par="""SELECT * FROM (SELECT track, avg(r) mean, max(n) n FROM rets GROUP BY track)
      JOIN (SELECT track, stddev_pop(m) se FROM boot GROUP BY track) USING (track) WHERE se > 1e-12"""))
def m08(spark, d) -> DataFrame:
    return C.rounded(I.spa_test(cut(I.daily_returns(C.equity(spark, d))), N_BOOT, BLOCK), ["p_lower", "p_consistent", "p_upper"])


@query("m09_post_tax_cagr", sql(f"""SELECT track, {r('pow(greatest(1 + g / 100000.0, 0), 1 / y) - 1')} pre_tax_cagr,
    {r('pow(greatest((100000.0 + g - tax) / 100000.0, 0), 1 / y) - 1')} post_tax_cagr, {r('0.418')} blended_rate, {r('tax', 4)} total_tax, {r('y')} AS years FROM (
    SELECT track, sum(g) g, sum(greatest(g, 0) * 0.418) tax, CAST(count(*) AS DOUBLE) y FROM (
    SELECT track, year(exit_date) yr, sum(trade_return_pct * cost) g FROM f_ledger GROUP BY ALL) GROUP BY track)"""))
def m09(spark, d) -> DataFrame:
    p = I.post_tax_cagr(C.ledger(spark, d)).withColumn("total_tax", rnd("total_tax", 4))
    return C.rounded(p, ["pre_tax_cagr", "post_tax_cagr", "blended_rate", "years"])


@query("m10_trial_count", f"""SELECT greatest(count(*), 1) n_trials FROM (SELECT DISTINCT model, "label", horizon_d, threshold_q, universe FROM ({_TRIALS}))""")
def m10(spark, d) -> DataFrame:
    return G.trial_count(T.trial_log(spark, d))


@query("m11_se_widening", sql(f"""SELECT track, {r('sqrt(n_trades / greatest(n_eff, 1.0))')} se_widen FROM (
    SELECT track, count(*) n_trades FROM f_ledger GROUP BY track) JOIN (SELECT track, sum(u) n_eff FROM (
    SELECT d.track, d.ticker, d.entry_date, avg(1.0 / c) u FROM days d JOIN (SELECT track, held, count(*) c FROM days GROUP BY ALL) x
    ON x.track = d.track AND x.held = d.held GROUP BY ALL) GROUP BY track) USING (track)""",
    days="""SELECT * FROM (SELECT track, ticker, entry_date, CAST(unnest(generate_series(entry_date, exit_date, INTERVAL 1 DAY)) AS DATE) held
    FROM f_ledger) WHERE isodow(held) <= 5"""))
def m11(spark, d) -> DataFrame:
    led = C.ledger(spark, d)
    n = led.groupBy("track").agg(F.count("*").alias("n_trades"))
    return n.join(I.effective_sample_size(led), "track").select(
        "track", rnd(I.se_widening(F.col("n_trades"), F.col("n_eff"))).alias("se_widen"))


# --- N: governance -------------------------------------------------------------------------------

_CJSON = """'{"horizon_d":' || horizon_d || ',"label":"' || "label" || '","model":"' || model || '","threshold_q":' ||
    coalesce(CAST(threshold_q AS VARCHAR), 'null') || ',"universe":"' || universe || '"}'"""


@query("n01_config_hash", f"SELECT substr(sha256({_CJSON}), 1, 16) sha_config, count(*) n FROM ({_TRIALS}) GROUP BY ALL")
def n01(spark, d) -> DataFrame:
    return T.trial_log(spark, d).groupBy(G.config_hash(list(G.TRIAL_KEY)).alias("sha_config")).agg(F.count("*").alias("n"))


@query("n02_first_claim_wins", f"""SELECT event_id, model, horizon_d, CASE WHEN row_number() OVER (
    PARTITION BY model, horizon_d, coalesce(threshold_q, -1) ORDER BY ts, event_id) = 1 THEN 'accepted' ELSE 'refused' END status FROM ({_TRIALS})""")
def n02(spark, d) -> DataFrame:
    claims = T.trial_log(spark, d).withColumn("q", F.coalesce("threshold_q", F.lit(-1)))
    return G.first_claim_wins(claims, ["model", "horizon_d", "q"], ["ts", "event_id"]).select("event_id", "model", "horizon_d", "status")


# Words of the corpus stand in for the sections and phrases of a report.
NEEDED = ("the", "que", "ein", "License")
BANNED = (r"\bthe\w*\b", r"\bcopyright\b", r"[\w.]+@[\w.]+", r"\b\d{3}-\d{2}\b")
_LINT = ", ".join([f"CASE WHEN NOT contains(text, '{w}') THEN 'missing required section: {w}' END" for w in NEEDED] + [
    f"CASE WHEN regexp_matches(text, '{p}', 'i') THEN 'forbidden phrase ''' || regexp_extract(text, '{p}', 0, 'i') || '''' END" for p in BANNED])


@query("n03_compliance_lint", f"""SELECT doc_id, len(e) n_errors, array_to_string(e, '; ') errors FROM (
    SELECT doc_id, list_filter([{_LINT}], lambda x: x IS NOT NULL) e FROM documents)""")
def n03(spark, d) -> DataFrame:
    out = G.compliance_lint(T.table(spark, d, "documents").select("doc_id", "text"), required=NEEDED, forbidden=BANNED)
    return out.select("doc_id", F.size("errors").cast("bigint").alias("n_errors"), F.concat_ws("; ", "errors").alias("errors"))


@query("n03_compliance_lint_counts", f"""SELECT error, count(*) n FROM (SELECT unnest([{', '.join(
    f"CASE WHEN NOT contains(text, '{w}') THEN 'missing required section: {w}' END" for w in G.REQUIRED_SECTIONS)}]) error FROM documents)
    WHERE error IS NOT NULL GROUP BY error""")
def n03b(spark, d) -> DataFrame:
    out = G.compliance_lint(T.table(spark, d, "documents").select("text"), forbidden=())
    return out.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("n04_report_card_rows")
def n04(spark, d) -> DataFrame:
    led, eq = _fitted(spark, d)
    return ST.report_card_rows(M.compute_summary(eq, led), eq, led, T.trial_log(spark, d), "gbt_engineered",
                               "rank_inv_60d_vol", N_BOOT, BLOCK)


# --- O: increments and streams -------------------------------------------------------------------


def _picks(spark, d) -> DataFrame:
    return _uscores(spark, d).select(
        "ticker", "anchor_date", F.date_format(F.date_add("anchor_date", 2), "yyyy-MM-dd").alias("pick_generated"),
        F.when(F.month("anchor_date") > 6, 300).otherwise(40).alias("horizon_days"), "score", "track")


_PICKS = f"""SELECT u.*, strftime(anchor_date + 2, '%Y-%m-%d') pick_generated, CASE WHEN month(anchor_date) > 6 THEN 300 ELSE 40 END horizon_days
    FROM ({_USCORE}) u"""
_SETTLED = f"""SELECT p.pick_generated, p.ticker, p.horizon_days, p.anchor_date, b.close entry_close, x.date exit_date, x.close exit_close,
    {r('x.close / b.close - 1')} realized_ret, {r('p.score')} score, p.track FROM opicks p JOIN ix b ON b.ticker = p.ticker AND b.date = p.anchor_date
    JOIN ix x ON x.ticker = p.ticker AND x.idx = b.idx + p.horizon_days WHERE b.close > 0"""


@query("o01_settle_picks", sql(_SETTLED, opicks=_PICKS))
def o01(spark, d) -> DataFrame:
    return C.rounded(Z.settle_picks(_picks(spark, d), C.bars(spark, d)), ["realized_ret", "score"])


@query("o01_settle_counts", sql("""SELECT (SELECT count(*) FROM opicks) picks_seen, (SELECT count(*) FROM settled) newly_settled,
    (SELECT count(*) FROM opicks) - (SELECT count(*) FROM settled) still_pending""", opicks=_PICKS, settled=_SETTLED))
def o01b(spark, d) -> DataFrame:
    p = _picks(spark, d)
    return Z.settle_counts(p, None, cut(Z.settle_picks(p, C.bars(spark, d))))


FEED_FILES = 100_000  # a delivery is taken in one trigger, however many files it has


def _feed(df: DataFrame, path: str, stream) -> None:
    """The panel in three deliveries by time, each written by as many tasks as it has and then streamed."""
    for lo, hi in ((0, 1998), (1999, 2000), (2001, 9999)):
        df.filter(F.year("date").between(lo, hi)).write.mode("append").parquet(path)
        stream().awaitTermination()


@query("o02_settle_stream", sql(_SETTLED, opicks=_PICKS))
def o02(spark, d) -> DataFrame:
    base = scratch_path(spark, "settle")
    picks = cut(_picks(spark, d))
    _feed(C.bars(spark, d), f"{base}/bars", lambda: Z.settle_stream(
        spark, f"{base}/bars", picks, f"{base}/realized", f"{base}/ck", FEED_FILES))
    return C.rounded(Z.read_realized(spark, f"{base}/realized"), ["realized_ret", "score"])


@query("o03_weekly_forward_picks")
def o03(spark, d) -> DataFrame:
    return ST.weekly_forward_picks(
        C.bars(spark, d), T.market_bars(spark, d), "2001-06-15", threshold_pct=10, min_adv=1e6,
        prefilter=False)


@query("o04_bars_dedupe_stream", sql(f"""SELECT ticker, date, open, high, low,
    CASE WHEN day(date) = 13 THEN {r('close * 1.01::DOUBLE', 4)} ELSE close END "close", volume FROM bars"""))
def o04(spark, d) -> DataFrame:
    base = scratch_path(spark, "feed")
    raw = T.raw_bars(spark, d, C.bars(spark, d))  # read by each delivery, so from the panel that is cut
    _feed(raw.toDF(*[c.lower() for c in raw.columns]), f"{base}/in", lambda: Z.bars_dedupe_stream(
        spark, f"{base}/in", f"{base}/store", f"{base}/ck", FEED_FILES))
    return Z.bars_current(spark, f"{base}/store")


@query("o05_idempotent_append", sql("SELECT count(*) n, count(DISTINCT pick_generated || ticker || horizon_days) keys FROM settled", opicks=_PICKS, settled=_SETTLED))
def o05(spark, d) -> DataFrame:
    new = cut(Z.settle_picks(_picks(spark, d), C.bars(spark, d)))
    half = new.filter(F.year("anchor_date") < 2000)
    base = scratch_path(spark, "settled")
    for rows in (half, new, new):
        Z.append_version(spark, base, rows, Z.PICK_KEY)
    return Z.newest_version(spark, base).agg(F.count("*").alias("n"), F.count_distinct(*Z.PICK_KEY).alias("keys"))


# --- P: reports ----------------------------------------------------------------------------------


@query("p01_selection_funnel", sql("""SELECT 1 step, 'bars' stage, count(*) n FROM bars UNION ALL SELECT 2, 'eligible', count(*) FROM elig
    UNION ALL SELECT 3, 'anchors', count(*) FROM outcomes UNION ALL SELECT 4, 'prefilter', count(*) FROM outcomes WHERE ratio_ma250 > 1.5
    UNION ALL SELECT 5, 'liquid', count(*) FROM outcomes WHERE ratio_ma250 > 1.5 AND adv20_usd >= 5e6
    UNION ALL SELECT 6, 'picked', count(*) FROM f_held WHERE track = 'rank_252d_return'"""))
def p01(spark, d) -> DataFrame:
    return P.selection_funnel(C.bars(spark, d), C.lean(spark, d), C.ledger(spark, d).filter("track = 'rank_252d_return'"))


def _with_outcome(spark, d) -> DataFrame:
    return C.picks(spark, d).withColumnRenamed("fwd_ret", "fwd_ret_40d")


_POUT = {"pout": "SELECT p.*, o.fwd_ret_40d FROM picks p JOIN outcomes o USING (ticker, anchor_date)"}


@query("p02_cohort_outcome", sql(f"""SELECT track, anchor_date, ticker, {r('m')} cohort_mean, {r('CASE WHEN n > 1 THEN (s - fwd_ret_40d) / (n - 1) END')} mean_without
    FROM (SELECT *, avg(fwd_ret_40d) OVER (PARTITION BY track, anchor_date) m, sum(fwd_ret_40d) OVER (PARTITION BY track, anchor_date) s,
    count(*) OVER (PARTITION BY track, anchor_date) n FROM pout)""", **_POUT))
def p02(spark, d) -> DataFrame:
    return C.rounded(P.cohort_outcome(_with_outcome(spark, d), "fwd_ret_40d"), ["cohort_mean", "mean_without"])


@query("p03_filtered_out", sql(f"""SELECT track, CAST(adv20_usd >= 5e6 AS INT) kept, count(*) n, {r('avg(fwd_ret_40d)')} mean_outcome,
    {r('min(fwd_ret_40d)')} worst_outcome FROM pout GROUP BY ALL""", **_POUT))
def p03(spark, d) -> DataFrame:
    return C.rounded(P.filtered_out(_with_outcome(spark, d), "fwd_ret_40d"), ["mean_outcome", "worst_outcome"])


@query("p04_ranked_curves", sql(f"""SELECT e.track, CAST(date_trunc('month', date) AS DATE) "month", {r('arg_max(equity, date)', 4)} equity,
    {r('any_value(final_equity)', 4)} final_equity, CAST(any_value(place) AS INT) place FROM f_equity e JOIN (
    SELECT track, end_equity final_equity, row_number() OVER (ORDER BY round(end_equity, 2) DESC, track) place FROM f_summary) f ON f.track = e.track
    GROUP BY e.track, date_trunc('month', date)"""))
def p04(spark, d) -> DataFrame:
    p = P.ranked_curves(cut(C.equity(spark, d)))
    return p.withColumn("equity", rnd("equity", 4)).withColumn("final_equity", rnd("final_equity", 4))


@query("p05_base_rates", sql("SELECT year(anchor_date) \"year\", count(*) n, " + ", ".join(
    f"{r(f'avg({flag_sql(40, t / 100)})')} rate_{t}pct" for t in (5, 10, 25)) + " FROM outcomes GROUP BY ALL"))
def p05(spark, d) -> DataFrame:
    b = P.base_rates(C.labels(spark, d), 40, (5, 10, 25)).withColumn("year", F.col("year").cast("bigint"))
    return C.rounded(b, ["rate_5pct", "rate_10pct", "rate_25pct"])


@query("p06_run_summary", sql(f"""SELECT 'full' tag, (SELECT count(DISTINCT ticker) FROM outcomes) n_tickers, (SELECT count(*) FROM outcomes) n_anchors,
    track best_track, {r('end_equity', 2)} best_equity, {r('cagr')} best_cagr,
    {r('(SELECT median(cagr) FROM r_summary WHERE hold_days = 40)')} random_median_cagr,
    {r('(SELECT quantile_cont(end_equity, 0.95) FROM r_summary WHERE hold_days = 40)', 2)} random_p95_eq FROM f_summary
    ORDER BY round(end_equity, 2) DESC, track LIMIT 1""", **_RANDOM))
def p06(spark, d) -> DataFrame:
    null = M.null_distribution(_seeds(spark, d).filter("hold_days = 40"))
    out = P.run_summary(C.lean(spark, d), C.summary(spark, d), null, "full")
    out = C.rounded(out, ["best_cagr", "random_median_cagr"])
    return out.withColumn("best_equity", rnd("best_equity", 2)).withColumn("random_p95_eq", rnd("random_p95_eq", 2))
