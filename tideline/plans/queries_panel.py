"""Registered queries: sources, quality, anchors, labels, features, vectors and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.config import HORIZONS, THRESHOLDS, pct_tag
from tideline.functions.exprs import rnd
from tideline.operators import anchors as A
from tideline.operators import features as X
from tideline.operators import joins as J
from tideline.operators import quality as Q
from tideline.operators import vectors as V
from tideline.plans import common as C
from tideline.plans.checks import DAY, TICKER, W, flag_sql, path_label_sql, r, sql, win
from tideline.plans.registry import query
from tideline.session import scratch_path
from tideline.sources import artifacts, bars as B, tables as T, text as TX

# --- A: sources and sinks ------------------------------------------------------------------------


@query("a01_bars_source", sql(f"""SELECT ticker, count(*) n, min(date) first_date, max(date) last_date,
    {r('sum(close)', 2)} sum_close, {r('sum(volume)', 0)} sum_volume FROM bars GROUP BY ticker"""))
def a01(spark, d) -> DataFrame:
    path = scratch_path(spark, "bars")
    B.bars_sink(T.panel_bars(spark, d), path, skip_existing=False, buckets=8)
    return B.bars_source(spark, path).groupBy("ticker").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        rnd(F.sum("close"), 2).alias("sum_close"), rnd(F.sum("volume"), 0).alias("sum_volume"))


@query("a02_bars_normalize", sql(f"""SELECT ticker, date, open, high, low,
    CASE WHEN day(date) = 13 THEN {r('close * 1.01::DOUBLE', 4)} ELSE close END "close", volume FROM bars"""))
def a02(spark, d) -> DataFrame:
    return B.bars_normalize(T.raw_bars(spark, d), "seq")


@query("a03_bars_sink", sql(f"""SELECT (SELECT count(*) FROM supplier) requested,
    (SELECT count(DISTINCT b.ticker) FROM bars b JOIN univ u ON u.ticker = b.ticker WHERE NOT u.active) fetched,
    (SELECT count(*) FROM univ u WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = u.ticker)) empty_or_missing,
    (SELECT count(DISTINCT ticker) FROM bars) total_stored"""))
def a03(spark, d) -> DataFrame:
    path = scratch_path(spark, "bars")
    bars, uni = T.panel_bars(spark, d), T.universe_seed(spark, d)
    B.bars_sink(bars.join(uni.filter("active"), "ticker", "left_semi"), path, buckets=8)
    return B.bars_sink(bars, path, requested=uni, buckets=8)


_MARK = "CASE c_nationkey WHEN 1 THEN '.' WHEN 2 THEN '$' WHEN 3 THEN '^' ELSE '' END"
_DIRECTORY = f"""SELECT upper(substr(c_mktsegment, 1, 2)) || {_MARK} || c_custkey symbol,
    CASE WHEN c_nationkey = 4 THEN 'Y' ELSE 'N' END test_issue,
    CASE WHEN c_nationkey = 5 THEN 'y' WHEN c_nationkey = 6 THEN 'Y' ELSE 'N' END etf FROM customer"""


@query("a04_symbols_source", _DIRECTORY)
def a04(spark, d) -> DataFrame:
    path = scratch_path(spark, "symbols")
    T.symbol_directory(spark, d).write.option("sep", "|").option("header", True).csv(path)
    return TX.symbols_source(spark, path).toDF("symbol", "test_issue", "etf")


@query("a05_seed_list_source", """SELECT upper(s_name) ticker, false active FROM supplier
    WHERE s_nationkey NOT IN (0, 1)""")
def a05(spark, d) -> DataFrame:
    path = scratch_path(spark, "seed")
    name = F.lower("s_name")
    line = F.when(F.col("s_nationkey") == 0, F.concat(F.lit("  # "), name)).when(
        F.col("s_nationkey") == 1, F.lit("   ")).otherwise(F.concat(F.lit("  "), name, F.lit(" ")))
    T.table(spark, d, "supplier").select(line.alias("value")).write.text(path)
    return TX.seed_list_source(spark, path)


@query("a06_trial_log_source", """SELECT event_id, event_type model, 'ret_' || (user_id % 6) "label", user_id % 6 horizon_d,
    CASE WHEN user_id % 5 <> 4 THEN user_id % 5 END threshold_q, value headline_sharpe
    FROM events WHERE event_type <> 'error'""")
def a06(spark, d) -> DataFrame:
    path = scratch_path(spark, "trials")
    log = T.trial_log(spark, d).drop("ts")
    good = F.to_json(F.struct(*log.columns))
    log.select(F.when(F.col("model") == "error", F.substring(good, 1, 20)).otherwise(good).alias("value")).write.text(path)
    return TX.trial_log_source(spark, path).select(
        "event_id", "model", "label", "horizon_d", "threshold_q", "headline_sharpe")


@query("a07_picks_source", sql(f"""SELECT ticker, anchor_date, {r('anchor_close', 4)} anchor_close, 40 horizon_days,
    CASE WHEN month(anchor_date) > 6 THEN 'file' ELSE strftime(anchor_date, '%Y-%m-%d') END stamp FROM outcomes"""))
def a07(spark, d) -> DataFrame:
    path = scratch_path(spark, "picks")
    day = F.date_format("anchor_date", "yyyy-MM-dd")
    A.anchor_frame(C.bars(spark, d)).select(
        "ticker", "anchor_date", "anchor_close", F.lit(None).cast("double").alias("adv20_usd"),
        F.lit(None).cast("double").alias("score"),
        F.when(F.month("anchor_date") <= 6, day).alias("pick_generated"), F.lit(40).alias("horizon_days"),
        F.lit("t").alias("track")).write.option("header", True).csv(path)
    p = TX.picks_source(spark, path)
    stamp = F.when(F.col("pick_generated").startswith("part-"), "file").otherwise(F.col("pick_generated"))
    return p.select("ticker", "anchor_date", rnd("anchor_close", 4).alias("anchor_close"), "horizon_days",
                    stamp.alias("stamp"))


_ISSUER = """c_name || CASE WHEN c_acctbal < 0 THEN '' ELSE '  (' || substr(c_mktsegment, 1, 2) || (c_custkey % 100000) || ', '
    || substr(c_mktsegment, 1, 2) || (c_custkey % 100000) || '-WT)' END || '  (CIK ' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') || ')'"""
_FILINGS = f"""SELECT 'A-' || o_orderkey accession, CAST(c_custkey AS VARCHAR) cik, {_ISSUER} issuer,
    strftime(o_orderdate, '%Y-%m-%d') filing_date, CASE WHEN o_orderstatus = 'F' THEN '25' ELSE '25-NSE' END form,
    c_acctbal, c_nationkey, substr(c_mktsegment, 1, 2) || (c_custkey % 100000) sym
    FROM orders JOIN customer ON o_custkey = c_custkey"""


@query("a08_filings_source", f"SELECT accession, cik, issuer, filing_date, form FROM ({_FILINGS})")
def a08(spark, d) -> DataFrame:
    path = scratch_path(spark, "filings")
    T.filings(spark, d).write.json(path)
    return TX.filings_source(spark, path)


@query("a09_artifact_sinks", sql(f"""SELECT 'scores' artifact, track, count(*) n, {r('sum(anchor_close)', 2)} total FROM scores GROUP BY track
    UNION ALL SELECT 'labels', 'all', count(*), {r('sum(anchor_close)', 2)} FROM outcomes
    UNION ALL SELECT 'summary', track, count(*), {r('sum(anchor_close)', 2)} FROM scores GROUP BY track
    UNION ALL SELECT 'headline', 'all', count(*), {r('sum(anchor_close)', 2)} FROM scores
    UNION ALL SELECT 'features', 'all', count(*), {r('sum(ratio_ma200)', 2)} FROM feats
    UNION ALL SELECT 'equity', track, count(*), {r('sum(equity)', 2)} FROM f_equity GROUP BY track
    UNION ALL SELECT 'ledger', track, count(*), {r('sum(cost)', 2)} FROM f_ledger GROUP BY track"""))
def a09(spark, d) -> DataFrame:
    sc, lab = C.scores(spark, d), C.labels(spark, d)
    base = scratch_path(spark, "run")
    per = sc.groupBy("track").agg(F.count("*").alias("n"), F.sum("anchor_close").alias("total"))
    led = C.ledger(spark, d)
    paths = artifacts.write_artifacts(base, labels=lab, scores=sc, features=C.features(spark, d), equity=C.equity(spark, d), ledger=led)
    stored = spark.read.parquet(paths["scores"])
    per = stored.groupBy("track").agg(F.count("*").alias("n"), F.sum("anchor_close").alias("total"))
    paths |= artifacts.write_artifacts(base, summary=per, headline=per.agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")))
    out = lambda df, name, track: df.select(
        F.lit(name).alias("artifact"), track.alias("track"), F.col("n").cast("bigint").alias("n"),
        rnd("total", 2).alias("total"))
    read_csv = spark.read.schema("track string, n bigint, total double").option("header", True).csv(paths["summary"])

    def totals(name: str, col: str, track: str | None = None) -> DataFrame:
        stored = spark.read.parquet(paths[name]).withColumn("_track", F.col(track) if track else F.lit("all"))
        return out(stored.groupBy("_track").agg(F.count("*").alias("n"), F.sum(col).alias("total")), name, F.col("_track"))

    lab_back = spark.read.parquet(paths["labels"]).agg(F.count("*").alias("n"), F.sum("anchor_close").alias("total"))
    return (out(per, "scores", F.col("track")).unionByName(out(lab_back, "labels", F.lit("all")))
            .unionByName(out(read_csv, "summary", F.col("track")))
            .unionByName(out(spark.read.schema("n bigint, total double").json(paths["headline"]), "headline", F.lit("all")))
            .unionByName(totals("features", "ratio_ma200")).unionByName(totals("equity", "equity", "track"))
            .unionByName(totals("ledger", "cost", "track")))


@query("a10_sample_tickers", sql("SELECT ticker FROM univ ORDER BY md5('42|' || ticker), ticker LIMIT 8"))
def a10(spark, d) -> DataFrame:
    return Q.sample_tickers(T.universe_seed(spark, d), 8, 42)


@query("a11_pruned_scan", """SELECT l_returnflag, CAST(sum(l_quantity) AS BIGINT) sum_qty FROM lineitem GROUP BY ALL""")
def a11(spark, d) -> DataFrame:
    return T.table(spark, d, "lineitem").select("l_returnflag", "l_quantity").groupBy("l_returnflag").agg(
        F.sum("l_quantity").cast("bigint").alias("sum_qty"))


# --- B: universe and data quality ----------------------------------------------------------------


@query("b01_universe_filter", f"""SELECT DISTINCT symbol ticker, true active FROM ({_DIRECTORY})
    WHERE test_issue = 'N' AND upper(etf) <> 'Y' AND NOT regexp_matches(symbol, '[$.^]')""")
def b01(spark, d) -> DataFrame:
    return Q.universe_filter(T.symbol_directory(spark, d))


@query("b02_universe_build", sql(f"""SELECT ticker, bool_or(active) active FROM (SELECT ticker, true active FROM univ WHERE active
    UNION ALL SELECT DISTINCT {TICKER.format('l_suppkey')}, false FROM lineitem) GROUP BY ticker"""))
def b02(spark, d) -> DataFrame:
    delisted = T.table(spark, d, "lineitem").select(T.ticker_of("l_suppkey").alias("ticker"), F.lit(False).alias("active"))
    return Q.universe_build(T.universe_seed(spark, d).filter("active"), delisted)


_FOUND = f"""SELECT accession, issuer, cik, filing_date, form, unnest(CASE WHEN c_acctbal < 0
    THEN (CASE WHEN c_nationkey % 2 = 0 THEN ['M' || cik] ELSE [] END) ELSE [sym, sym || '-WT'] END) ticker FROM ({_FILINGS})"""


@query("b03_extract_tickers", f"""SELECT issuer, count(*) n, CASE WHEN c_acctbal < 0 THEN '' ELSE sym || ',' || sym || '-WT' END symbols
    FROM ({_FILINGS}) GROUP BY ALL""")
def b03(spark, d) -> DataFrame:
    f = TX.flatten_filings(T.filings(spark, d))
    # The text is parsed once per distinct name, not once per filing.
    return f.groupBy("issuer").agg(F.count("*").alias("n")).withColumn(
        "symbols", F.concat_ws(",", Q.extract_tickers("issuer")))


@query("b04_cik_fallback_join", f"SELECT ticker, issuer, cik, filing_date, form, accession FROM ({_FOUND})")
def b04(spark, d) -> DataFrame:
    return Q.cik_fallback_join(TX.flatten_filings(T.filings(spark, d)), T.cik_master(spark, d))


TERMINAL = "2001-10-20"
_TAIL = """SELECT b.* EXCLUDE (volume), CASE WHEN NOT u.active AND back <= 12 THEN 0 ELSE volume END volume FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) back FROM bars) b LEFT JOIN univ u USING (ticker)"""
_FLAGGED = f"""SELECT * FROM (SELECT ticker, last_date, {r('last_close', 4)} last_close, {r('avg_vol', 1)} last_20d_avg_volume,
    {r('dd', 4)} last_20d_max_drawdown, zrun trailing_zero_volume_days,
    concat_ws('|', CASE WHEN last_date < DATE '{TERMINAL}' THEN 'early_terminal' END,
      CASE WHEN zrun >= 10 THEN 'zerovol' || zrun END,
      CASE WHEN last_close <= 0.10 THEN 'subdime_close' WHEN last_close < 0.5 AND avg_vol < 5000 THEN 'penny_distress' END,
      CASE WHEN dd >= 0.9 THEN 'bagel_drop' END, CASE WHEN last_close = 0 THEN 'zero_close' END) reasons FROM (
    SELECT *, CASE WHEN peak > 0 THEN (peak - last_close) / peak ELSE 0 END dd FROM (
    SELECT ticker, count(*) n, max(date) last_date, arg_max(close, date) last_close, avg(volume) FILTER (WHERE back <= 20) avg_vol,
      max(close) FILTER (WHERE back <= 20) peak, coalesce(min(back) FILTER (WHERE volume <> 0) - 1, count(*)) zrun
    FROM tail GROUP BY ticker) WHERE n >= 20)) WHERE reasons <> ''"""


@query("b05_delisting_classifier", sql("SELECT * FROM flagged", tail=_TAIL, flagged=_FLAGGED))
def b05(spark, d) -> DataFrame:
    return Q.delisting_classifier(T.tail_bars(spark, d), TERMINAL)


@query("b06_suffix_filter", """SELECT c_custkey, upper(c_mktsegment) || substr('WUR', 1 + CAST(c_nationkey % 3 AS INT), CAST(c_nationkey % 2 AS INT)) ticker
    FROM customer WHERE NOT regexp_matches(upper(c_mktsegment) || substr('WUR', 1 + CAST(c_nationkey % 3 AS INT), CAST(c_nationkey % 2 AS INT)), '[WUR]$')""")
def b06(spark, d) -> DataFrame:
    suffix = F.substring(F.lit("WUR"), 1 + F.col("c_nationkey") % 3, F.col("c_nationkey") % 2)
    c = T.table(spark, d, "customer").select("c_custkey", F.concat(F.upper("c_mktsegment"), suffix).alias("ticker"))
    return Q.suffix_filter(c)


@query("b07_incremental_vs_active", sql("""SELECT ticker, reasons FROM flagged f
    WHERE NOT EXISTS (SELECT 1 FROM univ u WHERE u.active AND u.ticker = f.ticker)""", tail=_TAIL, flagged=_FLAGGED))
def b07(spark, d) -> DataFrame:
    flagged = Q.delisting_classifier(T.tail_bars(spark, d), TERMINAL).select("ticker", "reasons")
    return Q.not_in_active(flagged, T.universe_seed(spark, d))


@query("b08_reason_counts", sql("""SELECT reasons, count(*) n FROM flagged GROUP BY reasons ORDER BY n DESC, reasons LIMIT 10""",
                                tail=_TAIL, flagged=_FLAGGED))
def b08(spark, d) -> DataFrame:
    return Q.reason_counts(Q.delisting_classifier(T.tail_bars(spark, d), TERMINAL))


_ROW = """strftime(date, '%Y-%m-%d') || ',' || CAST(round(open * 10000) AS BIGINT) || ',' || CAST(round(high * 10000) AS BIGINT)
    || ',' || CAST(round(low * 10000) AS BIGINT) || ',' || CAST(round(close * 10000) AS BIGINT) || ',' || CAST(volume AS BIGINT)"""
_PRINTS = "SELECT ticker, sha256(string_agg({row}, chr(10) ORDER BY {row})) content_hash, count(*) n_rows FROM {src} GROUP BY ticker"


@query("b09_partition_fingerprint", sql(f"""SELECT ticker, content_hash, n_rows FROM prints UNION ALL
    SELECT '*', sha256(string_agg(bucket || '=' || h, chr(10) ORDER BY bucket || '=' || h)), CAST(sum(k) AS BIGINT) FROM (
      SELECT substr(md5(ticker), 1, 4) bucket, count(*) k,
        sha256(string_agg(ticker || '=' || content_hash, chr(10) ORDER BY ticker || '=' || content_hash)) h FROM prints GROUP BY ALL)""",
    prints=_PRINTS.format(row=_ROW, src="bars")))
def b09(spark, d) -> DataFrame:
    prints = Q.partition_fingerprint(T.panel_bars(spark, d))
    total = Q.combined_fingerprint(prints).select(
        F.lit("*").alias("ticker"), F.col("combined_hash").alias("content_hash"), F.col("file_count").alias("n_rows"))
    return prints.unionByName(total)


@query("b10_snapshot_diff", sql("""SELECT coalesce(o.ticker, n.ticker) ticker, CASE WHEN n.ticker IS NULL THEN 'missing'
    WHEN o.ticker IS NULL THEN 'added' WHEN o.content_hash <> n.content_hash THEN 'changed' ELSE 'ok' END status
    FROM (SELECT p.* FROM prints p JOIN supplier s ON p.ticker = 'S' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') WHERE s_nationkey <> 0) o
    FULL JOIN (SELECT p.ticker, CASE WHEN s_nationkey < 5 THEN q.content_hash ELSE p.content_hash END content_hash
      FROM prints p JOIN supplier s ON p.ticker = 'S' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')
      JOIN prints2 q ON p.ticker = q.ticker WHERE s_nationkey <> 1) n ON o.ticker = n.ticker""",
    prints=_PRINTS.format(row=_ROW, src="bars"), tweaked="""SELECT ticker, date, open, high, low,
      CASE WHEN date = max(date) OVER (PARTITION BY ticker) THEN close + 1 ELSE close END "close", volume FROM bars""",
    prints2=_PRINTS.format(row=_ROW, src="tweaked")))
def b10(spark, d) -> DataFrame:
    from pyspark.sql import Window

    bars = C.bars(spark, d)
    s = T.table(spark, d, "supplier").select(T.ticker_of("s_suppkey").alias("ticker"), "s_nationkey")
    j = bars.join(s, "ticker")
    old = j.filter("s_nationkey <> 0")
    newest = F.col("date") == F.max("date").over(Window.partitionBy("ticker"))
    new = j.filter("s_nationkey <> 1").withColumn(
        "close", F.when(newest & (F.col("s_nationkey") < 5), F.col("close") + 1).otherwise(F.col("close")))
    return Q.snapshot_diff(Q.partition_fingerprint(old), Q.partition_fingerprint(new))


@query("b11_staleness_check", sql("""SELECT max(date) newest_bar, CAST(DATE '2001-11-20' - max(date) AS INT) stale_days,
    CAST(DATE '2001-11-20' - max(date) > 7 AS INT) is_stale FROM bars"""))
def b11(spark, d) -> DataFrame:
    return Q.staleness_check(T.panel_bars(spark, d), "2001-11-20")


@query("b12_min_history_filter", sql("""SELECT ticker, count(*) n FROM bars GROUP BY ticker HAVING count(*) >= 452 + 40 + 2"""))
def b12(spark, d) -> DataFrame:
    return Q.min_history_filter(T.panel_bars(spark, d), 452, 40).groupBy("ticker").agg(F.count("*").alias("n"))


@query("b13_has_bars", sql("SELECT ticker, active FROM univ u WHERE EXISTS (SELECT 1 FROM bars b WHERE b.ticker = u.ticker)"))
def b13(spark, d) -> DataFrame:
    return Q.has_bars(T.universe_seed(spark, d), T.panel_bars(spark, d))


# --- C: anchors and labels -----------------------------------------------------------------------


@query("c01_with_bar_index", sql("SELECT ticker, date, idx FROM ix"))
def c01(spark, d) -> DataFrame:
    return Q.with_bar_index(T.panel_bars(spark, d)).select("ticker", "date", "idx")


@query("c02_eligible_bars", sql("SELECT ticker, date, idx, n_bars FROM elig"))
def c02(spark, d) -> DataFrame:
    return A.eligible_bars(T.panel_bars(spark, d)).select("ticker", "date", "idx", "n_bars")


@query("c03_weekly_anchors", sql("SELECT ticker, date anchor_date, idx anchor_idx FROM weekly"))
def c03(spark, d) -> DataFrame:
    return A.weekly_anchors(C.bars(spark, d)).select(
        "ticker", F.col("date").alias("anchor_date"), F.col("idx").alias("anchor_idx"))


@query("c04_ma_extension", sql(f"SELECT ticker, date, {r('ratio_ma250')} ratio_ma250 FROM future"))
def c04(spark, d) -> DataFrame:
    return T.panel_bars(spark, d).select("ticker", "date", rnd(A.ma_extension(250)).alias("ratio_ma250"))


@query("c05_adv", sql(f"SELECT ticker, date, {r('adv20_usd', 3)} adv20_usd FROM future"))
def c05(spark, d) -> DataFrame:
    return T.panel_bars(spark, d).select("ticker", "date", rnd(A.adv(20), 3).alias("adv20_usd"))


@query("c06_prefilter_flag", sql("""SELECT ticker, anchor_date, CAST(coalesce(ratio_ma250 > 1.5, false) AS INT) prefilter_ma250_15 FROM outcomes"""))
def c06(spark, d) -> DataFrame:
    return C.ints(C.labels(spark, d).select("ticker", "anchor_date", "prefilter_ma250_15"), "prefilter_ma250_15")


def _per_horizon(fn, name: str, n: int | None = 6):
    def run(spark, d) -> DataFrame:
        cols = [(rnd(fn(h), n) if n is not None else fn(h)).alias(f"{name}_{h}d") for h in HORIZONS]
        return T.panel_bars(spark, d).select("ticker", "date", *cols)

    return run


def _per_horizon_sql(name: str, n: int | None = 6) -> str:
    return sql("SELECT ticker, date, " + ", ".join(
        (r(f"{name}_{h}d", n) if n is not None else f"{name}_{h}d") + f" {name}_{h}d" for h in HORIZONS) + " FROM future")


query("c07_forward_return", _per_horizon_sql("fwd_ret"))(_per_horizon(A.forward_return, "fwd_ret"))
query("c08_forward_log_return", _per_horizon_sql("fwd_log_ret"))(_per_horizon(A.forward_log_return, "fwd_log_ret"))
query("c09_resolution_date", _per_horizon_sql("resolution_date", None))(_per_horizon(A.resolution_date, "resolution_date", None))


def _from_labels(cols: dict[str, int | None]):
    """Some label columns by anchor: rounded to n digits, as int (0) or as they are (None)."""
    def run(spark, d) -> DataFrame:
        lab = C.labels(spark, d)
        return lab.select("ticker", "anchor_date", *[
            (F.col(c) if n is None else F.col(c).cast("int") if n == 0 else rnd(c, n)).alias(c) for c, n in cols.items()])

    return run


def _outcome_sql(exprs: dict[str, str], cols: dict[str, int | None]) -> str:
    return sql("SELECT ticker, anchor_date, " + ", ".join(
        (r(exprs.get(c, c), n) if n else exprs.get(c, c)) + f" {c}" for c, n in cols.items()) + " FROM outcomes")


for _id, _name in (("c10", "mfe"), ("c11", "mae")):
    _cols = {f"fwd_{_name}_{h}d": 6 for h in HORIZONS}
    query(f"{_id}_{_name}", _outcome_sql({}, _cols))(_from_labels(_cols))

_GRID = {f"ret_{h}d_ge_{pct_tag(t)}pct": flag_sql(h, t) for h in HORIZONS for t in THRESHOLDS}
query("c12_threshold_grid", _outcome_sql(_GRID, dict.fromkeys(_GRID, 0)))(_from_labels(dict.fromkeys(_GRID, 0)))


_CELLS = ", ".join(f"{{'horizon': {h}, 'fwd': fwd_ret_{h}d}}" for h in HORIZONS)


@query("c12_threshold_grid_long", sql(f"""SELECT ticker, anchor_date, h.horizon horizon, threshold_pct, {r('h.fwd')} fwd_ret,
    CAST(h.fwd >= threshold_pct / 100.0::DOUBLE AS INT) hit FROM (
    SELECT ticker, anchor_date, h, unnest([5, 10, 15, 20, 25, 30]) threshold_pct FROM (
    SELECT ticker, anchor_date, unnest([{_CELLS}]) h FROM outcomes))"""))
def c12l(spark, d) -> DataFrame:
    return A.long_labels(C.labels(spark, d)).withColumn("fwd_ret", rnd("fwd_ret"))


_PATHS = {k: v for h in HORIZONS for k, v in path_label_sql(h).items()}
for _key, _pre, _digits in (("c13_tb_approx", "tb_approx", 0), ("c14_mfe_mae_ratio", "mfe_mae_ratio", 3),
                            ("c15_sortino_label", "sortino_label", 3), ("c16_upside_dominance", "upside_dominance", 0),
                            ("c17_clean_run", "clean_run", 0)):
    _cols = {c: _digits for c in _PATHS if c.startswith(_pre)}
    if _digits:
        # Labels are stored as 32-bit floats; so is the check.
        _sql = {c: f"CAST({_PATHS[c]} AS FLOAT)" for c in _cols}
    else:
        _sql = _PATHS
    query(_key, _outcome_sql(_sql, _cols))(_from_labels(_cols))


@query("c18_build_labels", sql(f"""SELECT ticker, anchor_date, anchor_close, anchor_idx, {r('ratio_ma250')} ratio_ma250,
    {r('adv20_usd', 3)} adv20_usd, {r('fwd_ret_40d')} fwd_ret_40d, resolution_date_40d, {flag_sql(40, 0.25)} ret_40d_ge_25pct
    FROM outcomes WHERE ratio_ma250 > 1.5"""))
def c18(spark, d) -> DataFrame:
    lab = C.labels(spark, d, prefilter_only=True)
    return lab.select("ticker", "anchor_date", "anchor_close", "anchor_idx", rnd("ratio_ma250").alias("ratio_ma250"),
                      rnd("adv20_usd", 3).alias("adv20_usd"), rnd("fwd_ret_40d").alias("fwd_ret_40d"),
                      "resolution_date_40d", F.col("ret_40d_ge_25pct").cast("int").alias("ret_40d_ge_25pct"))


TODAY = "2001-06-15"
_LATEST = f"""SELECT * FROM (SELECT *, close / ma ratio FROM (
    SELECT ticker, date, CAST(row_number() {W} - 1 AS INT) idx, close, avg(close) {win(-249, 0)} ma,
      avg(close * volume) {win(-19, 0)} adv, max(date) OVER (PARTITION BY ticker) newest FROM bars WHERE date <= DATE '{TODAY}')
    WHERE date = newest AND idx >= 251 AND close > 0 AND ma > 0)"""


@query("c19_latest_candidates", sql(f"""SELECT ticker, date anchor_date, idx anchor_idx, close anchor_close,
    {r('adv', 3)} adv20_usd, {r('ratio')} ratio_ma250 FROM latest WHERE ratio > 1.1""", latest=_LATEST))
def c19(spark, d) -> DataFrame:
    from tideline.config import StudyConfig

    c = A.latest_candidates(T.panel_bars(spark, d), TODAY, StudyConfig(ma_extension=1.1))
    return C.rounded(c.withColumn("adv20_usd", rnd("adv20_usd", 3)), ["ratio_ma250"])


# --- D and E: features ---------------------------------------------------------------------------

FEATURE_GROUPS = {
    "d01_returns": ["ret_1d", "ret_5d", "ret_21d", "ret_63d", "ret_126d", "ret_252d", "ret_252d_minus_21d"],
    "d07_volatility": ["vol_21d", "vol_63d", "vol_252d", "vol_21d_div_252d", "vol_of_vol_ratio_30_120"],
    "d10_drawdowns": ["max_dd_252d", "current_dd_from_peak", "days_since_252d_high", "dd_count_5pct_120d",
                      "days_since_60d_high"],
    "d13_levels": ["pct_from_252d_high", "pct_from_21d_high", "ratio_ma20", "ratio_ma50", "ratio_ma200",
                   "pct_from_60d_high", "pct_from_60d_low", "bb_width_pct_20"],
    "d18_volume": ["log_dollar_vol_z252", "vol_ratio_20_252", "vol_trend_slope_60d", "ret_vol_corr_20"],
    "d21_moments": ["skew_252d", "kurt_252d", "up_day_frac_63d"],
    "d23_market_beta": ["beta_spy_63d"],
    "d24_trend": ["above_ma200_frac_252d", "slope_20", "slope_60", "slope_accel", "trendline_residual_z_60",
                  "r2_log_60", "swing_count_60d"],
    "d41_sanitize_features": ["ret_1d", "vol_21d"],
    "d42_compute_features": list(X.FEATURE_COLS),
}


def _feature_query(cols: list[str], clean: bool):
    def run(spark, d) -> DataFrame:
        f = C.features(spark, d)
        if clean:
            # Break some values first: division by zero and a null must both come out as 0.
            f = f.withColumns({"ret_1d": F.when(F.col("anchor_idx") % 2 == 0, F.lit(float("inf"))).otherwise(F.col("ret_1d")),
                               "vol_21d": F.when(F.col("anchor_idx") % 3 == 0, F.lit(None)).otherwise(F.col("vol_21d"))})
            f = X.sanitize_features(f, cols)
        return f.select("ticker", "anchor_date", *[rnd(c, 5).alias(c) for c in cols])

    return run


for _key, _names in FEATURE_GROUPS.items():
    _clean = _key == "d41_sanitize_features"
    _exprs = {"ret_1d": "CASE WHEN anchor_idx % 2 = 0 THEN 0 ELSE ret_1d END",
              "vol_21d": "CASE WHEN anchor_idx % 3 = 0 THEN 0 ELSE vol_21d END"} if _clean else {}
    query(_key, sql("SELECT ticker, anchor_date, " + ", ".join(
        f"{r(_exprs.get(c, c), 5)} {c}" for c in _names) + " FROM feats"))(_feature_query(_names, _clean))


@query("e01_align_market", sql(f"SELECT ticker, date, {r('mkt', 4)} mkt FROM walign"))
def e01(spark, d) -> DataFrame:
    return X.align_market(T.panel_bars(spark, d), T.weekly_market(spark, d)).select(
        "ticker", "date", rnd("mkt", 4).alias("mkt"))


# --- F: vectors ----------------------------------------------------------------------------------

_NORM = """list_transform(arr, lambda v: least(greatest((ln(greatest(v / arr[1], 1e-6)) - ln(0.1)) / (ln(11.0) - ln(0.1)), 0.0), 1.0))"""


def _charts(spark, d) -> DataFrame:
    bars = C.bars(spark, d)
    return V.chart_vectors(bars, A.anchor_frame(bars))


def _sums(col: str):
    return F.aggregate(col, F.lit(0.0), lambda a, x: a + x)


def _list_md5(name: str) -> str:
    """Hash of all values of a list, to four digits."""
    return f"md5(array_to_string(list_transform({name}, lambda y: CAST(round(y * 10000) AS BIGINT)), ','))"


def _array_md5(name: str):
    return F.md5(F.array_join(F.transform(name, lambda y: F.round(y * 10000).cast("bigint").cast("string")), ",").cast("binary"))


@query("f01_chart_vector", sql(f"""SELECT ticker, anchor_date, {r('n[1]')} first_y, {r('n[252]')} last_y, {r('list_sum(n)', 5)} sum_y,
    {r('list_max(n)')} max_y, {_list_md5('n')} whole FROM (SELECT ticker, anchor_date, {_NORM} n FROM feats)"""))
def f01(spark, d) -> DataFrame:
    return _charts(spark, d).select(
        "ticker", "anchor_date", rnd(F.col("chart")[0]).alias("first_y"), rnd(F.col("chart")[251]).alias("last_y"),
        rnd(_sums("chart"), 5).alias("sum_y"), rnd(F.array_max("chart")).alias("max_y"), _array_md5("chart").alias("whole"))


_PIX = f"list_transform({_NORM}, lambda y: CAST(round((1.0 - y) * 223) AS INT))"


@query("f02_chart_pixels", sql(f"""SELECT ticker, anchor_date, CAST(list_sum(p) AS BIGINT) pixel_sum, p[1] first_pixel, p[252] last_pixel
    FROM (SELECT ticker, anchor_date, {_PIX} p FROM feats)"""))
def f02(spark, d) -> DataFrame:
    total = F.aggregate("pixels", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return _charts(spark, d).select("ticker", "anchor_date", total.alias("pixel_sum"),
                                    F.col("pixels")[0].alias("first_pixel"), F.col("pixels")[251].alias("last_pixel"))


@query("f03_chart_fingerprint", sql(f"""SELECT sha256(array_to_string({_PIX}, ',')) fingerprint, count(*) n FROM feats GROUP BY ALL"""))
def f03(spark, d) -> DataFrame:
    return _charts(spark, d).groupBy("fingerprint").agg(F.count("*").alias("n"))


@query("f04_volume_vector", sql(f"""SELECT ticker, anchor_date, {r('z[1]')} first_z, {r('z[252]')} last_z, {r('list_max(z)')} max_z, {_list_md5('z')} whole FROM (
    SELECT ticker, anchor_date, list_transform(varr, lambda v: (v - m) / (s + 1e-9)) z FROM (
    SELECT *, list_avg(varr) m, list_stddev_pop(varr) s FROM feats))"""))
def f04(spark, d) -> DataFrame:
    bars = C.bars(spark, d)
    v = F.col("volume_vector")
    return V.volume_vectors(bars, A.anchor_frame(bars)).select(
        "ticker", "anchor_date", rnd(v[0]).alias("first_z"), rnd(v[251]).alias("last_z"), rnd(F.array_max(v)).alias("max_z"),
        _array_md5("volume_vector").alias("whole"))


@query("f05_vector_explain")
def f05(spark, d) -> DataFrame:
    return V.vector_explain(T.table(spark, d, "embeddings"), "embedding", 64)


# --- G: joins ------------------------------------------------------------------------------------


@query("g01_features_join_labels", sql(f"""SELECT ticker, anchor_date, {r('ret_63d')} ret_63d, {r('fwd_ret_40d')} fwd_ret_40d
    FROM feats JOIN outcomes USING (ticker, anchor_date)"""))
def g01(spark, d) -> DataFrame:
    return C.features(spark, d).join(C.labels(spark, d), ["ticker", "anchor_date"]).select(
        "ticker", "anchor_date", rnd("ret_63d").alias("ret_63d"), rnd("fwd_ret_40d").alias("fwd_ret_40d"))


@query("g02_scores_join_meta", sql(f"SELECT track, ticker, anchor_date, {r('score')} score, {r('adv20_usd', 3)} adv20_usd, resolution_date FROM scores"))
def g02(spark, d) -> DataFrame:
    return C.scores(spark, d).select("track", "ticker", "anchor_date", rnd("score").alias("score"),
                                     rnd("adv20_usd", 3).alias("adv20_usd"), "resolution_date")


@query("g04_semi_anti_join", sql("""SELECT active, count(*) n FROM (
    SELECT u.* FROM univ u SEMI JOIN weekly w ON u.ticker = w.ticker UNION ALL
    SELECT u.ticker, NULL FROM univ u ANTI JOIN weekly w ON u.ticker = w.ticker) GROUP BY active"""))
def g04(spark, d) -> DataFrame:
    u, w = T.universe_seed(spark, d), A.weekly_anchors(C.bars(spark, d)).select("ticker").distinct()
    both = u.join(w, "ticker", "left_semi").unionByName(
        u.join(w, "ticker", "left_anti").withColumn("active", F.lit(None).cast("boolean")))
    return both.groupBy("active").agg(F.count("*").alias("n"))


@query("g05_next_bar_join", sql("""SELECT a.ticker, a.anchor_date, b.date next_date, b.close next_close
    FROM (SELECT ticker, anchor_date, anchor_date + 56 due FROM outcomes) a ASOF LEFT JOIN bars b ON a.ticker = b.ticker AND a.due <= b.date"""))
def g05(spark, d) -> DataFrame:
    bars = C.bars(spark, d)
    req = A.anchor_frame(bars).select("ticker", "anchor_date", F.date_add("anchor_date", 56).alias("due"))
    return J.next_bar_join(req, bars, "due").drop("due")


@query("g06_interval_join", sql("""SELECT held AS "day", count(*) n FROM (SELECT ticker, CAST(unnest(generate_series(anchor_date, resolution_date_20d, INTERVAL 1 DAY)) AS DATE) held
    FROM outcomes) WHERE held IN (SELECT date FROM bars) GROUP BY held"""))
def g06(spark, d) -> DataFrame:
    bars = C.bars(spark, d)
    days = J.dates_inside(C.labels(spark, d).select("ticker", "anchor_date", "resolution_date_20d"),
                          "anchor_date", "resolution_date_20d", bars)
    return days.groupBy("day").agg(F.count("*").alias("n"))


@query("g07_seeds_by_anchors", sql("""SELECT seed, count(*) n, count(DISTINCT ticker) tickers FROM (
    SELECT ticker, unnest(range(1000, 1020)) seed FROM outcomes) GROUP BY seed"""))
def g07(spark, d) -> DataFrame:
    a = J.per_seed(A.anchor_frame(C.bars(spark, d)), 20, 1000)
    return a.groupBy(F.col("seed").cast("bigint").alias("seed")).agg(
        F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"))
