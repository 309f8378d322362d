"""Universe building and data quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.exprs import by_ticker

# Fixed value: a parenthesised group of upper-case symbols.
SYMBOL_GROUP = r"\(([A-Z][A-Z0-9.\-]{0,9}(?:,\s*[A-Z][A-Z0-9.\-]{0,9})*)\)"


def universe_filter(directory: DataFrame, symbol: str = "Symbol") -> DataFrame:
    """Active common symbols: no test issues, funds or symbols with $ . ^."""
    kept = directory.filter(
        (F.col("Test Issue") == "N")
        & ~F.coalesce(F.upper("ETF") == "Y", F.lit(False))
        & F.col(symbol).isNotNull()
        & ~F.col(symbol).rlike(r"[$.^]")
    )
    return kept.select(F.col(symbol).alias("ticker"), F.lit(True).alias("active")).distinct()


def universe_build(active: DataFrame, delisted: DataFrame) -> DataFrame:
    """Union by ticker; a ticker on both lists counts as active."""
    return active.unionByName(delisted).groupBy("ticker").agg(F.bool_or("active").alias("active"))


def extract_tickers(name: Column | str) -> Column:
    """Array of symbols in the parenthesised groups of a display name, CIK groups left out."""
    groups = F.regexp_extract_all(name, F.lit(SYMBOL_GROUP), F.lit(1))
    groups = F.filter(groups, lambda g: ~g.startswith("CIK"))
    symbols = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    symbols = F.transform(symbols, lambda s: F.upper(F.trim(s)))
    return F.filter(symbols, lambda s: (s != "") & ~s.startswith("CIK"))


def cik_fallback_join(filings: DataFrame, master: DataFrame) -> DataFrame:
    """One row per filing and ticker; filings without symbols take the ticker of their CIK."""
    f = filings.withColumn("found", extract_tickers("issuer")).withColumn("cik10", F.lpad("cik", 10, "0"))
    j = f.join(master.select("cik10", "master_ticker"), "cik10", "left")
    tickers = F.when(F.size("found") > 0, F.col("found")).when(
        F.col("master_ticker").isNotNull(), F.array("master_ticker"))
    return j.withColumn("ticker", F.explode(tickers)).select(
        "ticker", "issuer", "cik", "filing_date", "form", "accession")


def suffix_filter(df: DataFrame) -> DataFrame:
    """Leave out warrants, units and rights."""
    return df.filter(~F.col("ticker").rlike("[WUR]$"))


def delisting_classifier(bars: DataFrame, terminal_date: str | Column, min_rows: int = 20) -> DataFrame:
    """Per ticker, the signs of a dead series; tickers without any sign are left out."""
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    back = bars.select("ticker", "date", "close", "volume", F.row_number().over(w).alias("back"))
    recent = F.col("back") <= 20
    per = back.groupBy("ticker").agg(
        F.count("*").alias("n"),
        F.max("date").alias("last_date"),
        F.max(F.when(F.col("back") == 1, F.col("close"))).alias("last_close"),
        F.avg(F.when(recent, F.col("volume"))).alias("avg_vol20"),
        F.max(F.when(recent, F.col("close"))).alias("peak20"),
        (F.coalesce(F.min(F.when(F.col("volume") != 0, F.col("back"))) - 1, F.count("*"))
         .cast("bigint")).alias("zrun"),
    ).filter(F.col("n") >= min_rows)
    dd = F.when(F.col("peak20") > 0, (F.col("peak20") - F.col("last_close")) / F.col("peak20")).otherwise(0.0)
    terminal = F.to_date(F.lit(terminal_date)) if isinstance(terminal_date, str) else terminal_date
    reasons = F.array_compact(F.array(
        F.when(F.col("last_date") < terminal, "early_terminal"),
        F.when(F.col("zrun") >= 10, F.concat(F.lit("zerovol"), F.col("zrun").cast("string"))),
        F.when(F.col("last_close") <= 0.10, "subdime_close")
        .when((F.col("last_close") < 0.50) & (F.col("avg_vol20") < 5000), "penny_distress"),
        F.when(dd >= 0.90, "bagel_drop"),
        F.when(F.col("last_close") == 0.0, "zero_close"),
    ))
    return per.withColumn("r", reasons).filter(F.size("r") > 0).select(
        "ticker", "last_date",
        F.round("last_close", 4).alias("last_close"),
        F.round("avg_vol20", 1).alias("last_20d_avg_volume"),
        F.round(dd, 4).alias("last_20d_max_drawdown"),
        F.col("zrun").alias("trailing_zero_volume_days"),
        F.concat_ws("|", "r").alias("reasons"),
    )


def not_in_active(flagged: DataFrame, universe: DataFrame) -> DataFrame:
    return flagged.join(universe.filter("active").select("ticker"), "ticker", "left_anti")


def reason_counts(flagged: DataFrame, top: int = 10) -> DataFrame:
    return (flagged.groupBy("reasons").agg(F.count("*").alias("n"))
            .orderBy(F.col("n").desc(), "reasons").limit(top))


def bar_row_text() -> Column:
    """A bar as text in exact integers (price in 1/10000, volume in units)."""
    scaled = [F.round(F.col(c) * 10000).cast("bigint").cast("string") for c in ("open", "high", "low", "close")]
    return F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), *scaled, F.col("volume").cast("bigint").cast("string"))


def partition_fingerprint(bars: DataFrame) -> DataFrame:
    """Content hash per ticker. A group holds one row per date, so its size is the calendar's."""
    return bars.groupBy("ticker").agg(
        F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(bar_row_text()))), 256).alias("content_hash"),
        F.count("*").alias("n_rows"),
    )


def combined_fingerprint(prints: DataFrame, digits: int = 4) -> DataFrame:
    """One hash over all tickers through a tree: 16^digits buckets of keys, then the buckets.

    Neither level gathers more than a bounded share in one task.
    """
    bucket = F.substring(F.md5("ticker"), 1, digits)
    leaf = F.concat_ws("=", "ticker", "content_hash")
    level = prints.groupBy(bucket.alias("bucket")).agg(
        F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(leaf))), 256).alias("bucket_hash"),
        F.count("*").alias("keys"))
    root = F.array_sort(F.collect_list(F.concat_ws("=", "bucket", "bucket_hash")))
    return level.agg(F.sum("keys").alias("file_count"), F.sha2(F.concat_ws("\n", root), 256).alias("combined_hash"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Status of every key of two fingerprint tables: ok, changed, missing or added."""
    o = old.select("ticker", F.col("content_hash").alias("old_hash"))
    n = new.select("ticker", F.col("content_hash").alias("new_hash"))
    status = (F.when(F.col("new_hash").isNull(), "missing").when(F.col("old_hash").isNull(), "added")
              .when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("ok"))
    return o.join(n, "ticker", "full_outer").select("ticker", status.alias("status"))


def staleness_check(bars: DataFrame, today: str, max_days: int = 7) -> DataFrame:
    age = F.datediff(F.to_date(F.lit(today)), F.col("newest_bar"))
    return bars.agg(F.max("date").alias("newest_bar")).select(
        "newest_bar", age.alias("stale_days"), F.when(age > max_days, 1).otherwise(0).alias("is_stale"))


def min_history_filter(bars: DataFrame, warmup: int, max_horizon: int) -> DataFrame:
    """Only tickers with enough rows for one eligible anchor."""
    need = warmup + max_horizon + 2
    n = F.count("*").over(Window.partitionBy("ticker"))
    return bars.withColumn("_n", n).filter(F.col("_n") >= need).drop("_n")


def has_bars(universe: DataFrame, bars: DataFrame) -> DataFrame:
    return universe.join(bars.select("ticker").distinct(), "ticker", "left_semi")


def sample_tickers(universe: DataFrame, n: int, seed: int) -> DataFrame:
    """A seeded sample without replacement: the n smallest keyed hashes, a distributed top-n."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("ticker")))
    return universe.select("ticker").distinct().orderBy(key, "ticker").limit(n)


def with_bar_index(bars: DataFrame) -> DataFrame:
    """0-based position of each bar in its ticker."""
    return bars.withColumn("idx", F.row_number().over(by_ticker()) - 1)
