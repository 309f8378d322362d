"""Panels derived from the given tables; every one reads its tables whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker_of(key: str | Column) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit("S"), F.lpad(k.cast("string"), 9, "0"))


def session_day(ts: str) -> Column:
    """Calendar day of a row; Saturday and Sunday count towards the Friday before."""
    d = F.col(ts).cast("date")
    return F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)))


def _walk(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Prices from exact integer sums, so that any engine gets the same bits."""
    w = Window.partitionBy(*keys).orderBy("date") if keys else Window.orderBy("date")
    step = (F.col("sdc") - 5 * F.col("n")) / (F.lit(100.0) * F.sqrt(F.col("n")))
    out = daily.withColumn("close", F.round(100.0 * F.exp(F.sum(step).over(w)), 4))
    out = out.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
    return out.select(
        *keys, "date", "open",
        F.greatest("open", "close").alias("high"),
        F.least("open", "close").alias("low"),
        "close",
        (F.col("q") * 1000.0).alias("volume"),
    )


def _daily(spark: SparkSession, sf_dir: str, keys: dict[str, Column], day: Column) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (
        li.select(
            *[c.alias(k) for k, c in keys.items()],
            day.alias("date"),
            F.round(F.col("l_discount") * 100).cast("bigint").alias("dc"),
            F.col("l_quantity").alias("q"),
        )
        .groupBy(*keys, "date")
        .agg(F.count("*").alias("n"), F.sum("dc").alias("sdc"), F.sum("q").alias("q"))
    )


def panel_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per supplier: the number of series grows with the data, their length does not.

    The aggregate runs map-side first, so a supplier with a third of all line items still
    leaves at most one row per task and day; a series is as long as the calendar at most.
    """
    keys = {"ticker": ticker_of("l_suppkey")}
    return _walk(_daily(spark, sf_dir, keys, session_day("l_shipdate")), ["ticker"])


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index over all suppliers: one row per calendar day."""
    return _walk(_daily(spark, sf_dir, {}, session_day("l_shipdate")), [])


def weekly_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same index quoted on Fridays only, to exercise filling."""
    friday = F.date_add(F.date_trunc("week", F.col("l_shipdate")).cast("date"), 4)
    return _walk(_daily(spark, sf_dir, {}, friday), [])


def raw_bars(spark: SparkSession, sf_dir: str, panel: DataFrame | None = None) -> DataFrame:
    """Bars before cleaning: upper-case names, re-emitted corrections and null rows. panel: panel_bars, where the caller has them."""
    names = ("open", "high", "low", "close", "volume")

    def row(seq: Column, **changed: Column) -> Column:
        return F.struct(*[changed.get(c, F.col(c)).alias(c.title()) for c in names], seq.alias("seq"))

    # All three rows come from the bar where it lies: the panel is made once, and its rows stay with their ticker.
    fixed = row(F.when(F.dayofmonth("date") == 13, 1).otherwise(-1), close=F.round(F.col("close") * 1.01, 4))
    blank = row(F.lit(2), **{c: F.lit(None).cast("double") for c in names})
    panel = panel_bars(spark, sf_dir) if panel is None else panel
    return panel.select("ticker", "date", F.inline(F.array(row(F.lit(0)), fixed, blank)))


def tail_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose last 12 rows have no volume for suppliers with a negative balance."""
    b = panel_bars(spark, sf_dir)
    u = universe_seed(spark, sf_dir).filter(~F.col("active")).select("ticker", F.lit(1).alias("dead"))
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))
    return (
        b.join(u, "ticker", "left")
        .withColumn("back", back)
        .withColumn("volume", F.when((F.col("dead") == 1) & (F.col("back") <= 12), 0.0)
                    .otherwise(F.col("volume")))
        .drop("dead", "back")
    )


def universe_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(ticker_of("s_suppkey").alias("ticker"), (F.col("s_acctbal") >= 0).alias("active"))


def symbol_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol rows with test issues, funds and special characters, from customer."""
    c = table(spark, sf_dir, "customer")
    mark = F.when(F.col("c_nationkey") == 1, ".").when(F.col("c_nationkey") == 2, "$") \
        .when(F.col("c_nationkey") == 3, "^").otherwise("")
    return c.select(
        F.concat(F.upper(F.substring("c_mktsegment", 1, 2)), mark, F.col("c_custkey").cast("string")).alias("Symbol"),
        F.when(F.col("c_nationkey") == 4, "Y").otherwise("N").alias("Test Issue"),
        F.when(F.col("c_nationkey") == 5, "y").when(F.col("c_nationkey") == 6, "Y").otherwise("N").alias("ETF"),
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested filing records from orders and customer; low balances carry no symbol group."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders")
    j = o.join(c, o.o_custkey == c.c_custkey)
    cik = F.col("c_custkey").cast("string")
    # Short enough for the symbol pattern whatever the number of customers.
    sym = F.concat(F.substring("c_mktsegment", 1, 2), (F.col("c_custkey") % 100000).cast("string"))
    tail = F.concat(F.lit("  (CIK "), F.lpad(cik, 10, "0"), F.lit(")"))
    name = F.when(F.col("c_acctbal") < 0, F.concat("c_name", tail)).otherwise(
        F.concat(F.col("c_name"), F.lit("  ("), sym, F.lit(", "), sym, F.lit("-WT)"), tail)
    )
    return j.select(
        F.concat(F.lit("A-"), F.col("o_orderkey").cast("string"), F.lit(":doc.xml")).alias("_id"),
        F.struct(
            F.array(cik).alias("ciks"),
            F.array(name).alias("display_names"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("file_date"),
            F.when(F.col("o_orderstatus") == "F", "25").otherwise("25-NSE").alias("form"),
        ).alias("_source"),
    )


def cik_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIK to ticker for the customers of even nations."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik10"),
        F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("M"), F.col("c_custkey").cast("string")))
        .alias("master_ticker"),
    ).filter(F.col("master_ticker").isNotNull())


def trial_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts",
        F.col("event_type").alias("model"),
        F.concat(F.lit("ret_"), (F.col("user_id") % 6).cast("string")).alias("label"),
        (F.col("user_id") % 6).alias("horizon_d"),
        F.when(F.col("user_id") % 5 != 4, F.col("user_id") % 5).alias("threshold_q"),
        F.lit("all").alias("universe"),
        F.col("value").alias("headline_sharpe"),
    )
