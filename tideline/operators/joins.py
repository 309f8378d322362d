"""Alignment joins: next available bar and dates inside an interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_bar_join(requests: DataFrame, bars: DataFrame, when: str) -> DataFrame:
    """The first bar of the ticker at or after ``when``; null columns where there is none.

    Bars and requests are laid out on one time line per ticker and read backwards with a running
    window, so no pair of them is ever formed and one shuffle on ticker does.
    """
    cols = requests.columns
    line = requests.select(
        F.col("ticker"), F.col(when).alias("_at"), F.lit(1).alias("_kind"),
        F.lit(None).cast("date").alias("_d"), F.lit(None).cast("double").alias("_c"),
        F.struct(*cols).alias("_req"),
    ).unionByName(bars.select(
        F.col("ticker"), F.col("date").alias("_at"), F.lit(0).alias("_kind"),
        F.col("date").alias("_d"), F.col("close").alias("_c"),
    ), allowMissingColumns=True)
    back = Window.partitionBy("ticker").orderBy(F.col("_at").desc(), "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = line.withColumns({
        "next_date": F.last("_d", ignorenulls=True).over(back),
        "next_close": F.last("_c", ignorenulls=True).over(back),
    })
    return found.filter("_kind = 1").select("_req.*", "next_date", "next_close")


def dates_inside(trades: DataFrame, start: str, end: str, calendar: DataFrame | None = None) -> DataFrame:
    """One row per trade and day of [start, end]; only days of ``calendar`` where one is given."""
    out = trades.withColumn("day", F.explode(F.sequence(F.col(start), F.col(end))))
    if calendar is None:
        return out
    # One row per calendar day by the distinct: small whatever the panel.
    days = F.broadcast(calendar.select(F.col("date").alias("day")).distinct())
    return out.join(days, "day", "left_semi")


def per_seed(df: DataFrame, n: int, base: int = 0, name: str = "seed") -> DataFrame:
    """Every row once per seed, generated in place: no join and no shuffle."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(base), F.lit(base + n - 1))))
