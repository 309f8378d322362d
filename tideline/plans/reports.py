"""Report queries over the tables of a study."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.config import StudyConfig
from tideline.operators.anchors import eligible_bars
from tideline.operators.ledger import tradable_filter


def selection_funnel(bars: DataFrame, labels: DataFrame, picks: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """Rows left after each step from bars to picks."""
    count = lambda df, order, name: df.agg(F.count("*").alias("n")).select(
        F.lit(order).alias("step"), F.lit(name).alias("stage"), "n")
    # Anchors, prefilter and liquidity are counted in one pass.
    adv_ok = (F.col("prefilter_ma250_15") == 1) & (F.col("adv20_usd") >= 5e6)
    lab = labels.agg(F.count("*").alias("anchors"), F.count_if(F.col("prefilter_ma250_15") == 1).alias("prefilter"),
                     F.count_if(adv_ok).alias("liquid"))
    lab = lab.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(c).alias("stage"), F.col(c).alias("n"))
        for i, c in ((3, "anchors"), (4, "prefilter"), (5, "liquid"))])))
    out = count(bars, 1, "bars").unionByName(count(eligible_bars(bars, cfg), 2, "eligible")).unionByName(lab)
    return out.unionByName(count(picks, 6, "picked"))


def cohort_outcome(picks: DataFrame, outcome: str) -> DataFrame:
    """Mean outcome of each week's picks, with and without each of them. A cohort has at most k rows."""
    w = Window.partitionBy("track", "anchor_date")
    n, total = F.count("*").over(w), F.sum(outcome).over(w)
    return picks.select(
        "track", "anchor_date", "ticker", F.avg(outcome).over(w).alias("cohort_mean"),
        F.when(n > 1, (total - F.col(outcome)) / (n - 1)).alias("mean_without"))


def filtered_out(picks: DataFrame, outcome: str) -> DataFrame:
    """Outcomes of the picks that the liquidity gate keeps and of those it drops."""
    ok = tradable_filter(picks, None).select("track", "ticker", "anchor_date", F.lit(1).alias("kept"))
    j = picks.join(ok, ["track", "ticker", "anchor_date"], "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return j.groupBy("track", "kept").agg(
        F.count("*").alias("n"), F.avg(outcome).alias("mean_outcome"), F.min(outcome).alias("worst_outcome"))


def ranked_curves(equity: DataFrame) -> DataFrame:
    """Month-end equity of each track with its final place; a row per track and day goes in."""
    final = equity.groupBy("track").agg(F.max_by("equity", "date").alias("final_equity"))
    final = final.withColumn("place", F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy(F.round("final_equity", 2).desc(), "track")))
    month = equity.groupBy("track", F.trunc("date", "month").alias("month")).agg(
        F.max_by("equity", "date").alias("equity"))
    return month.join(F.broadcast(final), "track")  # one row per track


def base_rates(labels: DataFrame, horizon: int, thresholds: tuple[int, ...]) -> DataFrame:
    """Share of positive labels per anchor year."""
    return labels.groupBy(F.year("anchor_date").alias("year")).agg(
        F.count("*").alias("n"), *[F.avg(F.col(f"ret_{horizon}d_ge_{t}pct").cast("double")).alias(f"rate_{t}pct")
                                   for t in thresholds])


def run_summary(labels: DataFrame, summary: DataFrame, null: DataFrame, tag: str) -> DataFrame:
    """One line per run: sizes, best track (equal to the cent: the first by name) and the null's median."""
    head = labels.agg(F.count_distinct("ticker").alias("n_tickers"), F.count("*").alias("n_anchors"))
    best = summary.agg(F.min_by(F.struct("track", "end_equity", "cagr"), F.struct(-F.round("end_equity", 2), "track")).alias("b"))
    best = best.select(F.col("b.track").alias("best_track"), F.col("b.end_equity").alias("best_equity"), F.col("b.cagr").alias("best_cagr"))
    key = lambda df: df.withColumn("tag", F.lit(tag))
    nul = null.select(F.col("median_cagr").alias("random_median_cagr"), F.col("p95_end_equity").alias("random_p95_eq"))
    return key(head).join(key(best), "tag").join(key(nul), "tag")
