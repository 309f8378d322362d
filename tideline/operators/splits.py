"""Leakage-safe yearly folds as one long table; a row may serve many folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embargo_days(horizon: int, multiplier: int = 1) -> int:
    """Calendar days kept free before a test year."""
    return int(horizon * multiplier * 1.6)


def fold_years(years: list[int], lockbox_year: int | None = None, unlock: bool = False) -> list[int]:
    """The years to test on; the locked year only after unlocking, and then last."""
    out = [y for y in years if y != lockbox_year]
    if unlock and lockbox_year is not None:
        out.append(lockbox_year)
    return out


def yearly_folds(anchors: DataFrame, years: list[int], horizon: int, multiplier: int = 1,
                 purge: bool = True) -> DataFrame:
    """Rows with fold_year and role (test, train, or purged when ``purge`` is off).

    Each row is repeated for the folds it belongs to, in place and without a join.
    """
    res = F.col(f"resolution_date_{horizon}d")
    start = F.make_date(F.col("fold_year"), F.lit(1), F.lit(1))
    role = (
        F.when(F.year("anchor_date") == F.col("fold_year"), "test")
        .when((F.col("anchor_date") < start) & (res < F.date_sub(start, embargo_days(horizon, multiplier))), "train")
        .when(F.col("anchor_date") < start, "purged")
    )
    # No resolution date means no proof of overlap, so such a row stays in the pool.
    role = F.when((F.col("anchor_date") < start) & res.isNull(), "train").otherwise(role)
    out = anchors.withColumn("fold_year", F.explode(F.array(*[F.lit(y) for y in years])))
    out = out.withColumn("role", role).filter(F.col("role").isNotNull())
    return out.filter(F.col("role") != "purged") if purge else out


def fold_sizes(folds: DataFrame, label: str | None = None) -> DataFrame:
    is_train, is_test = F.col("role") == "train", F.col("role") == "test"
    aggs = [F.count_if(is_train).alias("n_train"), F.count_if(is_test).alias("n_test"),
            F.count_if(F.col("role") == "purged").alias("n_purged")]
    if label:
        aggs += [F.count_if(is_train & (F.col(label) == 1)).alias("n_pos"),
                 F.count_if(is_train & (F.col(label) == 0)).alias("n_neg")]
    return folds.groupBy("fold_year").agg(*aggs)


def _keep_folds(folds: DataFrame, good: DataFrame) -> DataFrame:
    # One row per test year: a handful.
    return folds.join(F.broadcast(good.select("fold_year")), "fold_year", "left_semi")


def drop_empty_folds(folds: DataFrame) -> DataFrame:
    return _keep_folds(folds, fold_sizes(folds).filter("n_train > 0 AND n_test > 0"))


def fold_guards(folds: DataFrame, label: str, min_train: int = 1000, min_class: int = 10) -> DataFrame:
    """Only folds with enough training rows of both classes."""
    ok = fold_sizes(folds, label).filter(
        (F.col("n_train") >= min_train) & (F.col("n_pos") >= min_class) & (F.col("n_neg") >= min_class))
    return _keep_folds(folds, ok)


def leakage_violations(folds: DataFrame, horizon: int, multiplier: int = 1) -> DataFrame:
    """Per fold, training rows that reach into the test period; all zero for a sound split."""
    first = folds.groupBy("fold_year").agg(
        F.min(F.when(F.col("role") == "test", F.col("anchor_date"))).alias("first_test"))
    j = folds.filter("role = 'train'").join(F.broadcast(first), "fold_year")
    edge = F.date_sub("first_test", embargo_days(horizon, multiplier))
    return j.groupBy("fold_year").agg(
        F.count_if(F.col("anchor_date") >= F.col("first_test")).alias("future_rows"),
        F.count_if(F.col(f"resolution_date_{horizon}d") >= edge).alias("overlap_rows"),
        F.count("*").alias("train_rows"))


def resolved_before(rows: DataFrame, today: str | Column, horizon: int) -> DataFrame:
    """Training rows whose outcome was known by ``today``."""
    day = F.to_date(F.lit(today)) if isinstance(today, str) else today
    return rows.filter(F.col(f"resolution_date_{horizon}d") < day)
