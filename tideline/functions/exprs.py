"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

TICKER_ORDER = ("ticker", "date")


def by_ticker(*extra: str):
    """The one window ordering every bar operator shares."""
    return Window.partitionBy("ticker", *extra).orderBy("date")


def frame(lo: int, hi: int):
    return by_ticker().rowsBetween(lo, hi)


def dbl(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def rnd(x: Column | str, n: int = 6) -> Column:
    return F.round(dbl(x), n)


def finite(x: Column | str) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def zero_if_bad(x: Column | str) -> Column:
    return F.coalesce(finite(x), F.lit(0.0))


def flag(cond: Column) -> Column:
    """1/0 with null counted as 0."""
    return F.when(cond, 1).otherwise(0)


def uniform(purpose: str, *parts: Column | str | int) -> Column:
    """A reproducible uniform in [0, 1): 48 bits of md5 over purpose|parts.

    Depends on the key only, never on partitioning, so reruns and retries agree.
    """
    return uniforms(purpose, *parts)[0]


def uniforms(purpose: str, *parts: Column | str | int) -> tuple[Column, Column]:
    """Two independent uniforms from one md5."""
    cols = [F.lit(purpose)]
    for p in parts:
        c = F.lit(p) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p)
        cols.append(c.cast("string"))
    h = F.md5(F.concat_ws("|", *cols))
    scale = F.lit(float(2**48))
    return tuple(
        F.conv(F.substring(h, start, 12), 16, 10).cast("double") / scale for start in (1, 13)
    )


def bind(value: Column, fn) -> Column:
    """fn(value) with value computed once, even where fn uses it inside another lambda."""
    return F.transform(F.array(value), fn)[0]
