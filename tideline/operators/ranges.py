"""Ranges of bars from doubling tables: extremes, sums and drawdowns of any length at any bar.

A ticker's column is an array in date order (as long as the calendar). Level j of a table holds the value over the 2^j
entries from each one on, made from two entries of level j - 1. The extreme of any range is that of two overlapping entries
of one level; what may not be counted twice (sums, drawdowns) is put together from one entry per binary digit of the
length. A table costs n log n, a further length a few look-ups where it is asked for, and no window is as wide as a horizon.

Ranges that begin before the first bar are null. Those that end after the last are ranges of the bars that exist.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Combine = Callable[[Column, Column], Column]


def plus(a: Column, b: Column) -> Column:
    """The sum of both, null counted as nothing."""
    return F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))


def deeper(a: Column, b: Column) -> Column:
    """Of an earlier and a later range (hi, lo, dd): high, low and deepest fall from a close to a later one."""
    return F.struct(
        F.greatest(a["hi"], b["hi"]).alias("hi"), F.least(a["lo"], b["lo"]).alias("lo"),
        F.least(a["dd"], b["dd"], F.try_divide(b["lo"], a["hi"]) - 1.0).alias("dd"))


def falling(closes: Column) -> Column:
    """Closes as ranges of one bar for `deeper`."""
    return F.transform(closes, lambda c: F.struct(c.alias("hi"), c.alias("lo"), F.lit(0.0).alias("dd")))


def deepest(parts: list[Column]) -> Column:
    """The deepest fall over consecutive ranges of `deeper`."""
    hi, dd = parts[0]["hi"], parts[0]["dd"]
    for p in parts[1:]:
        dd = F.least(dd, p["dd"], F.try_divide(p["lo"], hi) - 1.0)
        hi = F.greatest(hi, p["hi"])
    return dd


@dataclass(frozen=True)
class Table:
    """A doubling table over the array `values` for ranges of up to `longest` bars."""

    name: str
    values: Column
    combine: Combine
    longest: int

    @property
    def levels(self) -> int:
        return self.longest.bit_length() - 1

    def column(self, level: int) -> Column:
        return F.col(f"_table_{self.name}_{level}")

    def extreme(self, first: Column, length: int) -> Column:
        """Over `length` bars from number `first` on, by two entries that may overlap."""
        level = length.bit_length() - 1
        rest = length - (1 << level)
        one = F.get(self.column(level), first)
        if not rest:
            return one
        return F.when(first >= 0, self.combine(one, F.get(self.column(level), first + rest)))

    def parts(self, first: Column, length: int) -> list[Column]:
        """`length` bars from number `first` on in disjoint entries, one per binary digit, in order of time."""
        out, away = [], 0
        for level in reversed(range(length.bit_length())):
            if length >> level & 1:
                out.append(F.when(first >= 0, F.get(self.column(level), first + away)))
                away += 1 << level
        return out

    def total(self, first: Column, length: int) -> Column:
        """Over `length` bars from number `first` on. combine must use each side once, or the expression doubles with every part."""
        out, *more = self.parts(first, length)
        for p in more:
            out = self.combine(out, p)
        return F.when(first >= 0, out)


def with_tables(paths: DataFrame, tables: list[Table]) -> DataFrame:
    """One row per ticker with all levels of the tables, level by level for all of them at once."""
    out = paths.withColumns({f"_table_{t.name}_0": t.values for t in tables})
    for level in range(1, max(t.levels for t in tables) + 1):
        half = 1 << (level - 1)

        def doubled(t: Table, below: Column, half: int = half) -> Column:
            later = F.slice(below, half + 1, F.greatest(F.size(below) - half, F.lit(0)))
            return F.zip_with(below, later, lambda a, b: F.when(b.isNull(), a).otherwise(t.combine(a, b)))

        out = out.withColumns({f"_table_{t.name}_{level}": doubled(t, t.column(level - 1)) for t in tables if t.levels >= level})
    return out
