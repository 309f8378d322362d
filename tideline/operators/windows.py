"""Windows around anchors, in Arrow batches of tickers.

A row holds one ticker: its bars as a list of structs in date order, as long as the calendar, and the bars to look at.
Spark groups and joins these rows; a task lays the bars of some tickers one after the other and cuts a matrix, one row per
anchor, one column per offset, out of each column of bars. Only anchors pay for their windows. Rows do not depend on
each other, so it does not matter how they are dealt. Null bars take no part in a statistic; a statistic of none is NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column

#: Anchors whose matrices are made at once.
ANCHORS = 2000


def unnested(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """How long each list of structs is, and the fields of all of them, one list after the other."""
    flat = lists.flatten()
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0)), dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))


class Bars:
    """A column of bars, one ticker after the other: values (NaN where null) and which of them are not null."""

    def __init__(self, values: pa.Array):
        self.there = np.asarray(values.is_valid())
        self.values = np.asarray(values.cast(pa.float64()).fill_null(float("nan")))

    def window(self, at: np.ndarray, lo: int, hi: int, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Values and presence at the offsets lo..hi of the bars numbered at; inside: offsets that belong to the ticker."""
        spots = np.clip(at[:, None] + np.arange(lo, hi + 1), 0, len(self.values) - 1)
        there = self.there[spots]
        return self.values[spots], there if inside is None else there & inside


class LookBack(NamedTuple):
    """What else is found at an anchor while its ticker's bars are laid out: further columns of the bars, the names of the
    statistics, and the function that finds them from the columns (by name) at the bars numbered."""

    series: dict[str, Column]
    statistics: list[str]
    find: Callable[[dict[str, Bars], np.ndarray], dict[str, np.ndarray]]


def mean(x: np.ndarray, there: np.ndarray) -> np.ndarray:
    return np.where(there, x, 0.0).sum(axis=1) / there.sum(axis=1)


def around(x: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Distances from the row's mean, zero where there is no value."""
    return np.where(there, x - mean(x, there)[:, None], 0.0)


def deviation(x: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Standard deviation of the population."""
    return np.sqrt((around(x, there) ** 2).sum(axis=1) / there.sum(axis=1))


def slices(batch: pa.RecordBatch, marked: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ANCHORS of its rows' anchors; one ticker is never divided."""
    part = np.cumsum(marked(batch)) // ANCHORS
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def anchor_rows(part: pa.RecordBatch, found: dict[str, pa.Array], owner: np.ndarray) -> pa.RecordBatch:
    """One row per anchor with the ticker it belongs to."""
    return pa.RecordBatch.from_pydict({"ticker": part.column("ticker").take(pa.array(owner)), **found})
