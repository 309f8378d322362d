"""Small bar series for the tests."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

BAR_SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"


def walk(ticker: str, n: int, seed: int, start: str = "2018-01-02") -> pd.DataFrame:
    g = np.random.default_rng(seed)
    close = 50 * np.exp(np.cumsum(g.normal(0.001, 0.02, n)))
    return pd.DataFrame({
        "ticker": ticker, "date": pd.bdate_range(start, periods=n).date, "open": close, "high": close, "low": close,
        "close": close, "volume": np.round(g.lognormal(14, 0.4, n))})


def to_bars(spark, *frames: pd.DataFrame):
    return spark.createDataFrame(pd.concat(frames, ignore_index=True), BAR_SCHEMA)


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)
