"""Frames shared by the registered queries."""

from __future__ import annotations

from functools import cached_property, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.config import LedgerConfig, StudyConfig
from tideline.functions.exprs import rnd
from tideline.operators.anchors import anchor_frame, build_labels
from tideline.operators.features import compute_features
from tideline.operators.ledger import purchases, sleeve_equity_curve, trade_ledger
from tideline.operators.metrics import compute_summary
from tideline.operators.ranking import OUTCOME, scored_anchors, weekly_topk
from tideline.session import cut, tune
from tideline.sources.tables import market_bars, panel_bars

CFG = StudyConfig()
LEAN = StudyConfig(horizons=(20, 40), thresholds=(0.10, 0.25))
FLAT = LedgerConfig()
REAL = LedgerConfig(trailing_stop_pct=0.18, use_impact=True, halt_risk=True)


class Study:
    """The frames of one query, each built once. Bars are cut: everything else starts from them."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d
        self.purchased: dict[LedgerConfig, DataFrame] = {}
        self.ledgers: dict[LedgerConfig, DataFrame] = {}

    @cached_property
    def bars(self) -> DataFrame:
        return cut(panel_bars(self.spark, self.d))

    @cached_property
    def market(self) -> DataFrame:
        return market_bars(self.spark, self.d)

    @cached_property
    def features(self) -> DataFrame:
        return compute_features(self.bars, anchor_frame(self.bars, CFG), self.market)

    @cached_property
    def labels(self) -> DataFrame:
        return build_labels(self.bars, CFG)

    @cached_property
    def lean(self) -> DataFrame:
        """The same anchors with the outcomes of two horizons only."""
        return build_labels(self.bars, LEAN)

    @cached_property
    def scored(self) -> DataFrame:
        """Scores with the exits and outcomes that the same pass over the bars finds."""
        return scored_anchors(self.bars, LEAN, 40)

    @cached_property
    def scores(self) -> DataFrame:
        return self.scored.drop(*OUTCOME)

    def bought(self, cfg: LedgerConfig) -> DataFrame:
        """Cut: the candidates that each date's purchases can reach, read by every step of the ledger."""
        if cfg not in self.purchased:
            self.purchased[cfg] = cut(purchases(self.scored.drop("fwd_ret"), self.bars, cfg))
        return self.purchased[cfg]

    def ledger(self, cfg: LedgerConfig) -> DataFrame:
        """Trades are few next to the bars they come from, so they are cut as well."""
        if cfg not in self.ledgers:
            self.ledgers[cfg] = cut(trade_ledger(self.bought(cfg), self.bars, cfg))
        return self.ledgers[cfg]


_current: list[Study] = []


def study(spark: SparkSession, d: str) -> Study:
    """The study of the query that is being built."""
    if not _current:
        return Study(spark, d)
    return _current[-1]


def per_query(fn):
    """Give every call of a query its own study, so that nothing is shared between queries."""

    @wraps(fn)
    def run(spark: SparkSession, d: str) -> DataFrame:
        _current.append(Study(tune(spark), d))
        try:
            return fn(spark, d)
        finally:
            _current.pop()

    return run


def bars(spark: SparkSession, d: str) -> DataFrame:
    return study(spark, d).bars


def features(spark: SparkSession, d: str) -> DataFrame:
    return study(spark, d).features


def labels(spark: SparkSession, d: str, prefilter_only: bool = False) -> DataFrame:
    return build_labels(bars(spark, d), CFG, True) if prefilter_only else study(spark, d).labels


def lean(spark: SparkSession, d: str) -> DataFrame:
    return study(spark, d).lean


def scores(spark: SparkSession, d: str) -> DataFrame:
    return study(spark, d).scores


def picks(spark: SparkSession, d: str) -> DataFrame:
    """The best scores of each date, whether they can be bought or not, with their outcomes. Cut, as they are few. Bars are
    read once here, so they go from their walk into the windows in the order they lie, neither written nor dealt again."""
    return cut(weekly_topk(scored_anchors(panel_bars(spark, d), LEAN, 40), 5).drop("exit_date", "exit_close"))


def bought(spark: SparkSession, d: str, cfg: LedgerConfig = FLAT) -> DataFrame:
    return study(spark, d).bought(cfg)


def ledger(spark: SparkSession, d: str, cfg: LedgerConfig = FLAT) -> DataFrame:
    return study(spark, d).ledger(cfg)


def equity(spark: SparkSession, d: str, cfg: LedgerConfig = FLAT) -> DataFrame:
    return sleeve_equity_curve(ledger(spark, d, cfg), bars(spark, d), cfg)


def summary(spark: SparkSession, d: str, cfg: LedgerConfig = FLAT) -> DataFrame:
    led = ledger(spark, d, cfg)
    return compute_summary(sleeve_equity_curve(led, bars(spark, d), cfg), led)


def rounded(df: DataFrame, cols: list[str], n: int = 6) -> DataFrame:
    return df.withColumns({c: rnd(c, n) for c in cols})


def ints(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in cols})
