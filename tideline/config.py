"""All parameters of a study, in two frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass

# Default study grid, portfolio rules and seeds.
HORIZONS = (5, 10, 15, 20, 30, 40)
THRESHOLDS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30)
BARRIER_PAIRS = ((0.05, 0.02), (0.05, 0.05), (0.10, 0.05), (0.15, 0.10))


@dataclass(frozen=True)
class StudyConfig:
    """Anchor, label and split parameters."""

    horizons: tuple[int, ...] = HORIZONS
    thresholds: tuple[float, ...] = THRESHOLDS
    warmup: int = 252
    lookback: int = 252
    ma_window: int = 250
    ma_extension: float = 1.5
    adv_window: int = 20
    min_week_bars: int = 3
    embargo_multiplier: int = 1
    min_train: int = 1000
    min_class: int = 10
    pca_dim: int = 64

    @property
    def max_horizon(self) -> int:
        return max(self.horizons)


@dataclass(frozen=True)
class LedgerConfig:
    """Trade costing parameters."""

    start_equity: float = 100_000.0
    max_position_pct: float = 0.04
    max_new_per_week: int = 5
    max_adv_pct: float = 0.005
    min_adv_usd: float = 5_000_000.0
    min_position_usd: float = 100.0
    slippage_bps: float = 10.0
    commission_per_share: float = 0.005
    commission_cap: float = 0.005
    trailing_stop_pct: float = 0.0
    use_impact: bool = False
    impact_eta: float = 0.142
    impact_beta: float = 0.5
    permanent_frac: float = 0.5
    daily_vol: float = 0.03
    impact_min_bps: float = 1.0
    impact_max_bps: float = 500.0
    halt_risk: bool = False
    halt_seed: int = 42


def pct_tag(t: float) -> str:
    """0.25 -> '25', as used in column names such as ret_40d_ge_25pct."""
    return str(int(round(t * 100)))
