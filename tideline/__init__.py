"""Cross-sectional panel research on Spark: anchors, outcomes, features, ledgers, statistics."""

from tideline.config import LedgerConfig, StudyConfig

__all__ = ["LedgerConfig", "StudyConfig"]
