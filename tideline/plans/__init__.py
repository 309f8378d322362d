"""Composed studies and the registered queries with their SQL counterparts."""

from __future__ import annotations


def registered():
    """(queries, oracle SQL) of all modules."""
    from tideline.plans import queries_panel, queries_study  # noqa: F401
    from tideline.plans.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
