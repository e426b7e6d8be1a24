"""Composed plans and the named queries over the driver tables."""

from __future__ import annotations

from importlib import import_module

QUERY_MODULES = [
    "flow_queries",
    "rule_queries",
    "prep_queries",
    "eval_queries",
    "event_queries",
    "stream_queries",
    "file_queries",
]


def load_queries() -> tuple[dict, dict]:
    """(name -> callable, name -> oracle SQL) of every query module."""
    for module in QUERY_MODULES:
        import_module(f"packetloom.plans.{module}")
    from packetloom.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
