"""Whole jobs, and the operators bound to the test tables."""

from __future__ import annotations

import importlib

MODULES = ("detection_queries", "exposure_queries", "inventory_queries", "access_queries", "audit_queries", "command_queries", "file_queries", "stream_queries")


def all_queries() -> tuple[dict, dict]:
    """Every registered query and the oracle SQL of those that have one."""
    from exposure.plans.registry import ORACLES, QUERIES

    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return QUERIES, ORACLES
