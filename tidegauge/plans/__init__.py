"""Registered queries, one module per family."""

from __future__ import annotations

import importlib

FAMILIES = ["text", "capsules", "metrics", "traces", "quality", "vectors", "governance", "ingest", "tables", "streams", "analysis"]


def load():
    for family in FAMILIES:
        importlib.import_module(f"tidegauge.plans.{family}")
    from tidegauge.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
