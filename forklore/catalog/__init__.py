"""The registered queries: library operators over views of the given tables."""

from __future__ import annotations

import importlib

MODULES = [
    "metrics", "filters", "joins", "aggregates", "windows", "sets", "functions", "graphs",
    "sources", "streams",
]


def load() -> tuple[dict, dict]:
    """Import all query modules; returns the queries and their checking SQL."""
    for name in MODULES:
        importlib.import_module(f"forklore.catalog.{name}")
    registry = importlib.import_module("forklore.catalog.registry")
    return registry.QUERIES, registry.ORACLES
