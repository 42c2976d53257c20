"""Queries over the given tables, each next to the SQL that must agree with it."""

from importlib import import_module

from catalog.registry import REGISTRY

MODULES = (
    "scans", "scalars", "joins", "aggregates", "window_ops", "cycling", "transitions",
    "observing", "zones", "learning", "policies", "streams",
)


def load() -> dict:
    for module in MODULES:
        import_module(f"catalog.{module}")
    return REGISTRY
