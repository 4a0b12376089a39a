"""Named queries, each a composition of operators over the driver's tables."""

from __future__ import annotations

from importlib import import_module

from tallywick.plans.registry import ORACLES, QUERIES

FAMILIES: tuple[str, ...] = ("spend", "merging", "policies", "intervals", "chains", "caches", "privacy", "sequences", "evaluations", "gateway", "wires")


def load() -> tuple[dict, dict]:
    """Import every family once; return the queries and their SQL by name."""
    for name in FAMILIES:
        import_module(f"tallywick.plans.{name}")
    return QUERIES, ORACLES
