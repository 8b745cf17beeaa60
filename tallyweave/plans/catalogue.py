"""All queries of the library proper, by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES: tuple[str, ...] = ("reconciliation", "layout", "claims", "workflow", "streams", "extras", "gateway", "orders", "extraction", "matching", "answers", "legacy")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and oracle texts of every plan module."""
    from importlib import import_module

    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}
    for name in MODULES:
        module = import_module(f"tallyweave.plans.{name}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
