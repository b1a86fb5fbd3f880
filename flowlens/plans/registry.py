"""The list of queries: a Spark callable per name, and its checking SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = [
    "columns", "windows", "splits", "graph", "context", "scaling", "audit", "metrics", "compare", "correct", "models",
    "streams",
]


def query(name: str, check: str | None = None, extra: dict[str, str] | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``check`` is the SQL over the raw tables that must give the same rows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if check is not None:
            from flowlens.plans.oracle import sql

            ORACLES[name] = sql(check, extra)
        return fn

    return register


def load() -> None:
    for m in MODULES:
        import_module(f"flowlens.plans.q_{m}")
