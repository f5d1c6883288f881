"""Registry of named queries ``(spark, sf_dir) -> DataFrame`` and their
DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    # importing the modules fills the registry
    import importlib
    for mod in _MODULES:
        importlib.import_module(f"{__package__}.{mod}")


_MODULES = ["cleaning", "profile", "sampling", "annotation", "evaluation", "features", "analytics", "models", "io"]
