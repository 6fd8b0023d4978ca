"""Query catalog: name -> Spark plan builder, plus its independent DuckDB oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

MODULES = ["extract", "purge", "filters", "joins", "aggregates", "windows", "snapshots",
           "backups", "sessions", "deadlocks", "rules", "grants", "scalars", "streams", "planxml"]


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with optional oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    for m in MODULES:
        try:
            importlib.import_module(f"opslake.plans.q_{m}")
        except ModuleNotFoundError as e:
            if e.name != f"opslake.plans.q_{m}":
                raise
