"""Query registration."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from edgeloom.queries.views import Tables, with_views

MODULES = ["graph", "splits", "literature", "negatives", "scoring", "metrics", "ranking",
           "evidence", "expression", "enrichment", "features", "sources"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Registers ``fn(tables)``; ``sql`` may use the shared views by name."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            _SQL[name] = with_views(sql, recursive)
        return fn

    return register


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"edgeloom.queries.{module}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
