"""The queries of the core engine, each with the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "r3_similar_grades"
MODULES = ("sessions", "lookup", "analytics", "search", "pixels", "luts", "media")

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under `name`; `sql` is its equivalent for the oracle."""

    def add(f: Query) -> Query:
        if name in _QUERIES and _QUERIES[name].__module__ != f.__module__:
            raise ValueError(f"query {name} exists")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for m in MODULES:
        importlib.import_module(f"gradeloom.plans.{m}")
    return dict(_QUERIES), dict(_SQL)
