"""Name to (Spark query, oracle SQL) for every operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .views import Views, oracle

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its oracle over the views it names."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = oracle(sql.strip())
        return fn

    return add
