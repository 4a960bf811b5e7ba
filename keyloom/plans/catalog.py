"""Named queries of the core and, where SQL can say it, the same query for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All core queries and their SQL."""
    from keyloom.plans import array_queries, data_queries, model_queries, session_queries, source_queries  # noqa: F401

    return QUERIES, ORACLE
