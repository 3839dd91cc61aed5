"""Queries of the library's own operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "x4_task_pool"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with SQL that gives the same rows in DuckDB if there is such SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
