"""Named queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import tables_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, uses: str = "", name: str | None = None):
    """Register a query; ``uses`` names the shared CTEs its SQL is written against."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__

        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = tables_sql.with_tables(sql, uses)
        return fn

    return register
