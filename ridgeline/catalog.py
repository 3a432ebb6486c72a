"""The registry of queries: a name, its Spark form and, where SQL can express it, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def r6(c: str | Column, name: str | None = None) -> Column:
    """A double to six places, for comparison between engines; never minus zero."""
    column = F.col(c) if isinstance(c, str) else c
    return (F.round(column.cast("double"), 6) + F.lit(0.0)).alias(name or (c if isinstance(c, str) else "value"))
