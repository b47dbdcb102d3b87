"""Named queries with, where SQL can say it, the same query in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero, so both engines print the same text."""
    value = F.round(column, digits) if isinstance(column, Column) else F.round(F.col(column), digits)
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def rsql(expression: str, digits: int = 6) -> str:
    """SQL text of :func:`rounded`."""
    value = f"round(cast({expression} as double), {digits})"
    return f"(case when {value} = 0 then cast(0 as double) else {value} end)"
