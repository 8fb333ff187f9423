"""Named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that gives the same rows if there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice.")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(value: Column, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def q6(expression: str, digits: int = 6) -> str:
    """SQL twin of :func:`r6`."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0"


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """Round every double column except ``keep``."""
    return df.select(*[
        r6(F.col(f"`{n}`"), digits).alias(n) if t == "double" and n not in keep else F.col(f"`{n}`")
        for n, t in df.dtypes
    ])
