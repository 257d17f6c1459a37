"""Registration of queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its rows are checked."""

    def register(run):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = run
        if sql:
            CHECKS[name] = sql
        return run

    return register


def r6(x: str | Column) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def rounded(df: DataFrame, *keep: str, **columns) -> DataFrame:
    """``keep`` as they are, keyword columns rounded to six digits under their name."""
    return df.select(*keep, *[r6(c).alias(name) for name, c in columns.items()])


def sql6(expression: str, name: str) -> str:
    """The same rounding in SQL; adding zero turns a negative zero into a plain one."""
    return f"ROUND({expression}, 6) + 0.0 AS {name}"
