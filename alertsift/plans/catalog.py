"""Registry of queries and of the SQL text that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# Added before rounding in both engines: keeps values off exact ties, which they break differently.
_OFF_TIE = "3e-7"


def rounded(name: str, digits: int = 4) -> Column:
    return near(F.col(f"`{name}`"), digits).alias(name)


def near(col: Column, digits: int = 4) -> Column:
    return F.round(col + F.lit(float(_OFF_TIE)), digits)


def r(expr: str, digits: int = 4) -> str:
    """SQL twin of ``near``."""
    return f"round(CAST({expr} AS DOUBLE) + {_OFF_TIE}, {digits})"


def as_long(*names: str) -> list[Column]:
    return [F.col(f"`{n}`").cast("long").alias(n) for n in names]
