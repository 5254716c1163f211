"""Named queries: a Spark callable (spark, folder) and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rnd(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`rnd`."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE)"


def h(*parts: str) -> str:
    """SQL twin of ``hash52``; parts are SQL expressions."""
    text = ", ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5(concat_ws(':', {text})), 1, 13))::UBIGINT)::BIGINT"


def u(*parts: str) -> str:
    """SQL twin of ``unit_hash``."""
    return f"({h(*parts)}::DOUBLE / 4503599627370496.0::DOUBLE)"
