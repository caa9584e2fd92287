"""Collects the registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, FloatType, TimestampNTZType, TimestampType

from bindings.sql import with_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query. Its SQL may use the tables of ``bindings.sql``."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, root: plain(fn(spark, root))
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn
    return add


def plain(df: DataFrame) -> DataFrame:
    """Dates and times as ISO text and floats as rounded doubles, the same on every engine."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, FloatType):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def d(column: str, name: str | None = None) -> str:
    """SQL for a date as text."""
    return f"strftime({column}, '%Y-%m-%d') AS {name or column.split('.')[-1]}"


def t(column: str, name: str | None = None) -> str:
    """SQL for a timestamp as text."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {name or column.split('.')[-1]}"


def f32(column: str, name: str | None = None) -> str:
    """SQL for a float as a rounded double."""
    return f"round(CAST({column} AS DOUBLE), 6) AS {name or column.split('.')[-1]}"
