"""Names of queries, with their Spark form and, where it exists, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def r6(c="value"):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def ts(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def dts(c: str, as_: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {as_ or c}"
