"""Where the plans of this package meet: a query is a function (spark, sf_dir) with, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def keep(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return keep


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, so that the order of a sum doesn't show."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    """A literal table."""
    return spark.createDataFrame(data, schema)


def values(name: str, data: list[tuple], columns: str) -> str:
    """The same literal table as a common table expression."""

    def lit(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, (list, tuple)):
            return f"[{', '.join(map(lit, v))}]"
        return "'" + str(v).replace("'", "''") + "'"

    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(lit, row)) + ')' for row in data)})"
