"""Where queries register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, folder) by its name, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        name = function.__name__.rstrip("_")
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register
