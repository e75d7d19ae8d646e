"""Registered queries: a function of the bound tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from depchron.sources.binding import PRELUDE, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, prelude: bool = True) -> Callable:
    """Registers a function of ``Views`` under its own name."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Views(spark, folder))
        if sql:
            SQL[f.__name__] = PRELUDE + sql if prelude else sql
        return f

    return register
