"""Registry of the named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.functions.scale import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a table loader as query ``name``, with its SQL if there is one."""

    def add(make: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf: make(lambda t: table(spark, sf, t))
        if sql:
            SQL[name] = sql
        return make

    return add
