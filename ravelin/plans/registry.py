"""The registry of named queries and of the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ravelin.operators.joins import unions_dealt_anew

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")

        @wraps(f)
        def asked(spark: SparkSession, sf: str) -> DataFrame:
            unions_dealt_anew(spark)
            return f(spark, sf)

        QUERIES[name] = asked
        if sql:
            ORACLE[name] = sql
        return f

    return add
