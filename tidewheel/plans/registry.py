from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function's name with the SQL that checks it."""

    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        ORACLES[build.__name__] = sql
        return build

    return register
