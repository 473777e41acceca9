"""The list of registered queries, each beside its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = date(2025, 8, 1)
"""The newest creation date of the test tables; stands for today."""

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"registered twice: {key}")
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return run

    return add
