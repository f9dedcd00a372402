"""All queries of the engine and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import oracles
from .plans import queries as plans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in plans.ALL}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
