"""Registry of the queries over the star-schema tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places, without negative zero, as the SQL text does."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expression: str, name: str, places: int = 6) -> str:
    return f"round({expression}, {places}) + 0e0 AS {name}"
