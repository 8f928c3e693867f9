"""Where queries are declared: a Spark plan builder and, where SQL can say it, the matching SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is declared twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def r(expr: str, digits: int = 6) -> str:
    """SQL text for the reporting round, the twin of ``functions.columns.rounded``."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)
