"""Frame-level helpers: one aggregate pass that comes out long, and value counts by unpivot."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabsight.functions.columns import named


#: Columns measured by one aggregate.
COLUMNS_PER_AGGREGATE = 64


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    measure: Callable[[str, Column], dict[str, Column]],
    by: Sequence[str] = (),
) -> DataFrame:
    """One aggregate over ``df`` giving one row per column (and per group).

    ``measure(name, column)`` returns named aggregate expressions. Columns are measured together, so the table
    is scanned once; a very wide table is cut into a few aggregates, each reading only its own columns, so that
    generated code stays within the JVM's method limits.
    """
    out = None
    for start in range(0, len(columns), COLUMNS_PER_AGGREGATE):
        structs = [
            F.struct(F.lit(name).alias("column"), *[e.alias(k) for k, e in measure(name, named(name)).items()])
            for name in columns[start : start + COLUMNS_PER_AGGREGATE]
        ]
        part = df.groupBy(*by).agg(F.array(*structs).alias("_rows")).select(*by, F.inline("_rows"))
        out = part if out is None else out.unionByName(part)
    return out


def unpivot_text(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value) with every value as text and nulls dropped."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("value")) for c in columns]
    )
    return df.select(*keep, F.inline(entries)).where(F.col("value").isNotNull())


def unpivot_number(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), named(c).cast("double").alias("value")) for c in columns]
    )
    return df.select(*keep, F.inline(entries)).where(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): counts pre-aggregate on the map side, so hot values cost one row per task."""
    return unpivot_text(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_unique) exactly, in two group-bys and without an Expand per column."""
    return value_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
