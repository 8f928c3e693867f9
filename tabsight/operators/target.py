"""Log scale for a skewed, non-negative target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabsight.functions.columns import skew_corrected

# Thresholds.
HEAVY_SKEW = 2.0
RESIDUAL_SHARE = 0.5


def choose_target_transform(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., minimum, skew_before, skew_after, use_log) from one aggregate."""
    y = F.col(target).cast("double")
    measured = df.groupBy(*by).agg(
        F.min(y).alias("minimum"),
        skew_corrected(y).alias("skew_before"),
        skew_corrected(F.when(y >= 0, F.log1p(y))).alias("skew_after"),
    )
    use = (
        (F.col("minimum") >= 0)
        & (F.abs("skew_before") >= HEAVY_SKEW)
        & (F.abs("skew_after") <= F.abs("skew_before") * RESIDUAL_SHARE)
    )
    return measured.withColumn("use_log", F.coalesce(use, F.lit(False)))


def to_model_scale(y: Column) -> Column:
    return F.log1p(y)


def from_model_scale(y: Column) -> Column:
    return F.expm1(y)
