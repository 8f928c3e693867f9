"""Univariate feature scores as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabsight.functions.columns import pearson, variance
from tabsight.functions.frames import per_column


def anova_f(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(column, f): between-class over within-class variance. The second step sees one row per class."""
    parts = per_column(
        df.where(F.col(label).isNotNull()),
        columns,
        # the mean of equal values is that value, their sum over their number only up to rounding
        lambda _, c: {"n": F.count(c), "mean": F.when(F.min(c) == F.max(c), F.min(c).cast("double")).otherwise(F.avg(c)), "var": variance(c)},
        by=[label],
    ).where(F.col("n") > 0)
    n, classes = F.sum("n").cast("double"), F.count(F.lit(1)).cast("double")
    overall = parts.groupBy("column").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("overall"))
    joined = parts.join(F.broadcast(overall), "column")
    # Equal means differ by rounding only.
    gap = F.col("mean") - F.col("overall")
    gap = F.when(F.abs(gap) <= 1e-12 * F.abs("overall"), 0.0).otherwise(gap)
    between = F.sum(F.col("n") * F.pow(gap, 2)) / F.nullif(classes - 1, F.lit(0.0))
    within = F.sum(F.col("n") * F.col("var")) / F.nullif(n - classes, F.lit(0.0))
    return joined.groupBy("column").agg(_ratio(between, within).alias("f"))


def _ratio(explained: Column, rest: Column) -> Column:
    """explained / rest; infinite where nothing is left to explain, null where there was nothing at all."""
    return F.when((rest <= 0) & (explained > 0), float("inf")).otherwise(F.try_divide(explained, rest))


def regression_f(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(column, f) from the squared correlation with the target."""
    y = F.col(target).cast("double")
    base = per_column(
        df, [c for c in columns], lambda _, c: {"r": pearson(c.cast("double"), y), "n": F.count_if(c.isNotNull() & y.isNotNull())}
    )
    r2 = F.col("r") * F.col("r")
    # A correlation of one is computed up to rounding.
    rest = F.when(1 - r2 < 1e-12, 0.0).otherwise(1 - r2)
    return base.select("column", _ratio(r2 * (F.col("n") - 2), rest).alias("f"))


def univariate_scores(df: DataFrame, columns: Sequence[str], target: str, task: str) -> DataFrame:
    return anova_f(df, columns, target) if task == "classification" else regression_f(df, columns, target)


def select_k_best(df: DataFrame, columns: Sequence[str], target: str, task: str, k: int) -> DataFrame:
    return univariate_scores(df, columns, target, task).orderBy(F.col("f").desc_nulls_last(), "column").limit(k)
