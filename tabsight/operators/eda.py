"""Exploratory statistics and the tables behind the charts. Nothing here changes the data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabsight.functions.columns import is_numeric, numeric_columns, ratio, skew_corrected
from tabsight.functions.frames import per_column, unpivot_number, value_counts
from tabsight.operators.ordinal import quantiles

# Reporting limits and conventions.
TUKEY_MULTIPLIER = 1.5
TOP_VALUES = 10
TOP_CORRELATIONS = 10
MIN_CORRELATION = 0.1
HEATMAP_COLUMNS = 25
MIN_BINS, MAX_BINS = 5, 40
IMBALANCE_RATIO = 1.5


def _quartiles(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    q = quantiles(df, columns, [0.25, 0.5, 0.75], exact=exact)
    return q.select("column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def _fences(quartiles: DataFrame) -> DataFrame:
    """Tukey fences per column; no spread in the middle half means no fence."""
    iqr = F.col("q3") - F.col("q1")
    return quartiles.withColumn("low", F.when(iqr > 0, F.col("q1") - TUKEY_MULTIPLIER * iqr)).withColumn(
        "high", F.when(iqr > 0, F.col("q3") + TUKEY_MULTIPLIER * iqr)
    )


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Mean, population std, min, quartiles, max and Tukey outlier count, one row per column.

    Quartiles are fitted first (one small row per column); everything else is then one aggregate.
    """
    columns = list(columns or numeric_columns(df))
    fences = {row["column"]: row for row in _fence_literals(df, columns, exact)}

    def measure(name, c):
        f = fences[name]
        return {
            "mean": F.avg(c),
            "std": F.stddev_pop(c),
            "minimum": F.min(c.cast("double")),
            "maximum": F.max(c.cast("double")),
            **{k: F.first(F.lit(f[k]).cast("double")) for k in ("q1", "median", "q3")},
            "outlier_count": _outside(c, f),
        }

    return per_column(df, columns, measure)


def _outside(c: Column, fence) -> Column:
    if fence["low"] is None:
        return F.sum(F.lit(0).cast("long"))
    return F.count_if((c < fence["low"]) | (c > fence["high"]))


def _fence_literals(df: DataFrame, columns: Sequence[str], exact: bool) -> list:
    """The fitted fences, one small row per column: the same fit-then-scan shape as any estimator."""
    return _fences(_quartiles(df, columns, exact)).collect()


def outlier_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Rows outside the Tukey fences per column: fences are fitted first, then counted in one pass."""
    columns = list(columns or numeric_columns(df))
    fences = {row["column"]: row for row in _fence_literals(df, columns, exact)}
    return per_column(df, columns, lambda name, c: {"outlier_count": _outside(c, fences[name])})


def boxplot_stats(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Quartiles, whiskers (the most extreme values inside the fences) and the number of fliers."""
    columns = list(columns or numeric_columns(df))
    fences = {row["column"]: row for row in _fence_literals(df, columns, exact)}

    def measure(name, c):
        f = fences[name]
        x = c.cast("double")
        q1, median, q3 = (F.lit(f[k]).cast("double") for k in ("q1", "median", "q3"))
        iqr = (f["q3"] or 0.0) - (f["q1"] or 0.0)
        low, high = (f["q1"] or 0.0) - TUKEY_MULTIPLIER * iqr, (f["q3"] or 0.0) + TUKEY_MULTIPLIER * iqr
        inside = (x >= low) & (x <= high)
        return {
            "q1": F.first(q1),
            "median": F.first(median),
            "q3": F.first(q3),
            "whisker_low": F.min(F.when(inside, x)),
            "whisker_high": F.max(F.when(inside, x)),
            "fliers": F.count_if(~inside),
        }

    return per_column(df, columns, measure)


def category_summary(df: DataFrame, columns: Sequence[str], k: int = TOP_VALUES) -> DataFrame:
    """(column, value, n, n_unique, position): the k commonest values, ties by value.

    The running top-k is a window over already collapsed counts, limited before it is sorted
    (Spark turns the filter on row_number into a group limit on the map side).
    """
    counts = value_counts(df, columns)
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    top = counts.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= k)
    unique = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    return top.join(F.broadcast(unique), "column")


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "numeric" if is_numeric(data_type) else "categorical"


def describe_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """Every column's kind, count, missing rate and the statistics of its kind, in long form."""
    kinds = {f.name: _kind(f.dataType) for f in df.schema}
    n = F.count(F.lit(1))
    base = per_column(
        df,
        df.columns,
        lambda name, c: {
            "kind": F.first(F.lit(kinds[name])),
            "count": F.count(c),
            "missing": n - F.count(c),
            "missing_rate": ratio(n - F.count(c), n),
        },
    )
    numeric = [c for c, k in kinds.items() if k == "numeric"]
    other = [c for c, k in kinds.items() if k != "numeric"]
    out = base
    if numeric:
        out = out.join(F.broadcast(numeric_summary(df, numeric, exact)), "column", "left")
    if other:
        top = category_summary(df, other)
        collapsed = top.groupBy("column").agg(
            F.first("n_unique").alias("n_unique"),
            F.max(F.when(F.col("position") == 1, F.col("value"))).alias("top_value"),
            F.max(F.when(F.col("position") == 1, F.col("n"))).alias("top_count"),
        )
        out = out.join(F.broadcast(collapsed), "column", "left")
    return out


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(left, right, correlation): every unordered pair once, over the rows that have both values.

    Two scans and no expression a pair, so hundreds of columns plan as fast as two. The first scan measures the columns'
    means. In the second each task multiplies blocks of centred rows and of the masks of their gaps into the sums of all
    pairs, and one row a left column and task is added up; their number does not depend on the rows. Centring first keeps
    the sums well conditioned.
    """
    columns = list(columns or numeric_columns(df))
    width = len(columns)
    means = {r["column"]: r["mean"] for r in per_column(df, columns, lambda _, c: {"mean": F.avg(c.cast("double"))}).collect()}
    centred = df.select(*[(F.col(c).cast("double") - F.lit(means[c])).alias(f"c{i}") for i, c in enumerate(columns)])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # n: rows with both; x, xx: sums of the left value and its square where the right one is there; xy: of products
        sums = np.zeros((4, width, width))
        for b in batches:
            x = b.to_numpy(dtype=float, na_value=np.nan)
            there = (~np.isnan(x)).astype(float)
            x = np.where(there > 0, x, 0.0)
            sums += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        yield pd.DataFrame({"i": np.arange(width), **{name: list(part) for name, part in zip(("n", "x", "xx", "xy"), sums)}})

    names = ("n", "x", "xx", "xy")
    parts = centred.mapInPandas(products, "i int, " + ", ".join(f"{c} array<double>" for c in names))
    cells = parts.select("i", F.posexplode(F.arrays_zip(*names)).alias("j", "s")).groupBy("i", "j").agg(
        *[F.sum(F.col("s")[c]).alias(c) for c in names]
    )
    left = cells.where("i < j").alias("l")
    right = cells.where("i > j").select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("x").alias("y"), F.col("xx").alias("yy")).alias("r")
    both = left.join(right, ["i", "j"])  # one row a pair of columns
    cov = F.col("xy") - F.try_divide(F.col("x") * F.col("y"), F.col("n"))
    vx, vy = (F.col(q) - F.try_divide(F.col(v) * F.col(v), F.col("n")) for q, v in (("xx", "x"), ("yy", "y")))
    spread = F.when((vx > 0) & (vy > 0), F.sqrt(vx) * F.sqrt(vy))
    labels = F.array(*[F.lit(c) for c in columns])
    return both.select(labels[F.col("i")].alias("left"), labels[F.col("j")].alias("right"), F.try_divide(cov, spread).alias("correlation"))


def top_correlations(df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_CORRELATIONS) -> DataFrame:
    strength = F.abs("correlation")
    return correlation_matrix(df, columns).where(strength >= MIN_CORRELATION).orderBy(strength.desc(), "left", "right").limit(k)


def heatmap_columns(df: DataFrame, limit: int = HEATMAP_COLUMNS) -> DataFrame:
    """(column, spread): the columns that vary most."""
    spread = per_column(df, numeric_columns(df), lambda _, c: {"spread": F.stddev_pop(c)})
    return spread.orderBy(F.col("spread").desc(), "column").limit(limit)


def histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, bin, lower, upper, n): equal-width bins, floor(log2 n) + 1 of them, between 5 and 40.

    Ranges are measured first; binning is then one pass whose counts combine on the map side.
    """
    bounds = per_column(
        df, columns, lambda _, c: {"lo": F.min(c.cast("double")), "hi": F.max(c.cast("double")), "rows": F.count(c)}
    )
    bins = F.when(F.col("rows") <= 1, 1).otherwise(
        F.greatest(F.lit(MIN_BINS), F.least(F.lit(MAX_BINS), F.floor(F.log2("rows")) + 1))
    )
    bounds = bounds.where(F.col("rows") > 0).withColumn("bins", bins.cast("long"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    bounds = bounds.withColumn("width", F.when(width > 0, width).otherwise(F.lit(1.0)))
    located = unpivot_number(df, columns).join(F.broadcast(bounds), "column")
    index = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.col("bins") - 1).cast("long")
    return (
        located.groupBy("column", "lo", "width", index.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "column",
            "bin",
            (F.col("lo") + F.col("width") * F.col("bin")).alias("lower"),
            (F.col("lo") + F.col("width") * (F.col("bin") + 1)).alias("upper"),
            "n",
        )
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """(label, n, imbalance_ratio, imbalanced). The second step runs over one row per class."""
    counts = (
        df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    )
    ends = counts.agg(ratio(F.max("n"), F.min("n")).alias("imbalance_ratio"))
    return counts.withColumn("_k", F.lit(1)).join(
        F.broadcast(ends.withColumn("_k", F.lit(1))), "_k"
    ).select("label", "n", "imbalance_ratio", (F.col("imbalance_ratio") > IMBALANCE_RATIO).alias("imbalanced"))


def target_distribution(df: DataFrame, target: str, by: Sequence[str] = (), heavy_skew: float = 2.0) -> DataFrame:
    """Min, median, max, mean, bias-corrected skew and the heavy-tail flag of a numeric target."""
    x = F.col(target).cast("double")
    finite = F.when(F.abs(x) < F.lit(float("inf")), x)
    clean = df.select(*by, finite.alias("_y")).where(F.col("_y").isNotNull())
    base = clean.groupBy(*by).agg(
        F.min("_y").alias("minimum"),
        F.max("_y").alias("maximum"),
        F.avg("_y").alias("mean"),
        F.coalesce(skew_corrected(F.col("_y")), F.lit(0.0)).alias("skew"),
    )
    middle = quantiles(clean, ["_y"], [0.5], by).select(*by, F.col("q")[0].alias("median"))
    if by:
        joined = base.join(middle, list(by))
    else:
        joined = base.withColumn("_k", F.lit(1)).join(middle.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return joined.withColumn("heavy_tailed", F.abs("skew") >= heavy_skew)


def target_table(df: DataFrame, target: str, task: str) -> DataFrame:
    """What is predicted: class counts for a label, a histogram for a number."""
    if task == "classification":
        return class_balance(df, target).select(F.col("label").alias("value"), "n")
    return histogram(df, [target])


def missing_report(df: DataFrame) -> DataFrame:
    """(column, missing) for every column with a gap."""
    n = F.count(F.lit(1))
    return per_column(df, df.columns, lambda _, c: {"missing": n - F.count(c)}).where(F.col("missing") > 0)


def missingness(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    out = per_column(df, df.columns, lambda _, c: {"missing": n - F.count(c), "share": ratio(n - F.count(c), n)})
    return out.where(F.col("missing") > 0).orderBy("missing", "column")


def eda(df: DataFrame, target: str, task: str) -> dict[str, DataFrame]:
    """All EDA tables of one dataset. Fails if a step changed the columns it describes."""
    before = df.columns
    numeric = numeric_columns(df)
    features = [c for c in numeric if c != target]
    reports = {
        "columns": describe_columns(df),
        "missingness": missingness(df),
        "target": target_table(df, target, task),
    }
    if task == "classification":
        reports["class_balance"] = class_balance(df, target)
    if len(numeric) >= 2:
        reports["correlations"] = top_correlations(df, numeric)
    if features:
        reports["histograms"] = histogram(df, features)
        reports["boxplots"] = boxplot_stats(df, features)
    if df.columns != before:
        raise AssertionError("EDA must not change the table")
    return reports
