"""Samples, folds and time-ordered splits. Random order is the md5 of a key and a seed, so every draw
can be repeated anywhere, and a task that is lost and recomputed draws the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabsight.functions.columns import is_numeric, leading_number, md5_order, parse_datetime, ratio
from tabsight.operators.ordinal import hashed_ordinal, ordinal
from tabsight.session import is_small

# Limits.
MAX_UNDATED = 0.10
MIN_ROWS = 4


class CannotSplit(ValueError):
    """Cross-validation cannot be run on this table."""


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42, small: bool | None = None) -> DataFrame:
    """Exactly ``n`` rows (or all): the first in md5 order.

    On a large table every task would send its own best n to the final merge. Since the md5 is uniform, a prefix
    cut leaves little more than n rows in all; the cut is used only if at least n rows pass it, so the result
    is the same.
    """
    tagged = df.withColumn("_md5", md5_order(keys, seed))
    if not (is_small(df) if small is None else small):
        share = (n + 10 * n**0.5 + 100) / max(df.count(), 1)
        if share < 1:
            likely = tagged.where(F.col("_md5") < f"{int(share * 16**8):08x}")
            if likely.count() >= n:
                tagged = likely
    return tagged.orderBy("_md5").limit(n).drop("_md5")


def stratified_sample(df: DataFrame, keys: Sequence[str], target: str, n: int, seed: int = 42) -> DataFrame:
    """Each class keeps its share, rounded half-even, and at least one row; the null class is a class."""
    counts = df.groupBy(F.col(target).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"), F.first(F.lit(1)).alias("_k"))
    share = F.least(F.lit(float(n)) / F.col("_total"), F.lit(1.0))
    quota = (
        counts.withColumn("_k", F.lit(1))
        .join(F.broadcast(total), "_k")
        .select("_class", F.greatest(F.lit(1), F.bround(F.col("_n") * share)).cast("long").alias("_quota"))
    )
    placed = hashed_ordinal(df, keys, seed, by=[target], name="_position")
    return placed.join(quota, F.col(target).eqNullSafe(F.col("_class"))).where(F.col("_position") <= F.col("_quota")).select(*df.columns)


def kfold(df: DataFrame, keys: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Shuffled folds 0..k-1; the first n mod k folds are one row larger."""
    n = df.count()
    small, larger = divmod(n, k)
    i = F.col("_position") - 1
    edge = larger * (small + 1)
    fold = F.when(i < edge, F.floor(i / (small + 1))).otherwise(larger + F.floor((i - edge) / max(small, 1)))
    return hashed_ordinal(df, keys, seed, name="_position").select(*df.columns, fold.cast("long").alias("fold"))


def stratified_folds(df: DataFrame, target: str, k: int) -> tuple[int, str]:
    """(folds, strategy): folds drop to the rarest class; a class of one row means plain folds."""
    row = (
        df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("low"), F.sum("n").alias("n")).first()
    )
    if row["n"] is None or row["n"] < MIN_ROWS:
        raise CannotSplit(f"cross-validation needs at least {MIN_ROWS} rows")
    if row["low"] < 2:
        return max(2, min(k, row["n"])), "KFold"
    return max(2, min(k, row["low"])), "StratifiedKFold"


def stratified_kfold(df: DataFrame, keys: Sequence[str], target: str, k: int, seed: int = 42) -> DataFrame:
    folds, strategy = stratified_folds(df, target, k)
    if strategy == "KFold":
        return kfold(df, keys, folds, seed)
    placed = hashed_ordinal(df, keys, seed, by=[target], name="_position")
    return placed.select(*df.columns, F.pmod(F.col("_position") - 1, F.lit(folds)).alias("fold"))


def time_series_split(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """(columns..., fold, role): fold f tests on its window and trains on everything before it.

    The fold list has k entries, so a row is repeated at most k times and nothing is joined.
    """
    n = df.count()
    if n < MIN_ROWS:
        raise CannotSplit(f"cross-validation needs at least {MIN_ROWS} rows")
    k = max(2, min(k, n - 1))
    size = n // (k + 1)
    starts = F.array(*[F.struct(F.lit(f).cast("long").alias("fold"), F.lit(n - (k - f) * size).cast("long").alias("start")) for f in range(k)])
    placed = ordinal(df, order, name="_position").withColumn("_w", F.explode(starts))
    i = F.col("_position") - 1
    role = F.when(i < F.col("_w.start"), "train").when(i < F.col("_w.start") + size, "test")
    return placed.select(*df.columns, F.col("_w.fold").alias("fold"), role.alias("role")).where(F.col("role").isNotNull())


def order_by_time(df: DataFrame, column: str) -> tuple[DataFrame, bool]:
    """Rows with a readable clock in ``_time``, and whether ordering applies.

    Up to a tenth of unreadable rows are left out; beyond that the caller must fall back to random folds. Numeric dates as
    text are read day first throughout if some of the column can only be day first and none can only be month first:
    an order needs one reading for the whole column. The reading settles which moment, not whether there is one.
    """
    data_type = df.schema[column].dataType
    written = data_type.typeName() == "string"
    if is_numeric(data_type):
        clock = F.col(column).cast("double")
    elif written:
        clock = parse_datetime(F.col(column))
    else:
        clock = F.col(column)
    day_led, month_led = leading_number(F.col(column)) if written else (F.lit(False), F.lit(False))
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.count(clock).alias("read"), F.count_if(day_led).alias("day_led"), F.count_if(month_led).alias("month_led")
    ).first()
    if row["read"] == 0:
        raise CannotSplit(f"time column {column!r} holds no readable value")
    if (row["n"] - row["read"]) / row["n"] > MAX_UNDATED:
        return df, False
    if row["day_led"] and not row["month_led"]:
        clock = parse_datetime(F.col(column), day_first=True)
    return df.withColumn("_time", clock).where(F.col("_time").isNotNull()), True


def single_class_folds(df: DataFrame, target: str) -> DataFrame:
    """(fold, classes, single): min = max settles it, no distinct count is needed beyond the class list."""
    return df.groupBy("fold").agg(F.count_distinct(target).alias("classes")).withColumn("single", F.col("classes") < 2)


def time_gap_report(df: DataFrame, column: str) -> DataFrame:
    data_type = df.schema[column].dataType
    clock = parse_datetime(F.col(column)) if data_type.typeName() == "string" else F.col(column)
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), (n - F.count(clock)).alias("unreadable"), ratio(n - F.count(clock), n).alias("rate"))
