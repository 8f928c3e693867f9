"""Ad-hoc table verbs: a typed question, checked against the schema, turned into one Spark plan.

Null rules follow the dataframe convention the verbs come from: a comparison with a missing value is
false, ``!=`` is true, group-by drops missing keys, the sum of nothing is 0 and its product is 1.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tabsight.functions.columns import kurtosis_corrected, numeric_columns, pearson, skew_corrected
from tabsight.functions.frames import per_column
from tabsight.operators.ordinal import average_rank, quantiles

#: Rows shown by ``capped``; the rest are counted.
RESULT_ROWS = 25

COMPARISONS = {
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}


class UnknownVerb(ValueError):
    """A verb or column that the table does not have."""


# ---- row expressions -----------------------------------------------------------------------------


def compare(left: Column, op: str, right) -> Column:
    """A two-valued comparison: missing on either side gives False, or True for ``!=``."""
    if op not in COMPARISONS:
        raise UnknownVerb(f"unknown comparison {op!r}")
    return F.coalesce(COMPARISONS[op](left, right), F.lit(op == "!="))


def true_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def floor_divide(a: Column, b: Column) -> Column:
    return F.floor(true_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign."""
    return a - b * floor_divide(a, b)


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def text_slice(text: Column, start: int, stop: int) -> Column:
    if start < 0 or stop < start:
        raise ValueError("text_slice takes 0 <= start <= stop")
    return F.substring(text, start + 1, stop - start)


def text_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def round_time(ts: Column, unit_seconds: int) -> Column:
    """Nearest multiple of the unit since the epoch; the midpoint goes to the even multiple."""
    unit = unit_seconds * 1_000_000
    micros = F.unix_micros(ts.cast("timestamp"))
    rest = F.pmod(micros, F.lit(unit))
    steps = F.floor((micros - rest) / F.lit(unit)).cast("long")
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (F.pmod(steps, F.lit(2)) == 1))
    return F.timestamp_micros((steps + up.cast("long")) * F.lit(unit)).cast("timestamp_ntz")


# ---- aggregates ----------------------------------------------------------------------------------

#: Aggregates of one column that a single map-side-combined pass can answer.
AGGREGATES = {
    "mean": F.avg,
    "sum": lambda x: F.coalesce(F.sum(x), F.lit(0)),
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "count": F.count,
    "size": lambda _: F.count(F.lit(1)),
    "nunique": F.count_distinct,
    "sem": lambda x: F.stddev_samp(x) / F.nullif(F.sqrt(F.count(x)), F.lit(0.0)),
    "skew": skew_corrected,
    "kurt": kurtosis_corrected,
    "prod": lambda x: F.coalesce(F.product(x), F.lit(1.0)),
    "any": F.bool_or,
    "all": F.bool_and,
}

#: Aggregates that need ranks; they go through the exact quantile operator.
RANKED = {"median": 0.5}

#: Aggregates of a pair of columns.
PAIRED = {"corr": pearson, "cov": F.covar_samp}


@dataclass(frozen=True)
class Agg:
    """One output of an aggregation: ``verb`` over ``column`` (and ``other`` for pairs, ``q`` for quantile)."""

    verb: str
    column: str = ""
    other: str = ""
    q: float = 0.5


@dataclass(frozen=True)
class QuerySpec:
    """A whole question: filter, group, aggregate, order, limit."""

    select: Sequence[str] = ()
    where: Column | None = None
    group_by: Sequence[str] = ()
    agg: dict[str, Agg] = field(default_factory=dict)
    order_by: Sequence[tuple[str, bool]] = ()
    limit: int | None = None


def _check(df: DataFrame, spec: QuerySpec) -> None:
    used = [*spec.select, *spec.group_by, *[a.column for a in spec.agg.values() if a.column]]
    used += [a.other for a in spec.agg.values() if a.other]
    unknown = sorted(set(used) - set(df.columns))
    if unknown:
        raise UnknownVerb(f"unknown columns: {', '.join(unknown)}")
    for name, a in spec.agg.items():
        if a.verb not in AGGREGATES and a.verb not in PAIRED and a.verb not in RANKED and a.verb != "quantile":
            raise UnknownVerb(f"unknown verb {a.verb!r} for {name!r}")


def aggregate(df: DataFrame, aggs: dict[str, Agg], by: Sequence[str] = ()) -> DataFrame:
    """All light aggregates in one pass; each distinct ranked column adds one quantile plan."""
    for key in by:
        df = df.where(F.col(key).isNotNull())
    light, ranked = {}, {}
    for name, a in aggs.items():
        if a.verb in PAIRED:
            light[name] = PAIRED[a.verb](F.col(a.column), F.col(a.other))
        elif a.verb == "quantile" or a.verb in RANKED:
            ranked.setdefault(a.column, {})[name] = RANKED.get(a.verb, a.q)
        else:
            light[name] = AGGREGATES[a.verb](F.col(a.column) if a.column else F.lit(1))
    result = df.groupBy(*by).agg(*[e.alias(n) for n, e in light.items()]) if light else None
    for column, wanted in ranked.items():
        probs = list(wanted.values())
        q = quantiles(df, [column], probs, by).select(
            *by, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(wanted)]
        )
        if result is None:
            result = q
        elif by:
            result = result.join(q, list(by), "left")
        else:
            # two one-row frames meet on a constant key
            result = result.withColumn("_k", F.lit(1)).join(q.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    return result.select(*by, *aggs)


def run(df: DataFrame, spec: QuerySpec) -> DataFrame:
    _check(df, spec)
    if spec.where is not None:
        df = df.where(spec.where)
    if spec.agg:
        df = aggregate(df, spec.agg, spec.group_by)
    elif spec.group_by:
        raise ValueError("group_by needs at least one aggregate")
    if spec.select:
        df = df.select(*spec.select)
    if spec.order_by:
        df = sort_values(df, spec.order_by)
    return df.limit(spec.limit) if spec.limit is not None else df


# ---- table verbs ---------------------------------------------------------------------------------


def sort_values(df: DataFrame, order: Sequence[tuple[str, bool]]) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order])


def head(df: DataFrame, key: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*key).limit(n)


def tail(df: DataFrame, key: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.col(k).desc() for k in key]).limit(n)


def nlargest(df: DataFrame, column: str, key: Sequence[str], n: int = 5) -> DataFrame:
    return df.where(F.col(column).isNotNull()).orderBy(F.col(column).desc(), *key).limit(n)


def nsmallest(df: DataFrame, column: str, key: Sequence[str], n: int = 5) -> DataFrame:
    return df.where(F.col(column).isNotNull()).orderBy(F.col(column).asc(), *key).limit(n)


def idxmax(df: DataFrame, column: str, key: str) -> DataFrame:
    """Key of the largest value; the smallest key wins a tie."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.min(key).alias("k"))
    return first.agg(F.max_by("k", "v").alias("idxmax"))


def idxmin(df: DataFrame, column: str, key: str) -> DataFrame:
    low = F.min(F.struct(F.col(column).alias("v"), F.col(key).alias("k")))
    return df.where(F.col(column).isNotNull()).agg(low["k"].alias("idxmin"))


def mode(df: DataFrame, column: str) -> DataFrame:
    """Every value that ties for the highest count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("n"))
    return counts.join(F.broadcast(top), "n").select(column, "n")


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def drop_duplicates(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """The row with the smallest key of each combination; combines on the map side, so copies stay cheap."""
    rest = [c for c in df.columns if c not in columns]
    kept = F.min_by(F.struct(*rest), F.col(key))
    return df.groupBy(*columns).agg(kept.alias("_r")).select(*columns, "_r.*").select(*df.columns)


def rank(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    return average_rank(df, column, name=name)


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std (sample), min, quartiles and max, one row per column."""
    columns = list(columns or numeric_columns(df))
    base = per_column(
        df,
        columns,
        lambda _, c: {
            "count": F.count(c),
            "mean": F.avg(c),
            "std": F.stddev_samp(c),
            "min": F.min(c.cast("double")),
            "max": F.max(c.cast("double")),
        },
    )
    q = quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        "column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    return base.join(F.broadcast(q), "column", "left")


def capped(df: DataFrame, order: Sequence[str], limit: int = RESULT_ROWS) -> DataFrame:
    """The first rows of a result as text, with the number of rows left out and a note when empty."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    shown = df.orderBy(*order).limit(limit).select(F.to_json(F.struct(*df.columns)).alias("row"))
    return (
        total.withColumn("_k", F.lit(1))
        .join(shown.withColumn("_k", F.lit(1)), "_k", "left")
        .select(
            "row",
            F.greatest(F.col("total") - limit, F.lit(0)).alias("remaining"),
            F.when(F.col("total") == 0, F.lit("no rows matched")).alias("note"),
        )
    )
