"""Cleaning removes rows and columns and corrects types. It never fills a value."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tabsight.functions.columns import parse_datetime, parse_number, ratio, text_columns
from tabsight.functions.frames import per_column
from tabsight.operators.eda import missing_report
from tabsight.operators.ordinal import quantiles

# Thresholds.
TAIL_QUANTILE = 0.005
COERCION_SHARE = 0.95
MAX_NULL_RATE = 0.6


class NothingLeft(ValueError):
    """Cleaning left nothing to model."""


def drop_excluded(df: DataFrame, excluded: Sequence[str], target: str) -> DataFrame:
    return df.drop(*[c for c in excluded if c != target])


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def _as_number(df: DataFrame, column: str):
    c = F.col(column)
    return parse_number(c) if column in text_columns(df) else c.cast("double")


def drop_nonfinite_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.coalesce(F.abs(_as_number(df, target)) < F.lit(float("inf")), F.lit(False)))


def target_tail(df: DataFrame, target: str, exact: bool = True) -> DataFrame:
    """(lower, upper, median, maximum, n): the outer half percent at each end; empty when there is no tail.

    The bounds are one small row, fitted first; counting what lies outside is a second narrow scan.
    """
    y = df.select(_as_number(df, target).alias("y")).where(F.col("y").isNotNull())
    q = quantiles(y, ["y"], [TAIL_QUANTILE, 0.5, 1 - TAIL_QUANTILE], exact=exact).first()
    lower, median, upper = q["q"] if q and q["q"] else (None, None, None)
    usable = lower is not None and lower < upper
    lo, hi = F.lit(lower if usable else None).cast("double"), F.lit(upper if usable else None).cast("double")
    found = y.agg(
        F.count("y").alias("rows"),
        F.max("y").alias("maximum"),
        F.count_if((F.col("y") < lo) | (F.col("y") > hi)).alias("n"),
    )
    return found.where((F.col("rows") >= 1 / TAIL_QUANTILE) & (F.col("n") > 0)).select(
        lo.alias("lower"), hi.alias("upper"), F.lit(median).cast("double").alias("median"), "maximum", "n"
    )


def trim_target(df: DataFrame, target: str, lower: float, upper: float) -> DataFrame:
    return df.where(_as_number(df, target).between(lower, upper))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact copies over all remaining columns, nulls equal; copies collapse before the shuffle."""
    return df.dropDuplicates()


def coercion_evidence(df: DataFrame, semantics: dict[str, str], target: str = "", task: str = "") -> DataFrame:
    """(column, to_type, had, kept, accepted) for text columns whose semantic type says date or number."""
    wanted = {}
    for name in text_columns(df):
        if name == target:
            if task == "regression":
                wanted[name] = "double"
        elif semantics.get(name) == "datetime":
            wanted[name] = "timestamp"
        elif semantics.get(name) == "text":
            wanted[name] = "double"
    if not wanted:
        return df.sparkSession.createDataFrame([], "column string, to_type string, had long, kept long, accepted boolean")

    def measure(name, c):
        parsed = parse_datetime(c) if wanted[name] == "timestamp" else parse_number(c)
        return {"to_type": F.first(F.lit(wanted[name])), "had": F.count(c), "kept": F.count(parsed)}

    enough = ratio(F.col("kept"), F.col("had")) >= COERCION_SHARE
    return per_column(df, list(wanted), measure).withColumn("accepted", F.coalesce(enough, F.lit(False)))


def correct_dtypes(df: DataFrame, semantics: dict[str, str], target: str = "", task: str = "") -> DataFrame:
    accepted = {row["column"]: row["to_type"] for row in coercion_evidence(df, semantics, target, task).where("accepted").collect()}
    return df.select(
        *[
            F.col(c) if c not in accepted else (parse_datetime(F.col(c)) if accepted[c] == "timestamp" else parse_number(F.col(c))).alias(c)
            for c in df.columns
        ]
    )


def column_verdicts(df: DataFrame, target: str, max_null_rate: float = MAX_NULL_RATE) -> DataFrame:
    """(column, null_rate, reason) from one scan: min = max means constant, no distinct count is needed."""
    n = F.count(F.lit(1))

    def measure(_, c):
        return {"null_rate": ratio(n - F.count(c), n), "constant": F.coalesce(F.min(c) == F.max(c), F.lit(True))}

    reason = F.when(F.col("constant"), "constant").when(F.col("null_rate") > max_null_rate, "mostly missing")
    return per_column(df, [c for c in df.columns if c != target], measure).select("column", "null_rate", reason.alias("reason"))


def drop_constant(df: DataFrame, target: str) -> DataFrame:
    gone = [row["column"] for row in column_verdicts(df, target).where("reason = 'constant'").collect()]
    return df.drop(*gone)


def drop_sparse(df: DataFrame, target: str, max_null_rate: float = MAX_NULL_RATE) -> DataFrame:
    gone = [row["column"] for row in column_verdicts(df, target, max_null_rate).where(F.col("null_rate") > max_null_rate).collect()]
    return df.drop(*gone)


def guard_usable(df: DataFrame, target: str) -> None:
    if len(df.columns) < 2:
        raise NothingLeft("cleaning left no column besides the target")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.min(target).alias("lo"), F.max(target).alias("hi")).first()
    if row["n"] < 2:
        raise NothingLeft(f"cleaning left {row['n']} rows, which is too few")
    if row["lo"] is None or row["lo"] == row["hi"]:
        raise NothingLeft(f"every row has the same value of {target!r}, so there is nothing to predict")


@dataclass
class Cleaned:
    df: DataFrame
    steps: DataFrame
    dropped: list[tuple[str, str]] = field(default_factory=list)
    corrected: dict[str, str] = field(default_factory=dict)
    tail: DataFrame | None = None
    remaining: DataFrame | None = None


def clean(
    df: DataFrame,
    target: str,
    task: str,
    semantics: dict[str, str] | None = None,
    excluded: Sequence[str] = (),
    trim: bool = False,
    drop_duplicates: bool = True,
    drop_high_null: bool = True,
    max_null_rate: float = MAX_NULL_RATE,
    key: str | None = None,
) -> Cleaned:
    """All cleaning steps in order, with a (step, n) table of what each removed.

    Row counts of the filters come from one aggregate over the input; duplicates need the two counts
    around them. Column verdicts are read on the driver, one small row per column. ``key`` names a column that identifies
    rows: it is kept and never judged, and of rows that differ only in it the one with the smallest key stays.
    """
    if target not in df.columns:
        raise NothingLeft(f"there is no column {target!r} to predict")
    bare = (lambda t: t.drop(key)) if key else (lambda t: t)
    before_columns = len(bare(df).columns)
    dropped = [(c, "excluded") for c in excluded if c in df.columns and c != target]
    work = drop_excluded(df, excluded, target)
    number = _as_number(work, target)
    finite = F.coalesce(F.abs(number) < F.lit(float("inf")), F.lit(False))
    measured = work.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(F.col(target).isNull()).alias("missing_target"),
        F.count_if(F.col(target).isNotNull() & ~finite).alias("nonfinite_target"),
    )
    work = drop_missing_target(work, target)
    tail = None
    trimmed = 0
    if task == "regression":
        work = drop_nonfinite_target(work, target)
        tail = target_tail(work, target)
        if trim:
            bounds = tail.first()
            if bounds:
                trimmed = bounds["n"]
                work = trim_target(work, target, bounds["lower"], bounds["upper"])
    else:
        measured = measured.withColumn("nonfinite_target", F.lit(0).cast("long"))
    rows_in = work.agg(F.count(F.lit(1)).alias("n"))
    if drop_duplicates and key:
        work = work.groupBy(*bare(work).columns).agg(F.min(key).alias(key)).select(*work.columns)
    elif drop_duplicates:
        work = drop_duplicate_rows(work)
    rows_out = work.agg(F.count(F.lit(1)).alias("n"))
    corrected = {}
    evidence = coercion_evidence(bare(work), semantics or {}, target, task)
    for row in evidence.where("accepted").collect():
        corrected[row["column"]] = row["to_type"]
    work = work.select(
        *[
            F.col(c) if c not in corrected else (parse_datetime(F.col(c)) if corrected[c] == "timestamp" else parse_number(F.col(c))).alias(c)
            for c in work.columns
        ]
    )
    verdicts = column_verdicts(bare(work), target, max_null_rate).where(F.col("reason").isNotNull()).collect()
    gone = [(v["column"], v["reason"]) for v in verdicts if v["reason"] == "constant" or drop_high_null]
    dropped += gone
    work = work.drop(*[c for c, _ in gone])
    steps = (
        measured.select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(s).alias("step"), F.col(s).alias("n"))
                        for s in ("rows_before", "missing_target", "nonfinite_target")
                    ]
                )
            )
        )
        .unionByName(rows_in.select(F.lit("rows_before_duplicates").alias("step"), "n"))
        .unionByName(rows_out.select(F.lit("rows_after").alias("step"), "n"))
        .unionByName(
            df.sparkSession.range(1).select(
                F.inline(
                    F.array(
                        *[
                            F.struct(F.lit(s).alias("step"), F.lit(v).cast("long").alias("n"))
                            for s, v in (("trimmed_target", trimmed), ("columns_before", before_columns), ("columns_after", len(bare(work).columns)))
                        ]
                    )
                )
            )
        )
    )
    return Cleaned(work, steps, dropped, corrected, tail, missing_report(bare(work)))
