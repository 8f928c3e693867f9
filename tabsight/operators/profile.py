"""What each column is: counts, semantic type, personal data, the likely target and task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabsight.functions.columns import DATE_SEPARATOR, is_numeric, parse_datetime, ratio
from tabsight.functions.frames import distinct_counts, per_column, unpivot_text
from tabsight.operators.eda import class_balance, target_distribution
from tabsight.sources.csv import NOT_APPLICABLE

# Patterns and thresholds.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
SSN = r"^\d{3}-\d{2}-\d{4}$"
PHONE = r"^\+?[\d\s().-]{7,}$"
PII_SHARE = 0.8
DATE_SHARE = 0.9
MAX_CATEGORIES = 20
TEXT_SHARE = 0.5
SAMPLE_VALUES = 5


def _dtype(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    return "double" if is_numeric(data_type) else data_type.simpleString()


def datetime_evidence(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, tested, separated, parsed, looks_like_datetime) over every value, "NA" labels aside."""

    def measure(_, c):
        tested = c.isNotNull() & ~F.trim(c).isin(*NOT_APPLICABLE)
        return {
            "tested": F.count_if(tested),
            "separated": F.count_if(tested & F.trim(c).rlike(DATE_SEPARATOR)),
            "parsed": F.count_if(tested & parse_datetime(c).isNotNull()),
        }

    share = ratio(F.col("parsed"), F.col("tested"))
    return per_column(df, columns, measure).withColumn(
        "looks_like_datetime", (F.col("separated") > 0) & F.coalesce(share >= DATE_SHARE, F.lit(False))
    )


def pii_evidence(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, email, ssn, phone, pii_type): the share of values that match each pattern."""

    def measure(_, c):
        return {
            "email": ratio(F.count_if(c.rlike(EMAIL)), F.count(c)),
            "ssn": ratio(F.count_if(c.rlike(SSN)), F.count(c)),
            "phone": ratio(F.count_if(c.rlike(PHONE)), F.count(c)),
        }

    kind = F.when(F.col("email") >= PII_SHARE, "email").when(F.col("ssn") >= PII_SHARE, "ssn").when(F.col("phone") >= PII_SHARE, "phone")
    return per_column(df, columns, measure).withColumn("pii_type", kind)


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column. Null counts, ranges and text evidence come from a single scan; exact distinct
    counts from two group-bys over (column, value), or from a sketch with ``exact=False``."""
    n = F.count(F.lit(1))
    kinds = {f.name: _dtype(f.dataType) for f in df.schema}

    def measure(name, c):
        text = kinds[name] == "string"
        number = c.cast("double") if kinds[name] in ("bigint", "double", "boolean") else F.lit(None).cast("double")
        tested = (c.isNotNull() & ~F.trim(c).isin(*NOT_APPLICABLE)) if text else F.lit(False)
        out = {
            "ordinal": F.first(F.lit(df.columns.index(name))).cast("long"),
            "dtype": F.first(F.lit(kinds[name])),
            "n_rows": n,
            "null_count": n - F.count(c),
            "null_rate": F.coalesce(ratio(n - F.count(c), n), F.lit(0.0)),
            "lo": F.min(number),
            "hi": F.max(number),
            "tested": F.count_if(tested),
            "separated": F.count_if(tested & F.trim(c).rlike(DATE_SEPARATOR)) if text else F.sum(F.lit(0).cast("long")),
            "parsed": F.count_if(tested & parse_datetime(c).isNotNull()) if text else F.sum(F.lit(0).cast("long")),
        }
        for label, pattern in (("email", EMAIL), ("ssn", SSN), ("phone", PHONE)):
            out[label] = ratio(F.count_if(c.rlike(pattern)), F.count(c)) if text else F.max(F.lit(None).cast("double"))
        if not exact:
            out["n_unique"] = F.approx_count_distinct(c)
        return out

    base = per_column(df, df.columns, measure)
    if exact:
        base = base.join(F.broadcast(distinct_counts(df, df.columns)), "column", "left").withColumn(
            "n_unique", F.coalesce("n_unique", F.lit(0).cast("long"))
        )
    present = F.col("n_rows") - F.col("null_count")
    dateish = (F.col("separated") > 0) & F.coalesce(ratio(F.col("parsed"), F.col("tested")) >= DATE_SHARE, F.lit(False))
    zero_one = (F.col("n_unique") <= 2) & F.coalesce(F.col("lo").isin(0.0, 1.0) & F.col("hi").isin(0.0, 1.0), F.col("n_unique") == 0)
    semantic = (
        F.when(F.col("dtype") == "boolean", "boolean")
        .when(F.col("dtype") == "timestamp", "datetime")
        .when(F.col("dtype").isin("bigint", "double"), F.when(zero_one, "boolean").otherwise("numeric"))
        .when(F.col("n_unique") == 0, "categorical")
        .when(dateish, "datetime")
        .when((F.col("n_unique") <= MAX_CATEGORIES) | (F.col("n_unique") < TEXT_SHARE * present), "categorical")
        .otherwise("text")
    )
    pii = F.when(F.col("email") >= PII_SHARE, "email").when(F.col("ssn") >= PII_SHARE, "ssn").when(F.col("phone") >= PII_SHARE, "phone")
    out = base.withColumn("semantic_type", semantic)
    out = out.withColumn("pii_type", F.when(F.col("semantic_type").isin("text", "categorical", "numeric"), pii))
    return out.select(
        "ordinal",
        "column",
        "dtype",
        "n_rows",
        "null_count",
        "null_rate",
        "n_unique",
        "semantic_type",
        "pii_type",
        F.col("pii_type").isNotNull().alias("is_pii"),
        F.col("pii_type").isNotNull().alias("exclude"),
    )


def annotate(report: DataFrame, extra_pii: dict[str, str]) -> DataFrame:
    """An outside annotation may mark more columns as personal data, never fewer; unknown names are ignored."""
    if not extra_pii:
        return report
    added = F.create_map(*[x for k, v in extra_pii.items() for x in (F.lit(k), F.lit(v))])
    kind = F.coalesce("pii_type", F.element_at(added, F.col("column")))
    return report.withColumn("pii_type", kind).withColumn("is_pii", kind.isNotNull()).withColumn("exclude", kind.isNotNull())


def default_exclusions(report: DataFrame, target: str) -> DataFrame:
    return report.where(F.col("is_pii") & (F.col("column") != target)).select("column", "pii_type")


def sample_values(df: DataFrame, key: str, n: int = SAMPLE_VALUES) -> DataFrame:
    """(column, value, position): the first distinct values in key order."""
    columns = [c for c in df.columns if c != key]
    firsts = unpivot_text(df, columns, [key]).groupBy("column", "value").agg(F.min(key).alias("_first"))
    order = Window.partitionBy("column").orderBy("_first", "value")
    return firsts.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= n).drop("_first")


def suggest_target(report: DataFrame) -> DataFrame:
    """The last column that is not personal data and not constant; failing that, the last column."""
    usable = ~F.col("is_pii") & (F.col("n_unique") > 1)
    return report.agg(
        F.coalesce(F.max_by("column", F.when(usable, F.col("ordinal"))), F.max_by("column", "ordinal")).alias("target")
    )


def infer_task(report: DataFrame, target: str) -> DataFrame:
    labelled = F.col("semantic_type").isin("categorical", "boolean", "text") | (F.col("n_unique") <= MAX_CATEGORIES)
    return report.where(F.col("column") == target).select(
        F.col("column").alias("target"), F.when(labelled, "classification").otherwise("regression").alias("task")
    )


def retarget(report: DataFrame, df: DataFrame, target: str, task: str) -> dict[str, DataFrame]:
    """The column rows as they are, and the target-dependent parts measured for the confirmed target."""
    if target not in df.columns:
        return {"columns": report}
    out = {"columns": report}
    if task == "classification":
        out["class_balance"] = class_balance(df, target)
    else:
        out["target_distribution"] = target_distribution(df, target)
    return out
