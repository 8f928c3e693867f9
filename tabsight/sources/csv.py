"""Reading CSV as text and giving it types by explicit rules rather than by sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.functions.columns import NUMBER_PATTERN, parse_datetime, parse_number, text_columns
from tabsight.functions.frames import per_column

# The strings a CSV reader takes as missing.
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "NULL",
    "NaN",
    "nan",
    "null",
)
# Strings that mean "has none", kept as labels unless the column is numeric.
NOT_APPLICABLE = ("NA", "N/A", "n/a", "None")

RECOVERY_SHARE = 0.95
PREVIEW_ROWS = 10
INTEGER_PATTERN = r"^\s*[+-]?[0-9]{1,18}\s*$"
BOOLEAN_WORDS = ("True", "False", "TRUE", "FALSE", "true", "false")


class UnusableTable(ValueError):
    """The input cannot be used as a dataset; the message says why."""


def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Every column as text. ``multiline`` makes files unsplittable, so it is off unless asked for."""
    return (
        spark.read.option("header", True)
        .option("mode", "FAILFAST")
        .option("encoding", "UTF-8")
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(path)
    )


def duplicate_headers(spark: SparkSession, path: str) -> DataFrame:
    """(name, n) for header names that occur more than once in the raw first line of a file, whichever file it is."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")]
    lines = spark.read.text(path).select("value", *place)
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "row").alias("value"))
    fields = F.regexp_extract_all("value", F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    names = first.select("file", F.explode(fields).alias("raw"))
    clean = F.regexp_replace(F.regexp_replace("raw", '^"|"$', ""), '""', '"')
    counts = names.groupBy("file", clean.alias("name")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return counts.groupBy("name").agg(F.max("n").alias("n"))


def map_missing(df: DataFrame) -> DataFrame:
    texts = set(text_columns(df))
    return df.select(
        *[F.when(~F.col(c).isin(*MISSING_TOKENS), F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns]
    )


def recoverable_columns(df: DataFrame, share: float = RECOVERY_SHARE) -> DataFrame:
    """(column, sentinels, present, numbers, numeric): the evidence behind numeric recovery, in one pass."""

    def measure(_, c):
        sentinel = c.isin(*NOT_APPLICABLE)
        other = c.isNotNull() & ~sentinel
        return {
            "sentinels": F.count_if(sentinel),
            "present": F.count_if(other),
            "numbers": F.count_if(other & c.rlike(NUMBER_PATTERN)),
        }

    evidence = per_column(df, text_columns(df), measure)
    enough = F.try_divide(F.col("numbers").cast("double"), F.col("present").cast("double")) >= share
    return evidence.withColumn("numeric", (F.col("sentinels") > 0) & (F.col("present") > 0) & F.coalesce(enough, F.lit(False)))


def recover_numeric(df: DataFrame, share: float = RECOVERY_SHARE) -> DataFrame:
    """Text columns with "NA"-like labels become numbers when nearly everything else in them is one."""
    if not text_columns(df):
        return df
    chosen = {row["column"] for row in recoverable_columns(df, share).where("numeric").collect()}
    return df.select(*[parse_number(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def infer_types(df: DataFrame, share: float = RECOVERY_SHARE) -> dict[str, str]:
    """Column types from all values of a text table, in one scan: long, double, boolean or string.

    Numeric recovery is part of the same scan: a column with "NA"-like labels is a number when nearly
    everything else in it is one.
    """

    def measure(_, c):
        sentinel = c.isin(*NOT_APPLICABLE)
        return {
            "present": F.count(c),
            "sentinels": F.count_if(sentinel),
            "integers": F.count_if(c.rlike(INTEGER_PATTERN)),
            "numbers": F.count_if(c.rlike(NUMBER_PATTERN)),
            "booleans": F.count_if(c.isin(*BOOLEAN_WORDS)),
        }

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    texts = text_columns(df)
    if not texts:
        return types
    for row in per_column(df, texts, measure).collect():
        n, other = row["present"], row["present"] - row["sentinels"]
        if n and row["integers"] == n:
            types[row["column"]] = "bigint"
        elif (n and row["numbers"] == n) or (row["sentinels"] and other and row["numbers"] / other >= share):
            types[row["column"]] = "double"
        elif n and row["booleans"] == n:
            types[row["column"]] = "boolean"
    return types


def apply_schema(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Project text to fixed types; what does not read becomes null, never an error."""
    out = []
    texts = set(text_columns(df))
    for name in df.columns:
        wanted, c = types.get(name, "string"), F.col(name)
        if name not in texts:
            out.append(c)
            continue
        if wanted == "double":
            c = parse_number(c)
        elif wanted == "bigint":
            c = F.when(c.rlike(INTEGER_PATTERN), F.trim(c).try_cast("bigint"))
        elif wanted == "boolean":
            c = F.lower(c).try_cast("boolean")
        elif wanted == "timestamp":
            c = parse_datetime(c)
        out.append(c.alias(name))
    return df.select(*out)


def check_usable(df: DataFrame) -> None:
    if len(df.columns) < 2:
        raise UnusableTable("one column alone leaves nothing to learn from")
    if len(set(df.columns)) != len(df.columns):
        raise UnusableTable("two columns have the same name")
    if df.isEmpty():
        raise UnusableTable("the table has no rows")


def ingest_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Text scan, header check, missing tokens, then one pass that settles recovery and types."""
    repeated = [row["name"] for row in duplicate_headers(spark, path).collect()]
    if repeated:
        raise UnusableTable(f"duplicate column names: {', '.join(sorted(repeated))}")
    df = map_missing(read_csv(spark, path, multiline))
    check_usable(df)
    return apply_schema(df, infer_types(df))


def preview(df: DataFrame, key: Sequence[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in key order as JSON text; NaN cannot occur after ingest, null stays null."""
    return df.orderBy(*key).limit(n).select(*key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
