"""A dirty copy of the events table, built from the whole table the same way in Spark and in SQL.

It has missing numbers (null and NaN), numbers and dates as text, "NA" labels, a constant column, a
mostly empty column, contact details and duplicate rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.functions.columns import nan_to_null
from tabsight.plans.registry import table


def dirty_raw(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    ts, kind = F.col("ts"), F.col("event_type")
    once = events.select(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        F.when(F.minute(ts) < 8, F.lit(None)).when(F.minute(ts) >= 58, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        F.when(F.second(ts) < 2, "NA").when(F.second(ts) == 2, "unknown").otherwise(F.col("value").cast("string")).alias("value_text"),
        F.when(F.minute(ts) == 3, "NA")
        .when(kind == "error", F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == "click", F.date_format(ts, "dd/MM/yyyy"))
        .otherwise(F.date_format(ts, "MMMM d, yyyy"))
        .alias("date_text"),
        F.when(kind == "signup", "NA").when(kind == "view", "None").when(kind == "click", "null").when(kind == "error", "").otherwise(kind).alias("label"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("+44 20 "), F.lpad(F.col("user_id").cast("string"), 7, "0")).alias("phone"),
        F.lit("fixed").alias("constant"),
        F.when(kind == "purchase", F.col("value")).alias("sparse"),
        F.when(F.col("value") > 50, 1).otherwise(0).alias("flag"),
    )
    return once.unionByName(once.where(F.col("event_type") == "error"))


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    return nan_to_null(dirty_raw(spark, folder))


_ONE = """
SELECT event_id, user_id, event_type, ts,
  CASE WHEN extract(minute FROM ts) < 8 OR extract(minute FROM ts) >= 58 THEN NULL ELSE value END AS value,
  CASE WHEN extract(second FROM ts) < 2 THEN 'NA' WHEN extract(second FROM ts) = 2 THEN 'unknown' ELSE CAST(value AS VARCHAR) END AS value_text,
  CASE WHEN extract(minute FROM ts) = 3 THEN 'NA' WHEN event_type = 'error' THEN strftime(ts, '%Y-%m-%d')
       WHEN event_type = 'click' THEN strftime(ts, '%d/%m/%Y') ELSE strftime(ts, '%B %-d, %Y') END AS date_text,
  CASE event_type WHEN 'signup' THEN 'NA' WHEN 'view' THEN 'None' WHEN 'click' THEN 'null' WHEN 'error' THEN '' ELSE event_type END AS label,
  'user' || CAST(user_id AS VARCHAR) || '@example.com' AS email,
  '+44 20 ' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS phone,
  'fixed' AS constant,
  CASE WHEN event_type = 'purchase' THEN value END AS sparse,
  CASE WHEN value > 50 THEN 1 ELSE 0 END AS flag
FROM events
"""

#: A CTE body for ``WITH dirty AS (...)``.
DIRTY = f"{_ONE} UNION ALL {_ONE} WHERE event_type = 'error'"
WITH_DIRTY = f"WITH dirty AS ({DIRTY})"
