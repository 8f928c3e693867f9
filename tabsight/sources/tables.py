"""Parquet and CSV tables, and the report sink."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(format).save(path)


def write_report(df: DataFrame, folder: str, name: str, run_id: str, format: str = "parquet") -> str:
    """One tidy table per report, partitioned by run; writing a run again replaces only that run."""
    path = f"{folder.rstrip('/')}/{name}"
    (
        df.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .format(format)
        .save(path)
    )
    return path


def read_report(spark: SparkSession, folder: str, name: str, format: str = "parquet") -> DataFrame:
    return spark.read.format(format).load(f"{folder.rstrip('/')}/{name}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"
