"""Scoring rows as they arrive: a stateless projection over a file stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from tabsight.operators.models import FittedModel
from tabsight.operators.score import align, score
from tabsight.sources.tables import scratch_path


def read_stream(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(format).load(path)


def score_stream(
    model: FittedModel,
    rows: DataFrame,
    card: Sequence[tuple[str, str]],
    keep: Sequence[str],
    output: str,
    checkpoint: str | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Append scored rows to a parquet folder. The checkpoint makes a restart neither lose nor repeat rows."""
    aligned, _, _ = align(rows, card, keep)
    writer = (
        score(model, aligned, keep)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint or scratch_path(rows.sparkSession, "stream"))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
