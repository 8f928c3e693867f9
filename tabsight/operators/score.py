"""Scoring new rows: line them up with the model card, predict, and name the probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabsight.functions.columns import parse_number
from tabsight.operators.models import FittedModel


class NothingToScore(ValueError):
    """None of the model's input columns are present."""


def align(df: DataFrame, card: Sequence[tuple[str, str]], keep: Sequence[str] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """The card's columns in the card's order, numbers coerced, absent ones null; plus missing and unexpected names."""
    names = [c for c, _ in card]
    missing = [c for c in names if c not in df.columns]
    unexpected = sorted(set(df.columns) - set(names) - set(keep))
    if len(missing) == len(names):
        raise NothingToScore("the batch has no column that the model knows; it needs " + ", ".join(names[:10]))
    out = []
    for name, dtype in card:
        if name in missing:
            c = F.lit(None).cast("double" if dtype in ("double", "bigint") else dtype)
        elif dtype in ("double", "bigint") and isinstance(df.schema[name].dataType, T.StringType):
            c = parse_number(F.col(name))
        else:
            c = F.col(name).try_cast("double") if dtype in ("double", "bigint") else F.col(name)
        out.append(c.alias(name))
    return df.select(*keep, *out), missing, unexpected


def named_probabilities(probabilities: Column, labels: Sequence[str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(v) for v in labels]), probabilities)


def score(model: FittedModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Works on a batch or on a stream: every step is a projection."""
    out = model.predict(df, keep)
    if model.task == "classification":
        out = out.withColumn("probabilities", named_probabilities(F.col("probabilities"), model.labels))
    return out
