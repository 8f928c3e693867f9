"""SMOTE (Chawla et al., 2002): new minority rows on the line between a row and one of its neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabsight.operators.neighbours import nearest
from tabsight.operators.ordinal import hashed_ordinal

# Limits.
MIN_MINORITY = 6
NEIGHBOURS = 5
MAX_CLASSES = 1000


def refusal(df: DataFrame, target: str, task: str) -> str | None:
    """Why oversampling cannot be done, or None."""
    if task != "classification":
        return "the target is continuous"
    sizes = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    counts = [r["n"] for r in sizes.limit(MAX_CLASSES + 1).collect()]
    if len(counts) > MAX_CLASSES:
        return f"the target has over {MAX_CLASSES} values"
    if len(counts) < 2:
        return "the target has only one class"
    if min(counts) < MIN_MINORITY:
        return f"the rarest class has only {min(counts)} rows"
    return None


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from an md5: reproducible and the same wherever it is computed."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(16**8))


def smote(train: DataFrame, key: str, target: str, features: str = "features", k: int | None = None, seed: int = 42) -> DataFrame:
    """``train`` (key, target, features as array<double>) plus synthetic rows so that all classes are equal.

    Only rows of ``train`` are looked at; its keys may have any type. Adds ``synthetic`` and, for new rows, ``base`` and ``neighbour`` keys.
    """
    counts = {r[target]: r["n"] for r in train.groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()}
    top, low = max(counts.values()), min(counts.values())
    k = k or max(1, min(NEIGHBOURS, low - 2))
    none = F.lit(None).cast(train.schema[key].dataType)
    out = train.select(
        key, target, features, F.lit(False).alias("synthetic"), none.alias("base"), none.alias("neighbour")
    )
    for label, n in counts.items():
        need = top - n
        if not need:
            continue
        members = train.where(F.col(target) == F.lit(label)).select(F.col(key).alias("key"), F.col(features).alias("x"))
        whole, extra = divmod(need, n)
        placed = hashed_ordinal(members, ["key"], seed, name="_i")
        draws = (F.lit(whole) + F.when(F.col("_i") <= extra, 1).otherwise(0)).cast("int")
        drawn = placed.where(draws > 0).select("key", "x", F.explode(F.sequence(F.lit(1), draws)).alias("draw"))
        slot = F.floor(_uniform(F.lit(seed), F.lit("slot"), F.col("key"), F.col("draw")) * k).cast("long")
        drawn = drawn.withColumn("_slot", slot).withColumn("_gap", _uniform(F.lit(seed), F.lit("gap"), F.col("key"), F.col("draw")))
        near = nearest(members, k, seed=seed)
        met = drawn.join(near, "key").where((F.col("before") <= F.col("_slot")) & (F.col("_slot") < F.col("before") + F.col("slots")))
        between = F.transform(F.arrays_zip(F.col("x").alias("a"), F.col("point").alias("b")), lambda p: p["a"] + (p["b"] - p["a"]) * F.col("_gap"))
        out = out.unionByName(
            met.select(
                none.alias(key), F.lit(label).alias(target), between.alias(features), F.lit(True).alias("synthetic"), F.col("key").alias("base"), "neighbour"
            )
        )
    return out
