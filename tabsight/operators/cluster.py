"""Descriptive clustering. Labels are returned beside the table and never become features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabsight.functions.columns import deviation, is_numeric, md5_order, ratio
from tabsight.functions.frames import distinct_counts, per_column, value_counts
from tabsight.operators.ordinal import quantiles
from tabsight.operators.recipe import FittedRecipe, Recipe
from tabsight.operators.split import sample_rows
from tabsight.operators.strategy import ColumnStrategy

# Limits and thresholds.
MAX_LABELS = 30
K_MIN, K_MAX = 2, 8
ROWS_PER_CLUSTER = 5
DISTINCTIVE_Z = 0.5
DISTINCTIVE_LIFT = 0.15
MAX_DISTINCTIVE = 4
WEAK_SILHOUETTE = 0.5
#: Starts fitted at the same time, as concurrent Spark jobs over one persisted frame.
PARALLEL_STARTS = 4


def cluster_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    """(column, kind, n_unique, eligible): numbers, and labels with few values; never dates."""
    kinds = {}
    for f in df.schema:
        if f.name == target or isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            continue
        kinds[f.name] = "numeric" if is_numeric(f.dataType) else "categorical"
    kind = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))])
    counts = per_column(df, list(kinds), lambda _, c: {"present": F.count(c)}).join(
        F.broadcast(distinct_counts(df, list(kinds))), "column", "left"
    )
    out = counts.select("column", kind[F.col("column")].alias("kind"), F.coalesce("n_unique", F.lit(0).cast("long")).alias("n_unique"))
    return out.withColumn("eligible", (F.col("kind") == "numeric") | (F.col("n_unique") <= MAX_LABELS))


def choose_method(requested: str, categorical: Sequence[str]) -> tuple[str, bool]:
    """Labels force K-Prototypes and their absence forces K-Means; the flag says the request was overruled."""
    method = "kprototypes" if categorical else "kmeans"
    return method, method != requested


def cluster_sample(df: DataFrame, key: str, n: int = 5000, seed: int = 42) -> DataFrame:
    return sample_rows(df, [key], n, seed)


def prepare_matrix(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> FittedRecipe:
    """Median fill, standard scale and one-hot (a missing label is its own level) over all rows: nothing here is modelled."""
    parts = [ColumnStrategy(c, "numeric", "median", "none", "standard") for c in numeric]
    parts += [ColumnStrategy(c, "categorical", "constant", "onehot") for c in categorical]
    return Recipe(parts).fit(df)


# ---- K-Means -------------------------------------------------------------------------------------


def kmeans(df: DataFrame, k: int, seed: int = 42, starts: int = 10, features: str = "features"):
    """The cheapest of several k-means|| fits over a persisted vector column."""

    def fit(i: int):
        return KMeans(k=k, seed=seed + i, featuresCol=features, predictionCol="cluster").fit(df)

    with ThreadPoolExecutor(PARALLEL_STARTS) as pool:
        models = list(pool.map(fit, range(starts)))
    return min(models, key=lambda m: m.summary.trainingCost)


# ---- K-Prototypes --------------------------------------------------------------------------------


@dataclass
class Prototypes:
    """Fitted centres: a few numbers and labels per cluster."""

    numeric: list[str]
    categorical: list[str]
    gamma: float
    centres: list[tuple[list[float], list[str]]]
    cost: float
    costs: list[float]

    def _distance(self, centre) -> Column:
        numbers, labels = centre
        total = F.lit(0.0)
        for c, v in zip(self.numeric, numbers):
            total = total + F.pow(F.col(c) - F.lit(float(v)), 2)
        for c, v in zip(self.categorical, labels):
            total = total + F.when(F.col(c) == F.lit(v), 0.0).otherwise(self.gamma)
        return total

    def nearest(self) -> Column:
        return F.array_min(F.array(*[F.struct(self._distance(c).alias("d"), F.lit(i).alias("cluster")) for i, c in enumerate(self.centres)]))

    def assign(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_n", self.nearest()).select(*df.columns, F.col("_n.cluster").alias("cluster"), F.col("_n.d").alias("cost"))


def kprototypes(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], k: int, key: str, gamma: float | None = None, starts: int = 3, max_iter: int = 100, seed: int = 42
) -> Prototypes:
    """K-Prototypes (Huang, 1998): squared Euclid on scaled numbers plus gamma per differing label.

    ``df`` has scaled numbers and non-null labels. One iteration is one aggregate: assignment is a column
    expression over literal centres, the new centre is a mean and a mode. Lineage does not grow, since every
    iteration starts again from ``df``; callers persist it.
    """
    numeric, categorical = list(numeric), list(categorical)
    if gamma is None:
        spread = df.agg(*[F.stddev_pop(c).alias(c) for c in numeric]).first() if numeric else None
        gamma = 0.5 * float(np.mean([v or 0.0 for v in spread])) if spread is not None else 1.0

    def fit(start: int) -> Prototypes:
        picked = df.withColumn("_o", md5_order([key], seed + start)).orderBy("_o").limit(k).collect()  # k rows
        centres = [([r[c] for c in numeric], [r[c] for c in categorical]) for r in picked]
        model = Prototypes(numeric, categorical, gamma, centres, float("inf"), [])
        for _ in range(max_iter):
            rows = (
                df.withColumn("_n", model.nearest())
                .groupBy(F.col("_n.cluster").alias("cluster"))
                .agg(
                    F.sum("_n.d").alias("cost"),
                    *[F.avg(c).alias(f"n{i}") for i, c in enumerate(numeric)],
                    *[F.mode(c, True).alias(f"c{i}") for i, c in enumerate(categorical)],
                )
                .collect()
            )
            cost = sum(r["cost"] for r in rows)
            model.costs.append(cost)
            if cost >= model.cost * (1 - 1e-12):
                break
            moved = list(model.centres)
            for r in rows:
                moved[r["cluster"]] = ([r[f"n{i}"] for i in range(len(numeric))], [r[f"c{i}"] for i in range(len(categorical))])
            # the cost belongs to the centres it was measured with; the moved ones can only be cheaper
            model = Prototypes(numeric, categorical, gamma, moved, cost, model.costs)
        return model

    with ThreadPoolExecutor(PARALLEL_STARTS) as pool:
        models = list(pool.map(fit, range(starts)))
    return min(models, key=lambda m: m.cost)


# ---- quality -------------------------------------------------------------------------------------


def silhouette_fast(df: DataFrame, features: str = "features", cluster: str = "cluster") -> float:
    """Squared-Euclid silhouette, linear in the rows."""
    return ClusteringEvaluator(featuresCol=features, predictionCol=cluster).evaluate(df)


def silhouette(df: DataFrame, features: str = "features", cluster: str = "cluster", key: str = "key") -> DataFrame:
    """(key, cluster, silhouette) of every row, by squared Euclid.

    The mean squared distance from x to a group is |x - m|^2 plus the group's own mean squared distance from its centre m, so
    one aggregate of a row a group replaces all pairs. A row alone in its group, or all rows in one group, have silhouette 0.
    """
    rows = df.select(F.col(key).alias("key"), F.col(cluster).cast("int").alias("cluster"), F.col(features).alias("x"))
    width = (rows.select(F.size("x").alias("w")).first() or {"w": 0})["w"]
    means = [F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)]
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, t: a + t * t)
    groups = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(square(F.col("x"))).alias("q"), *means).collect()
    if len(groups) < 2:
        return rows.select("key", "cluster", F.lit(0.0).alias("silhouette"))
    mean_gap = {}
    for g in groups:
        centre = [g[f"m{i}"] for i in range(width)]
        spread = g["q"] - sum(m * m for m in centre)
        gaps = F.zip_with("x", F.array(*[F.lit(float(m)) for m in centre]), lambda t, m: t - m)
        mean_gap[g["cluster"]] = (g["n"], square(gaps) + F.lit(float(spread)))
    inside = F.lit(None).cast("double")
    for c, (n, gap) in mean_gap.items():
        inside = F.when(F.col("cluster") == c, gap * (n / (n - 1)) if n > 1 else F.lit(None).cast("double")).otherwise(inside)
    outside = F.least(*[F.when(F.col("cluster") != c, gap) for c, (_, gap) in mean_gap.items()]) if len(mean_gap) > 1 else F.lit(None)
    both = rows.select("key", "cluster", inside.alias("inside"), outside.alias("outside"))
    value = F.try_divide(F.col("outside") - F.col("inside"), F.greatest("inside", "outside"))
    return both.select("key", "cluster", F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def silhouette_of_sample(df: DataFrame, rows: int, features: str = "features", cluster: str = "cluster", key: str = "key") -> DataFrame:
    """(key, cluster, silhouette, sample_rows) by true Euclid, over a sample of ``rows`` rows that the caller asks for.

    Each task compares its part of the sample with the whole, whose size the caller bounds; ``sample_rows`` names it.
    """
    sample = df.select(F.col(key).alias("key"), F.col(cluster).cast("int").alias("cluster"), F.col(features).alias("x"))
    picked = sample_rows(sample, ["key"], rows).persist()
    held = picked.select("cluster", "x").collect()
    points, labels = np.array([r["x"] for r in held], dtype=float), np.array([r["cluster"] for r in held])
    shared = df.sparkSession.sparkContext.broadcast((points, labels))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, labels = shared.value
        names, own = np.unique(labels, return_inverse=True) if len(labels) else (labels, labels)
        member = np.eye(len(names))[own] if len(labels) else np.zeros((0, 0))
        sizes = member.sum(axis=0)
        for b in batches:
            if not len(b):
                continue
            x = np.vstack(b["x"].to_numpy())
            square = (x**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2 * x @ points.T
            total = np.sqrt(np.maximum(square, 0)) @ member
            at = np.searchsorted(names, b["cluster"].to_numpy())
            row = np.arange(len(b))
            inside = total[row, at] / np.maximum(sizes[at] - 1, 1)
            mean = total / sizes
            mean[row, at] = np.inf
            outside = mean.min(axis=1)
            top = np.maximum(inside, outside)
            good = (sizes[at] > 1) & np.isfinite(outside) & (top > 0)
            value = np.where(good, (np.where(good, outside, 0) - inside) / np.where(good, top, 1), 0.0)
            yield pd.DataFrame({"key": b["key"], "cluster": b["cluster"], "silhouette": value, "sample_rows": len(points)})

    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInPandas(measure, f"key {kind}, cluster int, silhouette double, sample_rows long")


def select_k(df: DataFrame, key: str, fit, k_min: int = K_MIN, k_max: int = K_MAX) -> tuple[int | None, dict[int, float]]:
    """The k whose labels separate all rows best, or None with too few rows. ``fit(frame, k)`` returns (key, cluster, features)."""
    n = df.count()
    scores = {}
    for k in range(k_min, min(k_max, n // ROWS_PER_CLUSTER) + 1):
        labelled = fit(df, k).persist()
        if labelled.select("cluster").distinct().count() > 1:
            scores[k] = silhouette(labelled, "features", "cluster", key).agg(F.avg("silhouette")).first()[0]
        labelled.unpersist()
    if not scores:
        return None, {}
    return max(scores, key=lambda k: (scores[k], -k)), scores


# ---- description ---------------------------------------------------------------------------------


def profile_clusters(df: DataFrame, cluster: str, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """(cluster, size, share, feature, kind, strength, detail, position): what sets each group apart from everyone.

    Numbers by |z| of the group mean, labels by the lift of the group's commonest value; the four strongest each.
    """
    sizes = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("_total"), F.first(F.lit(1)).alias("_k"))
    sizes = sizes.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").select(
        "cluster", "size", "_total", ratio(F.col("size"), F.col("_total")).alias("share")
    )
    found = None
    if numeric:
        overall = per_column(df, numeric, lambda _, c: {"m": F.avg(c.cast("double")), "s": deviation(c.cast("double"))})
        local = per_column(df, numeric, lambda _, c: {"g": F.avg(c.cast("double"))}, by=[cluster])
        z = F.try_divide(F.col("g") - F.col("m"), F.nullif(F.col("s"), F.lit(0.0)))
        found = (
            local.join(F.broadcast(overall), "column")
            .withColumn("z", z)
            .where(F.abs("z") >= DISTINCTIVE_Z)
            .select(
                F.col(cluster).alias("cluster"), F.col("column").alias("feature"), F.lit("numeric").alias("kind"), F.abs("z").alias("strength"), F.when(F.col("z") > 0, "higher").otherwise("lower").alias("detail")
            )
        )
    if categorical:
        texts = df.select(F.col(cluster).alias("cluster"), *[F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in categorical])
        entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in categorical])
        local = texts.select("cluster", F.inline(entries)).groupBy("cluster", "column", "value").agg(F.count(F.lit(1)).alias("n"))
        top = local.groupBy("cluster", "column").agg(F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("t"))
        everyone = value_counts(texts, categorical).withColumnRenamed("n", "everyone")
        joined = top.select("cluster", "column", "t.value", "t.n").join(everyone, ["column", "value"]).join(F.broadcast(sizes), "cluster")
        lift = F.col("n") / F.col("size") - F.col("everyone") / F.col("_total")
        labels = joined.withColumn("lift", lift).where(F.col("lift") >= DISTINCTIVE_LIFT).select(
            "cluster", F.col("column").alias("feature"), F.lit("categorical").alias("kind"), F.col("lift").alias("strength"), F.col("value").alias("detail")
        )
        found = labels if found is None else found.unionByName(labels)
    order = Window.partitionBy("cluster").orderBy(F.col("strength").desc(), "feature")  # columns per cluster
    top = found.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= MAX_DISTINCTIVE)
    return sizes.drop("_total").join(top, "cluster", "left")


# ---- projection ----------------------------------------------------------------------------------


def pca_scatter(df: DataFrame, key: str, features: str = "features", k: int = 2) -> tuple[DataFrame, list[float]]:
    """(key, x, y) on the first two components, and their shares of the variance. Spark's PCA does not centre, so the mean is taken off first."""
    from pyspark.ml.stat import Summarizer

    mean = df.agg(Summarizer.mean(F.col(features)).alias("m")).first()["m"].toArray()
    centre = F.array(*[F.lit(float(v)) for v in mean])
    centred = df.withColumn("_c", array_to_vector(F.zip_with(vector_to_array(features), centre, lambda a, b: a - b)))
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    flat = vector_to_array("_p")
    out = model.transform(centred).select(*[c for c in df.columns if c != features], flat[0].alias("x"), flat[1].alias("y"))
    return out, [float(v) for v in model.explainedVariance]


def cluster_centres(scatter: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, x, y): where to write each group's name, the median of its points."""
    q = quantiles(scatter, ["x", "y"], [0.5], [cluster])
    return q.groupBy(cluster).agg(*[F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(c) for c in ("x", "y")])


def cluster_table(df: DataFrame, key: str, target: str | None = None, requested: str = "kmeans", seed: int = 42) -> dict[str, object]:
    """Choose columns, method and k, fit, and describe the groups, all over all rows."""
    rows = cluster_columns(df.drop(key), target).where("eligible").collect()
    numeric = [r["column"] for r in rows if r["kind"] == "numeric"]
    categorical = [r["column"] for r in rows if r["kind"] == "categorical"]
    if not rows:
        return {"skipped": "the table has neither numbers nor short labels to group by"}
    method, overridden = choose_method(requested, categorical)
    prepared = prepare_matrix(df, numeric, categorical)
    labels = [F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in categorical]
    everything = prepared.transform(df, [key])
    if method == "kprototypes":
        scaled = FittedRecipe([s for s in prepared.strategies if s.role == "numeric"])
        scaled.number_fill, scaled.scales = prepared.number_fill, prepared.scales
        scaled.lineage = [(n, s) for n, s in prepared.lineage if s in numeric]
        mixed = scaled.encode(df.select(key, *numeric), [key]).join(df.select(key, *labels), key).join(everything, key)

        def fit(frame, k):
            return kprototypes(frame, numeric, categorical, k, key, seed=seed).assign(frame).select(key, "cluster", vector_to_array("features").alias("features"))

        base = mixed
    else:

        def fit(frame, k):
            return kmeans(frame, k, seed).transform(frame).select(key, "cluster", vector_to_array("features").alias("features"))

        base = everything
    base = base.persist()
    k, scores = select_k(base, key, fit)
    if k is None:
        base.unpersist()
        return {"skipped": f"grouping needs at least {K_MIN * ROWS_PER_CLUSTER} rows"}
    labelled = fit(base, k).select(key, "cluster")
    profiles = profile_clusters(df.join(labelled, key), "cluster", numeric, categorical)
    best = scores.get(k, 0.0)
    return {"method": method, "overridden": overridden, "k": k, "silhouette": best, "weak": best < WEAK_SILHOUETTE, "silhouette_by_k": scores, "labels": labelled, "profiles": profiles}
