"""Attribution: how much each column pushed each prediction, and the tables a report shows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabsight.functions.columns import pearson, ratio
from tabsight.operators.ordinal import ordinal
from tabsight.session import pin
from tabsight.sources.tables import scratch_path

# Limits and thresholds.
TOP_FEATURES = 15
LOCAL_FEATURES = 10
BEESWARM_FEATURES = 10
DEAD_BAND = 0.3
DEPENDENCE_VALUES = 8
TOLERANCE = 1e-3
EXPLAINED_ROWS = 500
#: Leaves with so many features at most get a table of all patterns, worked out for many leaves at once.
TABLE_DEPTH = 10
#: Cells that a task explains together, since a leaf's table costs the same for one; numbers of cells sent to every task at most.
CELLS = 5000
BROADCAST_VALUES = 4_000_000


# ---- linear models -------------------------------------------------------------------------------


def linear_shap(encoded: DataFrame, features: Sequence[str], coefficients: Sequence[float], intercept: float, means: Sequence[float], keep: Sequence[str]) -> DataFrame:
    """(keep..., phi, base): phi = coefficient times the distance from the mean, one expression per feature."""
    phi = F.array(*[(F.col(f"`{n}`") - F.lit(float(m))) * F.lit(float(b)) for n, b, m in zip(features, coefficients, means)])
    base = float(intercept) + float(np.dot(coefficients, means))
    return encoded.select(*keep, phi.alias("phi"), F.lit(base).alias("base"))


def feature_means(encoded: DataFrame, features: Sequence[str]) -> list[float]:
    row = encoded.agg(*[F.avg(F.col(f"`{n}`")).alias(f"m{i}") for i, n in enumerate(features)]).first()
    return [row[f"m{i}"] or 0.0 for i in range(len(features))]


# ---- trees ---------------------------------------------------------------------------------------


def tree_paths(model, output: int = 0) -> list[tuple[float, list[tuple[int, float, list[tuple[float, bool]]]]]]:
    """Every leaf of a fitted Spark forest or boosted model as (value, [(feature, zero fraction, [(threshold, goes left)])]).

    Read from the node table the model saves: its size is the model's, not the data's.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    weights = list(getattr(model, "treeWeights", None) or [])
    boosted = type(model).__name__.startswith("GBT")
    trees: dict[int, dict[int, object]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    classifier = hasattr(model, "numClasses") and not boosted
    paths = []
    for tree_id, nodes in trees.items():
        scale = weights[tree_id] if boosted else 1.0 / len(trees)

        def leaf_value(node):
            if classifier:
                stats = list(node["impurityStats"])
                return stats[output] / sum(stats)
            return node["prediction"]

        stack = [(0, {})]
        while stack:
            node_id, seen = stack.pop()
            node = nodes[node_id]
            if node["leftChild"] < 0:
                paths.append((scale * leaf_value(node), [(f, z, rules) for f, (z, rules) in seen.items()]))
                continue
            feature = node["split"]["featureIndex"]
            threshold = node["split"]["leftCategoriesOrThreshold"][0]
            for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
                share = nodes[child]["rawCount"] / node["rawCount"]
                z, rules = seen.get(feature, (1.0, []))
                stack.append((child, {**seen, feature: (z * share, [*rules, (threshold, left)])}))
    return paths


def _shapley_weights(d: int) -> np.ndarray:
    return np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])


def _pattern_phi(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Shapley values of leaves of value 1: ``zero`` (leaves, d) fractions, ``one`` (patterns, d) of met conditions.

    A leaf's game is a product over its features, so the coalition sums are the coefficients of the product of all factors
    (zero + one t); a feature's own factor is divided out again, which leaves the coalitions without it.
    """
    leaves, d = zero.shape
    z, o = zero[:, None, :], one[None, :, :]
    product = np.zeros((leaves, len(one), d + 1))
    product[:, :, 0] = 1.0
    for i in range(d):
        moved = product[:, :, :-1] * o[:, :, i, None]
        product *= z[:, :, i, None]
        product[:, :, 1:] += moved
    weights = _shapley_weights(d)
    phi = np.empty((leaves, len(one), d))
    for j in range(d):
        with_j = o[:, :, j] > 0
        total = np.zeros((leaves, len(one)))
        rest = np.zeros((leaves, len(one)))
        for k in range(d - 1, -1, -1):
            rest = np.where(with_j, product[:, :, k + 1] - z[:, :, j] * rest, product[:, :, k] / np.maximum(z[:, :, j], 1e-300))
            total += weights[k] * rest
        phi[:, :, j] = (o[:, :, j] - z[:, :, j]) * total
    return phi


def _leaf_groups(paths) -> tuple[float, dict[int, tuple[np.ndarray, ...]]]:
    """The base value, and the leaves by number of features: values, features, zero fractions, and bounds (low, high]."""
    base, groups = 0.0, {}
    for value, parts in paths:
        base += value * float(np.prod([z for _, z, _ in parts]))
        if parts:
            low = [max([t for t, left in rules if not left], default=-np.inf) for _, _, rules in parts]
            high = [min([t for t, left in rules if left], default=np.inf) for _, _, rules in parts]
            groups.setdefault(len(parts), []).append((value, [f for f, _, _ in parts], [z for _, z, _ in parts], low, high))
    return base, {d: tuple(np.array([leaf[i] for leaf in g]) for i in range(5)) for d, g in groups.items()}


def _path_phi(x: np.ndarray, paths, width: int) -> tuple[np.ndarray, float]:
    """Path-dependent Shapley values of a batch. A row meets some of a leaf's conditions; the values of each such pattern are
    worked out once for a leaf and looked up for the rows."""
    base, groups = _leaf_groups(paths)
    phi = np.zeros((width, len(x)))
    columns = np.ascontiguousarray(x.T)
    for d, (values, features, zero, low, high) in groups.items():
        every = (np.arange(1 << min(d, TABLE_DEPTH))[:, None] >> np.arange(d) & 1).astype(float)
        step = max(1, (1 << 20) // (len(every) * (d + 1)))
        for start in range(0, len(values), step):
            table = _pattern_phi(zero[start : start + step], every) if d <= TABLE_DEPTH else None
            for i in range(start, min(start + step, len(values))):
                pattern = np.zeros(len(x), np.int64)
                for j, f in enumerate(features[i]):
                    pattern |= ((columns[f] > low[i, j]) & (columns[f] <= high[i, j])).astype(np.int64) << j
                if table is not None:
                    own = table[i - start]
                else:
                    met, pattern = np.unique(pattern, return_inverse=True)
                    own = _pattern_phi(zero[i : i + 1], (met[:, None] >> np.arange(d) & 1).astype(float))[0]
                for j, f in enumerate(features[i]):
                    phi[f] += values[i] * own[pattern, j]
    return phi.T, base


def _thresholds(paths, width: int) -> list[np.ndarray]:
    """Every threshold of the leaves by feature, in order."""
    found: list[set[float]] = [set() for _ in range(width)]
    for _, parts in paths:
        for feature, _, rules in parts:
            found[feature].update(t for t, _ in rules)
    return [np.array(sorted(f)) for f in found]


def _cells(x: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """(rows, features): how many thresholds are below a value, which settles all conditions on it; -1 for NaN, which meets none."""
    codes = np.empty(x.shape, np.int32)
    for f, t in enumerate(thresholds):
        codes[:, f] = np.where(np.isnan(x[:, f]), -1, np.searchsorted(t, x[:, f], side="left")) if len(t) else 0
    return codes


def _cell_values(codes: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """A value of each cell: the threshold above it, or infinity."""
    return np.column_stack([np.concatenate([t, [np.inf, np.nan]])[codes[:, f]] for f, t in enumerate(thresholds)])


def tree_shap(model, encoded: DataFrame, width: int, keep: Sequence[str], output: int = 0, features: str = "features") -> DataFrame:
    """(keep..., phi, base) for a fitted Spark tree model: path-dependent attribution (Lundberg et al., 2020).

    Forests are explained in probability (or value) space for class ``output``, boosted models as margins.
    The leaf table is broadcast. Rows between the same thresholds in every feature have the same values: each such cell is
    explained once, and the rows meet their cell in a join.
    """
    context = encoded.sparkSession.sparkContext
    paths = tree_paths(model, output)
    thresholds = _thresholds(paths, width)
    shared = context.broadcast(paths)
    source = encoded.select(*keep, vector_to_array(features).alias("_x"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema if f.name != "_x")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.vstack(b["_x"].to_numpy()) if len(b) else np.zeros((0, width))
            out = b.drop(columns="_x")
            out["_cell"] = pd.Series([c.tobytes() for c in _cells(x, thresholds)], index=out.index, dtype=object)
            yield out

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes = np.frombuffer(b"".join(b["_cell"]), np.int32).reshape(len(b), width)
            phi, base = _path_phi(_cell_values(codes, thresholds), shared.value, width)
            yield pd.DataFrame({"_of": b["_cell"].to_numpy(), "phi": pd.Series(list(phi), dtype=object), "base": base})

    placed = source.mapInPandas(place, f"{fields}_cell binary")
    # Pinned, so that a cell is explained once however often the result is read.
    cells = pin(source.select("_x").mapInPandas(place, "_cell binary").distinct())
    slices = max(1, min(-(-cells.count() // CELLS), int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    explained = pin(cells.repartition(slices, "_cell").mapInPandas(explain, "_of binary, phi array<double>, base double"))
    if cells.count() * width <= BROADCAST_VALUES:
        explained = F.broadcast(explained)
    return placed.join(explained, F.col("_cell") == F.col("_of")).select(*keep, "phi", "base")


# ---- tables over phi -----------------------------------------------------------------------------


def check_additivity(phi: DataFrame, raw: Column) -> DataFrame:
    """(max_error, tolerance, holds): base plus contributions against the model's own output."""
    total = F.col("base") + F.aggregate("phi", F.lit(0.0), lambda a, v: a + v)
    measured = phi.agg(F.max(F.abs(total - raw)).alias("max_error"), F.max(F.abs(raw)).alias("_m"))
    tolerance = F.greatest(F.lit(TOLERANCE), F.col("_m") * TOLERANCE)
    return measured.select("max_error", tolerance.alias("tolerance"), (F.col("max_error") <= tolerance).alias("holds"))


def long_phi(phi: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys..., encoded, phi)."""
    entries = F.array(*[F.struct(F.lit(n).alias("encoded"), F.col("phi")[i].alias("phi")) for i, n in enumerate(names)])
    return phi.select(*keys, F.inline(entries))


def to_source(long: DataFrame, lineage: DataFrame, keys: Sequence[str], classes: Sequence[str] = ()) -> DataFrame:
    """(keys..., source, phi): encoded contributions added up by the column they came from.

    With ``classes`` (columns telling outputs apart), importance must average |phi| over them first;
    see ``global_importance``. The lineage table has one row per encoded feature, so it is broadcast.
    """
    return long.join(F.broadcast(lineage), "encoded").groupBy(*keys, *classes, "source").agg(F.sum("phi").alias("phi"))


def global_importance(long: DataFrame, lineage: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    """(source, importance, share, encoded_features, position): mean |phi| per encoded feature, added up by source."""
    per_feature = long.groupBy("encoded").agg(F.avg(F.abs("phi")).alias("i"))
    by_source = per_feature.join(F.broadcast(lineage), "encoded").groupBy("source").agg(
        F.sum("i").alias("importance"), F.count(F.lit(1)).alias("encoded_features")
    )
    # one row per source column from here on
    everyone = Window.partitionBy(F.lit(1))
    order = everyone.orderBy(F.col("importance").desc(), "source")
    out = by_source.withColumn("share", F.coalesce(ratio(F.col("importance"), F.sum("importance").over(everyone)), F.lit(0.0)))
    return out.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= k)


def direction(values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(source, direction) of untouched numeric columns; ``values`` has a column and its ``phi_`` twin for each."""
    rows = F.array(*[F.struct(F.lit(c).alias("source"), pearson(F.col(c).cast("double"), F.col(f"phi_{c}")).alias("r")) for c in columns])
    r = F.col("r")
    text = F.when(r.isNull(), "").when(F.abs(r) < DEAD_BAND, "mixed").when(r > 0, "up").otherwise("down")
    return values.agg(rows.alias("_rows")).select(F.inline("_rows")).select("source", text.alias("direction"))


def representative_rows(predictions: DataFrame, key: str, task: str, classes: Sequence[str] = ()) -> DataFrame:
    """(reason, key): the surest row of each class, or the highest, lowest and middle prediction."""
    if task == "classification":
        shown = F.array(*[F.struct(F.lit(c).alias("reason"), F.col("probabilities")[i].alias("p")) for i, c in enumerate(classes)])
        first = predictions.select(key, F.inline(shown)).groupBy("reason", "p").agg(F.min(key).alias("k"))
        return first.groupBy("reason").agg(F.max_by("k", "p").alias(key))
    n = predictions.agg(F.count(F.lit(1)).alias("_n"), F.lit(1).alias("_k"))
    placed = ordinal(predictions.select(key, "pred"), ["pred", key], name="_i").withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k")
    reason = (
        F.when(F.col("_i") == F.col("_n"), "highest").when(F.col("_i") == 1, "lowest").when(F.col("_i") == F.floor(F.col("_n") / 2) + 1, "middle")
    )
    return placed.select(reason.alias("reason"), key).where(F.col("reason").isNotNull())


def explain_rows(source_phi: DataFrame, key: str, base: float | Column, k: int = LOCAL_FEATURES) -> DataFrame:
    """(key, position, source, phi, output): the strongest contributions of each row, the rest as one line.

    The window is over the columns of one row, so no group grows with the data.
    """
    base = base if isinstance(base, Column) else F.lit(float(base))
    row = Window.partitionBy(key)
    ranked = source_phi.withColumn("position", F.row_number().over(row.orderBy(F.abs("phi").desc(), "source")).cast("long")).withColumn(
        "output", base + F.sum("phi").over(row)
    )
    shown = F.col("position") <= k
    return ranked.groupBy(
        key, F.when(shown, F.col("position")).otherwise(k + 1).alias("position"), F.when(shown, F.col("source")).otherwise("(other)").alias("source"), "output"
    ).agg(F.sum("phi").alias("phi"))


def beeswarm(values: DataFrame, key: str, k: int = BEESWARM_FEATURES, small: bool | None = None) -> DataFrame:
    """(key, encoded, phi, shade): the strongest features, each value by its place in its own feature, 0 to 1.

    ``values`` is (key, encoded, value, phi). A constant feature sits in the middle.
    """
    strength = values.groupBy("encoded").agg(F.avg(F.abs("phi")).alias("i"), F.count(F.lit(1)).alias("_n"))
    top = strength.where(F.col("i") > 0).orderBy(F.col("i").desc(), "encoded").limit(k)
    kept = values.join(F.broadcast(top.select("encoded", "_n")), "encoded")
    placed = ordinal(kept, ["value", key], by=["encoded"], name="_i", small=small)
    shade = F.when(F.col("_n") < 2, 0.5).otherwise((F.col("_i") - 1) / F.nullif(F.col("_n") - 1, F.lit(0).cast("long")))
    return placed.select(key, "encoded", "phi", shade.alias("shade"))


def dependence(values: DataFrame, key: str) -> DataFrame:
    """(key, encoded, value, phi) of the strongest feature that takes at least eight values."""
    strength = values.groupBy("encoded").agg(F.avg(F.abs("phi")).alias("i"))
    distinct = values.groupBy("encoded", "value").agg(F.lit(1).alias("_o")).groupBy("encoded").agg(F.count(F.lit(1)).alias("values"))
    best = strength.where(F.col("i") > 0).join(distinct.where(F.col("values") >= DEPENDENCE_VALUES), "encoded")
    chosen = best.orderBy(F.col("i").desc(), "encoded").limit(1).select("encoded")
    return values.join(F.broadcast(chosen), "encoded").select(key, "encoded", "value", "phi")
