"""The model roster, leakage-safe cross-validation, the leaderboard and the final fit."""

from __future__ import annotations

import json
import logging
from collections import Counter
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabsight.functions.columns import named, ratio
from tabsight.functions.frames import per_column
from tabsight.operators import metrics as M
from tabsight.operators.ordinal import SKETCH_ACCURACY, quantiles
from tabsight.operators.recipe import FittedRecipe, Recipe
from tabsight.operators.resample import smote
from tabsight.operators.strategy import ColumnStrategy
from tabsight.operators.target import choose_target_transform, from_model_scale, to_model_scale
from tabsight.operators.text import TextTopics
from tabsight.session import pin, spread
from tabsight.sources.tables import scratch_path

log = logging.getLogger(__name__)

BASELINE = "Baseline"

#: Up to so many rows Spark takes the thresholds of trees from all rows, beyond from a sample; there boosting goes over cells.
CELL_ROWS = 10_000
#: Ranks looked up for each bin.
FINE = 32


@dataclass(frozen=True)
class Candidate:
    """One roster entry. ``make(n_rows, n_classes, redundant)`` builds an unfitted Spark ML estimator; None is the
    baseline. ``redundant`` says that encoded features add up to a constant, as full one-hot sets do."""

    name: str
    make: object = None

    @property
    def is_baseline(self) -> bool:
        return self.make is None


def _boosted_classifier(rounds: int, depth: int, seed: int):
    def make(_, classes, __):
        gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed)
        return gbt if classes == 2 else OneVsRest(classifier=gbt, parallelism=2)

    return make


def roster(task: str, trees: int = 100, depth: int = 12, rounds: int = 100, seed: int = 42) -> list[Candidate]:
    """Forest, linear model, boosted trees and the featureless baseline. Any other Spark ML estimator can be added."""
    if task == "classification":
        return [
            Candidate("Random forest", lambda n, c, r: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)),
            Candidate(
                "Logistic regression",
                lambda n, c, r: LogisticRegression(
                    maxIter=1000, regParam=1.0 / max(n, 1), standardization=False, family="binomial" if c == 2 else "multinomial"
                ),
            ),
            Candidate("Gradient-boosted trees", _boosted_classifier(rounds, 5, seed)),
            Candidate(BASELINE),
        ]
    return [
        Candidate("Random forest", lambda n, c, r: RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed)),
        # with redundant features plain least squares has many solutions; a trace of ridge picks the smallest
        Candidate("Linear regression", lambda n, c, r: LinearRegression(regParam=1e-10 if r else 0.0)),
        Candidate("Gradient-boosted trees", lambda n, c, r: GBTRegressor(maxIter=rounds, maxDepth=5, seed=seed)),
        Candidate(BASELINE),
    ]


# ---- labels and the baseline ---------------------------------------------------------------------


#: More distinct target values than this are no classes: the caller meant a number, or has to group them.
MAX_CLASSES = 1000


class TooManyClasses(ValueError):
    """The target has too many distinct values to be classified."""


def class_labels(df: DataFrame, target: str) -> list[str]:
    """Class names in alphabetical order; as many rows as there are classes reach the driver, never one more than allowed."""
    values = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("v")).distinct()
    rows = values.limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise TooManyClasses(f"{target!r} has over {MAX_CLASSES} distinct values")
    return sorted(r["v"] for r in rows)


def encode_label(c: Column, labels: Sequence[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(v) for v in labels]), c.cast("string")) - 1).cast("double")


def decode_label(index: Column, labels: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in labels]), index.cast("int"))


def label_table(df: DataFrame, target: str) -> DataFrame:
    """(label, index) in alphabetical order."""
    labels = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("label")).distinct()
    return labels.withColumn("index", F.row_number().over(Window.orderBy("label")) - 1)  # one row per class


def baseline(df: DataFrame, target: str, task: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., prediction): the commonest class (ties by name), or the median."""
    if task == "classification":
        counts = df.where(F.col(target).isNotNull()).groupBy(*by, F.col(target).cast("string").alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
        best = F.min_by("_y", F.struct(-F.col("_n"), F.col("_y")))
        return counts.groupBy(*by).agg(best.alias("prediction"))
    return quantiles(df, [target], [0.5], by).select(*by, F.col("q")[0].alias("prediction"))


# ---- one fitted model ----------------------------------------------------------------------------


@dataclass
class FittedModel:
    """A fitted recipe and estimator. ``predict`` is a narrow plan."""

    recipe: FittedRecipe | None
    model: object
    task: str
    labels: list[str] = field(default_factory=list)
    use_log: bool = False
    constant: object = None
    shares: list[float] = field(default_factory=list)

    def predict(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """keep..., pred, and ``probabilities`` (array in label order) for a classifier."""
        if self.model is None:
            out = df.select(*keep, F.lit(self.constant).alias("pred"))
            if self.task == "classification":
                out = out.withColumn("probabilities", F.array(*[F.lit(float(s)) for s in self.shares]))
            return out
        return self.score(self.recipe.transform(df, keep), keep)

    def score(self, encoded: DataFrame, keep: Sequence[str]) -> DataFrame:
        scored = self.model.transform(encoded)
        if self.task == "regression":
            raw = F.col("prediction")
            return scored.select(*keep, (from_model_scale(raw) if self.use_log else raw).alias("pred"))
        if "probability" in scored.columns:
            p = vector_to_array("probability")
        else:
            # one-vs-rest margins, squashed and normalised
            margins = F.transform(vector_to_array("rawPrediction"), lambda v: 1 / (1 + F.exp(-2 * v)))
            total = F.aggregate(margins, F.lit(0.0), lambda a, v: a + v)
            p = F.transform(margins, lambda v: v / total)
        return scored.select(*keep, decode_label(F.col("prediction"), self.labels).alias("pred"), p.alias("probabilities"))

    # ---- persistence -----------------------------------------------------------------------------

    def save(self, spark, path: str) -> None:
        path = path.rstrip("/")
        state = {
            "task": self.task,
            "labels": self.labels,
            "use_log": self.use_log,
            "strategies": [s.__dict__ for s in self.recipe.strategies],
            "label_fill": self.recipe.label_fill,
            "vocabularies": self.recipe.vocabularies,
            "number_fill": self.recipe.number_fill,
            "scales": self.recipe.scales,
            "lineage": self.recipe.lineage,
            "selected": self.recipe.selected,
            "frequencies": list(self.recipe.frequencies),
            "texts": {c: t.kind for c, t in self.recipe.texts.items()},
        }
        spark.createDataFrame([(json.dumps(state),)], "state string").write.mode("overwrite").json(f"{path}/state")
        for i, table in enumerate(self.recipe.frequencies.values()):
            table.write.mode("overwrite").parquet(f"{path}/frequency_{i}")
        for i, t in enumerate(self.recipe.texts.values()):
            rows = [(w, float(t.idf[j]), [] if t.topics is None else [float(v) for v in t.topics[j]]) for j, w in enumerate(t.words)]
            spark.createDataFrame(rows, "term string, idf double, topics array<double>").write.mode("overwrite").parquet(f"{path}/text_{i}")
        PipelineModel([self.model]).write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark, path: str) -> FittedModel:
        path = path.rstrip("/")
        state = json.loads(spark.read.json(f"{path}/state").first()["state"])
        strategies = [ColumnStrategy(**{**s, "order": tuple(s["order"])}) for s in state["strategies"]]
        recipe = FittedRecipe(strategies, state["label_fill"], state["vocabularies"])
        recipe.number_fill = state["number_fill"]
        recipe.scales = {k: tuple(v) for k, v in state["scales"].items()}
        recipe.lineage = [tuple(p) for p in state["lineage"]]
        recipe.selected = state["selected"]
        recipe.frequencies = {c: spark.read.parquet(f"{path}/frequency_{i}") for i, c in enumerate(state["frequencies"])}
        for i, (c, kind) in enumerate(state["texts"].items()):
            rows = spark.read.parquet(f"{path}/text_{i}").orderBy("term").collect()
            topics = None if kind == "term" else np.array([r["topics"] for r in rows])
            recipe.texts[c] = TextTopics([r["term"] for r in rows], np.array([r["idf"] for r in rows]), topics, kind)
        model = PipelineModel.load(f"{path}/model")
        return cls(recipe, model, state["task"], state["labels"], state["use_log"])


def _use_log(train: DataFrame, target: str, task: str) -> bool:
    return task == "regression" and bool(choose_target_transform(train, target).first()["use_log"])


def _thresholds(values: DataFrame, bins: int) -> list[list[float]]:
    """Thresholds of each column of ``values`` into ``bins`` bins at most, from all rows: between all values of a column that
    has so few, else after values with a bin's share of the rows and at evenly spaced ranks of the others, by a sketch."""
    names = values.columns
    ranks = F.array(*[F.lit(k / (bins * FINE)) for k in range(1, bins * FINE)])

    def spaced(found: Sequence[float], top: float) -> list[float]:
        held = Counter(q for q in found if q < top)
        heavy = {q for q, n in held.items() if n >= FINE}
        rest, room = sorted(set(held) - heavy), bins - 1 - len(heavy)
        if len(rest) > room:
            rest = [rest[k * (len(rest) + 1) // (room + 1) - 1] for k in range(1, room + 1)]
        return sorted(heavy | set(rest))

    rows = per_column(values, names, lambda _, c: {"q": F.percentile_approx(c, ranks, SKETCH_ACCURACY), "top": F.max(c), "distinct": F.approx_count_distinct(c, 0.05)}).collect()
    few = [r["column"] for r in rows if r["distinct"] <= 2 * bins]
    # a set of little more than the estimate, which is within some standard errors of 5 %
    sets = per_column(values, few, lambda _, c: {"s": F.array_sort(F.collect_set(c))}).collect() if few else []
    exact = {r["column"]: r["s"] for r in sets if len(r["s"]) <= bins}
    out = {r["column"]: spaced(r["q"] or [], r["top"]) for r in rows}
    out |= {c: [a + (b - a) / 2 for a, b in zip(s, s[1:])] for c, s in exact.items()}
    return [out[c] for c in names]


def _fit_boosted(estimator: GBTClassifier | GBTRegressor, encoded: DataFrame, width: int):
    """``estimator`` fitted on cells: rows that no threshold tells apart (and of one class) are one row with their mean label,
    weighted by their number.

    Splits of least squares depend on sums of labels and weights only, and the loss's gradient is the same in a cell, so the
    trees are those of the rows, up to rounding. A round then costs cells, which bins and features bound, not rows.
    """
    names = [f"x{i}" for i in range(width)]
    values = encoded.select("label", *[vector_to_array("features")[i].alias(n) for i, n in enumerate(names)])
    thresholds = _thresholds(values.select(*names), estimator.getMaxBins())
    cut = [(n, t) for n, t in zip(names, thresholds) if t]
    binned = values
    if cut:
        # a bucket begins with its lower bound, a tree's right side after its threshold
        splits = [[-np.inf, *[float(np.nextafter(v, np.inf)) for v in t], np.inf] for _, t in cut]
        binned = Bucketizer(splitsArray=splits, inputCols=[n for n, _ in cut], outputCols=[f"b_{n}" for n, _ in cut], handleInvalid="keep").transform(values)
    # bins begin at one: Spark leaves zeros out where it looks for thresholds
    place = {n: F.col(f"b_{n}") + 1 for n, _ in cut}
    keys = [place.get(n, F.lit(1.0)).alias(n) for n in names]
    if isinstance(estimator, GBTClassifier):
        cells = binned.groupBy(*keys, "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    else:
        whole = F.when(F.count("label") == F.count(F.lit(1)), F.avg("label"))  # a missing label stays an error
        cells = binned.groupBy(*keys).agg(whole.alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    cells = spread(cells.select(array_to_vector(F.array(*names)).alias("features"), "label", "weight")).persist()
    bins = estimator.getMaxBins() + 2
    model = estimator.copy().setWeightCol("weight").setMaxBins(bins).fit(cells)
    cells.unpersist()
    return _on_values(model, thresholds, encoded.sparkSession)


def _on_values(model, thresholds: list[list[float]], spark):
    """A model of bins as one of values: its saved nodes, as many as the model has, get the thresholds between the bins and
    numbers of rows in place of cells."""
    path = scratch_path(spark, "boosted")
    model.write().save(path)
    nodes = pin(spark.read.parquet(f"{path}/data"))
    table = F.array(*[F.array(*[F.lit(float(v)) for v in t]).cast("array<double>") for t in thresholds])
    own = F.get(table, F.col("nodeData.split.featureIndex"))
    value = lambda bin_: F.coalesce(F.get(own, F.floor(bin_).cast("int") - 1), F.lit(float("inf")))
    split = F.col("nodeData.split").withField("leftCategoriesOrThreshold", F.transform("nodeData.split.leftCategoriesOrThreshold", value))
    rows = F.round(F.col("nodeData.impurityStats")[0]).cast("long")
    data = F.col("nodeData").withField("split", split).withField("rawCount", rows)
    nodes.withColumn("nodeData", data).write.mode("overwrite").parquet(f"{path}/data")
    return type(model).load(path)


def _fit_candidate(candidate: Candidate, recipe: FittedRecipe, encoded: DataFrame, n: int, labels: list[str]):
    redundant = any(s.encode == "onehot" for s in recipe.strategies)
    estimator, rows = candidate.make(n, len(labels), redundant), encoded.select("features", "label")
    if n > CELL_ROWS and isinstance(estimator, (GBTClassifier, GBTRegressor)) and estimator.getSubsamplingRate() == 1:
        return _fit_boosted(estimator, rows, len(recipe.names))
    return estimator.fit(rows)


def _prepare(train: DataFrame, recipe: Recipe, target: str, task: str, key: str, resample: bool, seed: int, fitted: FittedRecipe | None = None):
    """Everything learned from training rows: recipe, label order, target scale and (optionally) new minority rows."""
    fitted = fitted or recipe.fit(train)
    use_log = _use_log(train, target, task)
    labels = class_labels(train, target) if task == "classification" else []
    encoded = fitted.transform(train, [key, target])
    if resample:
        arrays = encoded.select(key, F.col(target).cast("string").alias(target), vector_to_array("features").alias("features"))
        encoded = smote(arrays, key, target, seed=seed).select(target, array_to_vector("features").alias("features"))
    y = F.col(target)
    label = encode_label(y, labels) if task == "classification" else (to_model_scale(y.cast("double")) if use_log else y.cast("double"))
    return fitted, use_log, labels, encoded.select("features", label.alias("label"))


def _fit_baseline(train: DataFrame, target: str, task: str, labels: list[str]) -> FittedModel:
    value = baseline(train, target, task).first()["prediction"]
    shares = []
    if task == "classification":
        sizes = train.groupBy(F.col(target).cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        counts = {r["_v"]: r["_c"] for r in sizes.collect()}  # one row per class
        shares = [counts[v] / sum(counts[x] for x in labels) for v in labels]
    return FittedModel(None, None, task, labels, constant=value, shares=shares)


def cross_validate(
    df: DataFrame,
    recipe: Recipe,
    target: str,
    task: str,
    key: str,
    candidates: Sequence[Candidate] | None = None,
    folds: Sequence[int] | None = None,
    resample: bool = False,
    parallel: int = 4,
    parallel_folds: int = 4,
    seed: int = 42,
) -> tuple[DataFrame, dict[str, str]]:
    """Held-out predictions (model, fold, key, y, pred[, probabilities]) and the error of each failed candidate.

    ``df`` has a ``fold`` column, or (fold, role) rows for time-ordered folds. All candidates share the splits.
    Recipes of all folds are fitted together, each from its training rows only (time-ordered folds one by one). A fold's encoded rows are persisted while the
    candidates train on them, as concurrent Spark jobs. Predictions are checkpointed as they are made, so the
    result does not carry the plans of every fold. A candidate that fails is recorded and the others go on.
    """
    candidates = list(candidates or roster(task))
    df = df.persist()
    timed = "role" in df.columns
    folds = list(folds) if folds is not None else sorted(r["fold"] for r in df.select("fold").distinct().collect())
    errors: dict[str, str] = {}
    recipes: dict[int, FittedRecipe] = {}
    if not timed:
        try:
            recipes = recipe.fit_folds(df, folds)
        except Exception as error:  # noqa: BLE001 - folds are then fitted one by one, so that only the failing one is lost
            log.warning("folds could not be fitted together: %s", error)

    def attempt(candidate: Candidate, fold: int, train: DataFrame, held_out: DataFrame, encoded: DataFrame, n: int, parts) -> DataFrame | None:
        fitted, use_log, labels = parts
        try:
            if candidate.is_baseline:
                model = _fit_baseline(train, target, task, labels)
                scored = model.predict(held_out, [key, target])
            else:
                model = FittedModel(fitted, _fit_candidate(candidate, fitted, encoded, n, labels), task, labels, use_log)
                scored = model.score(held_out, [key, target])
            y = F.col(target).cast("string" if task == "classification" else "double")
            rest = ["pred"] + (["probabilities"] if task == "classification" else [])
            return pin(scored.select(F.lit(candidate.name).alias("model"), F.lit(int(fold)).cast("long").alias("fold"), key, y.alias("y"), *rest))
        except Exception as error:  # noqa: BLE001 - a failing candidate becomes its leaderboard row
            log.warning("%s failed on fold %s: %s", candidate.name, fold, error)
            errors[candidate.name] = str(error).splitlines()[0][:200]
            return None

    def run_fold(fold: int) -> list[DataFrame]:
        if timed:
            train = df.where((F.col("fold") == fold) & (F.col("role") == "train"))
            test = df.where((F.col("fold") == fold) & (F.col("role") == "test"))
        else:
            train, test = df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)
        try:
            fitted, use_log, labels, encoded = _prepare(train, recipe, target, task, key, resample, seed, recipes.get(fold))
        except Exception as error:  # noqa: BLE001 - no candidate can be trained on a fold that cannot be prepared
            log.warning("fold %s could not be prepared: %s", fold, error)
            for c in candidates:
                errors.setdefault(c.name, str(error).splitlines()[0][:200])
            return []
        encoded = encoded.persist()
        held_out = fitted.transform(test, [key, target]).persist()
        n = encoded.count()
        with ThreadPoolExecutor(parallel) as pool:
            parts = (fitted, use_log, labels)
            made = list(pool.map(lambda c: attempt(c, fold, train, held_out, encoded, n, parts), candidates))
        encoded.unpersist()
        held_out.unpersist()
        return [p for p in made if p is not None]

    with ThreadPoolExecutor(parallel_folds) as pool:
        results = [p for made in pool.map(run_fold, folds) for p in made]
    df.unpersist()
    if not results:
        raise ValueError("no model could be trained: " + "; ".join(errors.values()))
    out = results[0]
    for p in results[1:]:
        out = out.unionByName(p)
    return out.where(~F.col("model").isin(list(errors))) if errors else out, errors


def fold_scores(predictions: DataFrame, task: str, labels: Sequence[str] = ()) -> DataFrame:
    """(model, fold, metric, value, reason) of a predictions table."""
    by = ["model", "fold"]
    if task == "regression":
        return M.regression_metrics(predictions, by=by)
    out = M.classification_metrics(predictions, by=by)
    if len(labels) == 2:
        return out.unionByName(M.ranking_metrics(predictions, F.col("y") == labels[1], F.col("probabilities")[1], by))
    return out.unionByName(M.multiclass_auc(predictions, "y", "probabilities", labels, by)) if len(labels) > 2 else out


# ---- leaderboard ---------------------------------------------------------------------------------


def rank_leaderboard(scores: DataFrame, metric: str, errors: dict[str, str] | None = None) -> DataFrame:
    """(rank, model, score, std, is_baseline, is_winner, error): best mean first, failures and NaN last."""
    board = (
        scores.where(F.col("metric") == metric)
        .groupBy("model")
        .agg(F.avg("value").alias("score"), F.stddev_pop("value").alias("std"))
        .withColumn("error", F.lit(""))
    )
    if errors:
        failed = scores.sparkSession.createDataFrame([(m, None, None, e) for m, e in errors.items()], "model string, score double, std double, error string")
        board = board.unionByName(failed)
    board = board.withColumn("score", F.when(~F.isnan("score"), F.col("score"))).withColumn("is_baseline", F.col("model") == BASELINE)
    # one row per model: these windows are tiny by construction
    order = Window.orderBy((F.col("error") != ""), F.col("score").desc_nulls_last(), "model")
    ranked = board.withColumn("rank", F.row_number().over(order).cast("long"))
    eligible = ~F.col("is_baseline") & (F.col("error") == "")
    first = F.min(F.when(eligible, F.col("rank"))).over(Window.partitionBy(F.lit(1)))
    return ranked.withColumn("is_winner", F.coalesce(F.col("rank") == first, F.lit(False)))


def baseline_verdict(board: DataFrame) -> DataFrame:
    """(gap, verdict) of the winner against the baseline; no row when the baseline is comfortably beaten."""
    sides = board.agg(
        F.max(F.when(F.col("is_winner"), F.col("score"))).alias("best"),
        F.max(F.when(F.col("is_winner"), F.col("std"))).alias("spread"),
        F.max(F.when(F.col("is_baseline") & (F.col("error") == ""), F.col("score"))).alias("floor"),
    )
    gap = F.col("best") - F.col("floor")
    verdict = F.when(gap <= 0, "not beaten").when(gap < F.col("spread"), "unproven")
    return sides.select(gap.alias("gap"), verdict.alias("verdict")).where(F.col("verdict").isNotNull())


# ---- final fit -----------------------------------------------------------------------------------


def fit_final(df: DataFrame, recipe: Recipe, candidate: Candidate, target: str, task: str, key: str, resample: bool = False, seed: int = 42) -> FittedModel:
    """The winning recipe and estimator on all rows, with the target scale the ranking used. No score is measured here."""
    fitted, use_log, labels, encoded = _prepare(df, recipe, target, task, key, resample, seed)
    encoded = encoded.persist()
    model = _fit_candidate(candidate, fitted, encoded, encoded.count(), labels)
    encoded.unpersist()
    return FittedModel(fitted, model, task, labels, use_log)


def model_card(df: DataFrame, strategies: Sequence[ColumnStrategy], key: str, target: str) -> DataFrame:
    """(ordinal, column, dtype, role, used, example) of every input column, example from the first row that has a value."""
    from tabsight.operators.profile import _dtype

    chosen = {s.column: s for s in strategies}
    columns = [c for c in df.columns if c not in (key, target)]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("ordinal"),
                F.lit(c).alias("column"),
                F.lit(_dtype(df.schema[c].dataType)).alias("dtype"),
                F.lit(chosen[c].role if c in chosen else "numeric").alias("role"),
                F.lit(c not in chosen or chosen[c].role != "drop").alias("used"),
                F.coalesce(F.min_by(named(c).cast("string"), F.when(named(c).isNotNull(), F.col(key))), F.lit("")).alias("example"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return df.agg(rows.alias("_rows")).select(F.inline("_rows"))


def class_shares(predictions: DataFrame) -> DataFrame:
    counts = predictions.groupBy("pred").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))  # one row per class
