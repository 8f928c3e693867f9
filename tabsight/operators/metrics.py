"""Scores over a predictions table (fold, y, pred, score or probabilities), in long form."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import median

from pyspark.sql import Column, DataFrame, functions as F

from tabsight.functions.columns import ratio, variance
from tabsight.operators.ordinal import quantiles, running_total

# Thresholds.
FOLD_GAP = 0.05
DOMINANT_SHARE = 0.5
DOMINANT_ROWS = 0.05
TAIL_RATIO = 1.5
STABLE, MODERATE = 0.02, 0.08
PRIMARY = {"classification": "f1_macro", "regression": "r2"}
#: Scores of a numeric target; those of the second group need an exact median each.
REGRESSION = ("mae", "median_ae", "mse", "rmse", "r2", "median_ape")
MEDIANS = {"median_ae": "_a", "median_ape": "_r"}


def _long(df: DataFrame, keys: Sequence[str], metrics: dict[str, Column], reasons: dict[str, Column] | None = None) -> DataFrame:
    reasons = reasons or {}
    rows = [
        F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"), reasons.get(k, F.lit(None)).cast("string").alias("reason"))
        for k, v in metrics.items()
    ]
    return df.select(*keys, F.inline(F.array(*rows)))


# ---- classification ------------------------------------------------------------------------------


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro precision, recall and F1. One pass over the rows; everything else happens on the
    confusion counts, whose size is the square of the number of classes."""
    counts = confusion(df, y, pred, by)
    sides = counts.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("y").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")),
            )
        ),
    )
    classes = sides.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hit")])
    zero = F.lit(0.0)
    precision = F.coalesce(ratio(F.col("hit"), F.col("predicted")), zero)
    recall = F.coalesce(ratio(F.col("hit"), F.col("actual")), zero)
    f1 = F.coalesce(ratio(F.col("hit") * 2, F.col("actual") + F.col("predicted")), zero)
    wide = classes.groupBy(*by).agg(
        ratio(F.sum("hit"), F.sum("actual")).alias("accuracy"),
        F.avg(precision).alias("precision_macro"),
        F.avg(recall).alias("recall_macro"),
        F.avg(f1).alias("f1_macro"),
    )
    return _long(wide, by, {m: F.col(m) for m in ("accuracy", "precision_macro", "recall_macro", "f1_macro")})


def ranking_metrics(df: DataFrame, positive: Column, score: Column, by: Sequence[str] = (), small: bool | None = None) -> DataFrame:
    """Exact ROC-AUC (ties count half) and step-wise average precision.

    Rows collapse to one per distinct score before anything is ordered. One-class groups get no value but a reason.
    """
    graded = df.select(*by, score.cast("double").alias("_s"), positive.cast("long").alias("_p"))
    steps = graded.groupBy(*by, "_s").agg(F.sum("_p").alias("pos"), (F.count(F.lit(1)) - F.sum("_p")).alias("neg"))
    steps = running_total(steps, [F.col("_s").desc()], {"tp": "pos", "fp": "neg"}, by, small)
    totals = steps.groupBy(*by).agg(
        F.sum("pos").alias("P"),
        F.sum("neg").alias("N"),
        # positives ranked above each group of negatives, ties at half
        F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2.0)).alias("above"),
        F.sum(F.col("pos").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("steps"),
    )
    undefined = F.when((F.col("P") == 0) | (F.col("N") == 0), "only one class is present")
    no_positive = F.when(F.col("P") == 0, "no positive row is present")
    return _long(
        totals,
        by,
        {
            "roc_auc": F.when(undefined.isNull(), F.try_divide(F.col("above"), F.col("P").cast("double") * F.col("N"))),
            "pr_auc": F.when(no_positive.isNull(), F.try_divide(F.col("steps"), F.col("P").cast("double"))),
        },
        {"roc_auc": undefined, "pr_auc": no_positive},
    )


def multiclass_auc(df: DataFrame, y: str, probabilities: str, classes: Sequence[str], by: Sequence[str] = (), small: bool | None = None) -> DataFrame:
    """One-vs-rest ROC-AUC averaged over classes; ``probabilities`` is an array in class order."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("class"), F.col(probabilities)[i].alias("score"), (F.col(y) == F.lit(c)).alias("hit")) for i, c in enumerate(classes)]
    )
    long = df.select(*by, F.inline(entries))
    per_class = ranking_metrics(long, F.col("hit"), F.col("score"), [*by, "class"], small).where("metric = 'roc_auc'")
    wide = per_class.groupBy(*by).agg(F.avg("value").alias("v"), F.count_if(F.col("value").isNull()).alias("gaps"))
    reason = F.when(F.col("gaps") > 0, "a class is missing from the held-out rows")
    return _long(wide, by, {"roc_auc": F.when(F.col("gaps") == 0, F.col("v"))}, {"roc_auc": reason})


# ---- regression ----------------------------------------------------------------------------------


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = (), metrics: Sequence[str] = REGRESSION) -> DataFrame:
    """MAE, median AE, MSE, RMSE, R2 and median absolute percentage error (rows with y = 0 left out), or those of
    them that ``metrics`` names. Medians are worked out only where wanted; the others are one aggregate."""
    truth, guess = F.col(y).cast("double"), F.col(pred).cast("double")
    base = df.select(
        *by,
        truth.alias("_y"),
        (truth - guess).alias("_e"),
        F.abs(truth - guess).alias("_a"),
        F.when(truth != 0, F.abs(truth - guess) / F.abs(truth)).alias("_r"),
    )
    wide = base.groupBy(*by).agg(
        F.avg("_a").alias("mae"),
        F.avg(F.col("_e") * F.col("_e")).alias("mse"),
        variance(F.col("_y")).alias("_v"),
        F.count_if(F.col("_y") == 0).alias("_zeros"),
        F.count("_r").alias("_usable"),
    )
    medians = [m for m in MEDIANS if m in metrics]
    if medians:
        middle = quantiles(base, [MEDIANS[m] for m in medians], [0.5], by)
        middle = middle.groupBy(*by).agg(*[F.max(F.when(F.col("column") == MEDIANS[m], F.col("q")[0])).alias(m) for m in medians])
        if by:
            wide = wide.join(middle, list(by))
        else:
            wide = wide.withColumn("_k", F.lit(1)).join(middle.withColumn("_k", F.lit(1)), "_k").drop("_k")
    values = {
        "mae": F.col("mae"),
        "mse": F.col("mse"),
        "rmse": F.sqrt("mse"),
        "r2": 1 - F.try_divide(F.col("mse"), F.nullif(F.col("_v"), F.lit(0.0))),
        **{m: F.col(m) for m in medians},
    }
    reasons = {
        "median_ape": F.when(F.col("_usable") == 0, "every true value is zero").when(F.col("_zeros") > 0, "rows with a true value of zero are left out"),
        "r2": F.when(F.col("_v") == 0, "the true values do not vary"),
    }
    return _long(wide, by, {m: values[m] for m in REGRESSION if m in metrics}, reasons)


# ---- over folds ----------------------------------------------------------------------------------


def fold_sizes(df: DataFrame, fold: str = "fold") -> DataFrame:
    """(fold, n_train, n_test) of random folds: everything outside a fold trains it."""
    counts = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n_test"))
    total = counts.agg(F.sum("n_test").alias("_total"), F.first(F.lit(1)).alias("_k"))
    return counts.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").select(fold, (F.col("_total") - F.col("n_test")).alias("n_train"), "n_test")


def summarise_folds(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population std of each metric over the folds that have it."""
    return (
        scores.where(F.col("value").isNotNull())
        .groupBy(*by, "metric")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("folds"))
    )


def spread_note(summary: DataFrame) -> DataFrame:
    proportion = F.col("metric").isin("accuracy", "precision_macro", "recall_macro", "f1_macro", "roc_auc", "pr_auc", "r2")
    band = F.when(~proportion, "spread only").when(F.col("std") < STABLE, "stable").when(F.col("std") < MODERATE, "moderate").otherwise("wide")
    return summary.withColumn("band", band)


def error_shape(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Whether few rows own most of the error: RMSE against MAE, and MAE against the median."""
    wide = summary.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == m, F.col("mean"))).alias(m) for m in ("mae", "rmse", "median_ae")])
    return wide.where(F.col("mae") > 0).select(
        *by,
        ratio(F.col("rmse"), F.col("mae")).alias("rmse_to_mae"),
        ratio(F.col("mae"), F.col("median_ae")).alias("mae_to_median"),
        (F.col("rmse") / F.col("mae") >= TAIL_RATIO).alias("tail_dominated"),
        F.coalesce(F.try_divide(F.col("mae"), F.col("median_ae")) >= TAIL_RATIO, F.lit(False)).alias("typical_is_better"),
    )


def concentrated_error(df: DataFrame, key: Sequence[str], y: str = "y", pred: str = "pred", fold: str = "fold", small: bool | None = None) -> DataFrame:
    """The worst fold by R2 when it is well below the others and a few of its rows own half its squared error.

    Fold scores are a handful of rows on the driver; the running share of squared error inside the worst
    fold is a distributed running total.
    """
    empty = "fold long, score double, middle_score double, scored_rows long, heavy_rows long, heavy_share double, score_without_heavy double"
    scores = {r[fold]: r["value"] for r in regression_metrics(df, y, pred, [fold], ["r2"]).collect()}
    spark = df.sparkSession
    if len(scores) < 3 or any(v is None for v in scores.values()):
        return spark.createDataFrame([], empty)
    worst = min(scores, key=lambda f: (scores[f], f))
    middle = median(v for f, v in scores.items() if f != worst)
    if middle - scores[worst] < FOLD_GAP:
        return spark.createDataFrame([], empty)
    error = F.col(y).cast("double") - F.col(pred)
    rows = df.where(F.col(fold) == worst).select(*key, F.col(y).cast("double").alias("_y"), (error * error).alias("_e2"))
    ranked = running_total(rows, [F.col("_e2").desc(), *key], {"_cum": "_e2", "_rank": F.lit(1).cast("long")}, small=small)
    total = rows.agg(F.sum("_e2").alias("_total"), F.count(F.lit(1)).alias("_n"), F.lit(1).alias("_k"))
    shared = ranked.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k")
    # a row is dominant while the rows before it hold less than the share
    dominant = (F.col("_cum") - F.col("_e2")) / F.col("_total") < DOMINANT_SHARE
    kept_y, kept_e = F.when(~dominant, F.col("_y")), F.when(~dominant, F.col("_e2"))
    found = shared.groupBy("_n").agg(
        F.count_if(dominant).alias("heavy_rows"),
        (F.max(F.when(dominant, F.col("_cum"))) / F.first("_total")).alias("heavy_share"),
        F.when(F.count(kept_y) >= 2, 1 - F.try_divide(F.avg(kept_e), F.nullif(variance(kept_y), F.lit(0.0)))).alias("score_without_heavy"),
    )
    limit = F.greatest(F.lit(1), F.floor(F.col("_n") * DOMINANT_ROWS))
    return found.where(F.col("heavy_rows") <= limit).select(
        F.lit(worst).cast("long").alias("fold"),
        F.lit(scores[worst]).alias("score"),
        F.lit(middle).alias("middle_score"),
        F.col("_n").alias("scored_rows"),
        "heavy_rows",
        "heavy_share",
        "score_without_heavy",
    )
