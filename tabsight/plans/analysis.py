"""The whole analysis of one table, from typed rows to a fitted model and its report tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tabsight.operators import clean as C
from tabsight.operators import eda as E
from tabsight.operators import explain as J
from tabsight.operators import metrics as M
from tabsight.operators import models as H
from tabsight.operators import profile as P
from tabsight.operators import retrieve as L
from tabsight.operators import review as V
from tabsight.operators import split as G
from tabsight.operators.cluster import cluster_table
from tabsight.operators.recipe import Recipe
from tabsight.operators.resample import refusal
from tabsight.operators.strategy import ColumnStrategy, validate
from tabsight.sources.tables import write_report, write_table


@dataclass
class Plan:
    """What the caller may decide; every choice has a deterministic default."""

    folds: int = 5
    time_column: str | None = None
    excluded: Sequence[str] = ()
    strategy: Sequence[ColumnStrategy] = ()
    select_k: int | None = None
    resample: bool | None = None
    trim_target: bool = False
    cluster: bool = True
    cluster_method: str = "kmeans"
    sample_rows: int | None = None
    explain_rows: int | None = None
    candidates: Sequence[H.Candidate] | None = None


@dataclass
class Analysis:
    run_id: str
    target: str
    task: str
    profile: DataFrame
    cleaned: C.Cleaned
    strategies: list[ColumnStrategy]
    leaderboard: DataFrame
    scores: DataFrame
    model: H.FittedModel
    winner: str
    card: DataFrame
    reports: dict[str, DataFrame] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)


def analyse(df: DataFrame, key: str, target: str | None = None, task: str | None = None, plan: Plan | None = None, run_id: str = "run") -> Analysis:
    """Profile, clean, describe, cluster, cross-validate, fit, explain and review ``df``.

    ``key`` is a unique column; it identifies rows and is never a feature.
    """
    plan = plan or Plan()
    notes: list[str] = []
    table = df.drop(key)
    profile = P.profile(table).persist()
    target = target or P.suggest_target(profile).first()["target"]
    task = task or P.infer_task(profile, target).first()["task"]
    excluded = [*plan.excluded, *[r["column"] for r in P.default_exclusions(profile, target).collect()]]
    semantics = {r["column"]: r["semantic_type"] for r in profile.select("column", "semantic_type").collect()}

    cleaned = clean_keyed(df, key, target, task, semantics, excluded, plan.trim_target)
    C.guard_usable(cleaned.df.drop(key), target)
    rows = cleaned.df.persist()
    reports = {f"eda_{k}": v for k, v in E.eda(rows.drop(key), target, task).items()}

    clusters = cluster_table(rows, key, target, plan.cluster_method) if plan.cluster else {"skipped": "turned off"}
    if "profiles" in clusters:
        reports["clusters"] = clusters["profiles"]

    strategies, rejected, overrides = validate(rows.drop(key, target), plan.strategy)
    recipe = Recipe(strategies, plan.select_k, target, task)

    model_rows = rows
    if plan.sample_rows:
        model_rows = (
            G.stratified_sample(rows, [key], target, plan.sample_rows) if task == "classification" else G.sample_rows(rows, [key], plan.sample_rows)
        )
    folded, scheme = _folds(model_rows, key, target, task, plan, notes)
    resample = False
    if task == "classification":
        wanted = plan.resample
        if wanted is None:
            wanted = bool(E.class_balance(model_rows, target).first()["imbalanced"])
        if wanted:
            why = refusal(model_rows, target, task)
            resample = why is None
            if why:
                notes.append(f"oversampling was skipped: {why}")
    candidates = list(plan.candidates or H.roster(task))
    predictions, errors = H.cross_validate(folded, recipe, target, task, key, candidates, resample=resample)
    labels = H.class_labels(model_rows, target) if task == "classification" else []
    scores = H.fold_scores(predictions, task, labels).persist()
    metric = M.PRIMARY[task]
    board = H.rank_leaderboard(scores, metric, errors).persist()
    winner = board.where("is_winner").first()["model"]
    chosen = next(c for c in candidates if c.name == winner)
    model = H.fit_final(model_rows, recipe, chosen, target, task, key, resample)

    reports["leaderboard"] = board
    reports["fold_scores"] = scores
    summary = M.summarise_folds(scores.where(F.col("model") == winner))
    reports["evaluation"] = M.spread_note(summary)
    if task == "regression":
        own = predictions.where(F.col("model") == winner)
        reports["error_shape"] = M.error_shape(summary)
        reports["concentrated_error"] = M.concentrated_error(own, [key])
    n_rows = model_rows.count()

    importance, additivity = _explain(model, model_rows, key, target, task, plan)
    if importance is not None:
        reports["importance"] = importance
    run = F.lit(run_id).alias("run_id")
    tables = {
        "leaderboard": board.select(run, "*"),
        "evaluation": summary.where(F.col("metric") == metric).select(
            run, F.lit(target).alias("target"), F.lit(winner).alias("model"), "metric", "mean", "std", F.lit(n_rows).cast("long").alias("n_rows"), F.lit(len(notes)).alias("warnings"), F.lit(True).alias("is_primary")
        ),
        "features": df.sparkSession.createDataFrame([(run_id, len(rejected), len(overrides))], "run_id string, rejected long, overridden long"),
    }
    if "k" in clusters:
        tables["clustering"] = df.sparkSession.createDataFrame([(run_id, clusters["k"], float(clusters["silhouette"]))], "run_id string, k long, silhouette double")
    if importance is not None:
        tables["explanation"] = importance.agg(F.max("share").alias("top_share")).select(run, F.lit(additivity).alias("additivity_error"), "top_share")
    findings = V.measured_findings(tables)
    reports["findings"] = findings
    passages = {"evaluation": tables["evaluation"], "findings": findings}
    if importance is not None:
        passages["importance"] = importance.select(run, "source", "share", "position")
    if "profiles" in clusters:
        passages["clusters"] = clusters["profiles"].select(run, F.col("cluster"), "size", "share").distinct()
    reports["passages"] = L.build_passages(passages)
    notes.append(f"folds: {scheme}")
    card = H.model_card(rows, strategies, key, target)
    reports["model_card"] = card
    reports["cleaning_steps"] = cleaned.steps
    reports["missing_left"] = cleaned.remaining
    return Analysis(run_id, target, task, profile, cleaned, strategies, board, scores, model, winner, card, reports, notes)


def clean_keyed(df: DataFrame, key: str, target: str, task: str, semantics: dict[str, str], excluded: Sequence[str], trim: bool = False) -> C.Cleaned:
    """``clean`` for a table with a key: two rows that differ only in the key are copies, and the smaller key stays."""
    return C.clean(df, target, task, semantics, excluded, trim, key=key)


def _folds(df: DataFrame, key: str, target: str, task: str, plan: Plan, notes: list[str]) -> tuple[DataFrame, str]:
    if plan.time_column:
        timed, applied = G.order_by_time(df, plan.time_column)
        if applied:
            parts = G.time_series_split(timed, ["_time", key], plan.folds).drop("_time")
            if task == "classification":
                lone = G.single_class_folds(parts.where("role = 'test'"), target).where("single").count()
                if lone:
                    notes.append(f"{lone} time-ordered folds hold a single class")
            return parts, "TimeSeriesSplit"
        notes.append(f"too many rows have no readable {plan.time_column}: random folds were used")
    if task == "classification":
        folds, scheme = G.stratified_folds(df, target, plan.folds)
        if folds < plan.folds:
            notes.append(f"reduced to {folds} folds: the rarest class is too small")
        return G.stratified_kfold(df, [key], target, plan.folds), scheme
    n = df.count()
    if n < G.MIN_ROWS:
        raise G.CannotSplit(f"cross-validation needs at least {G.MIN_ROWS} rows")
    return G.kfold(df, [key], max(2, min(plan.folds, n))), "KFold"


def _explain(model: H.FittedModel, rows: DataFrame, key: str, target: str, task: str, plan: Plan):
    """(importance by source column, largest additivity gap) of the fitted winner, or (None, 0)."""
    if plan.explain_rows:
        rows = G.stratified_sample(rows, [key], target, plan.explain_rows) if task == "classification" else G.sample_rows(rows, [key], plan.explain_rows)
    names = model.recipe.names
    lineage = model.recipe.lineage_table(rows.sparkSession)
    parts = [phi.persist() for phi in _attributions(model, rows, key, task)]
    if not parts:
        return None, 0.0
    gap = max(J.check_additivity(phi, F.col("raw")).first()["max_error"] or 0.0 for phi in parts)
    # One output a class: the mean over rows and classes is the mean over classes of each one's mean.
    long = reduce(DataFrame.unionAll, [J.long_phi(phi, names, [key]) for phi in parts])
    return J.global_importance(long, lineage).persist(), float(gap)


def _attributions(model: H.FittedModel, rows: DataFrame, key: str, task: str) -> list[DataFrame]:
    """(key, phi, base, raw) for each output of the model: one, or one a class beyond two classes."""
    inner, names = model.model, model.recipe.names
    kind = type(inner).__name__
    if kind in ("LinearRegressionModel", "LogisticRegressionModel"):
        encoded = model.recipe.encode(rows, [key])
        means = J.feature_means(encoded, names)
        if kind.startswith("Linear") or inner.numClasses == 2:
            outputs = [(list(inner.coefficients.toArray()), float(inner.intercept))]
        else:
            outputs = [(list(w), float(b)) for w, b in zip(inner.coefficientMatrix.toArray(), inner.interceptVector.toArray())]
        parts = []
        for weights, intercept in outputs:
            margin = F.lit(intercept)
            for name, b in zip(names, weights):
                margin = margin + F.col(f"`{name}`") * F.lit(float(b))
            phi = J.linear_shap(encoded.withColumn("_raw", margin), names, weights, intercept, means, [key, "_raw"])
            parts.append(phi.withColumnRenamed("_raw", "raw"))
        return parts
    if not kind.startswith(("RandomForest", "GBT")):
        return []
    scored = inner.transform(model.recipe.transform(rows, [key]))
    if task == "regression":
        outputs = [(0, F.col("prediction"))]
    elif kind.startswith("GBT"):
        outputs = [(0, vector_to_array("rawPrediction")[1])]
    elif len(model.labels) == 2:
        outputs = [(1, vector_to_array("probability")[1])]
    else:
        outputs = [(i, vector_to_array("probability")[i]) for i in range(len(model.labels))]
    return [J.tree_shap(inner, scored.withColumn("raw", raw), len(names), [key, "raw"], i) for i, raw in outputs]


def write_analysis(result: Analysis, folder: str) -> None:
    """The cleaned table, every report as a tidy table partitioned by run, and the fitted model."""
    write_table(result.cleaned.df, f"{folder}/cleaned/{result.run_id}")
    for name, report in {**result.reports, "profile": result.profile}.items():
        report = report.drop("run_id")
        if report.columns:
            write_report(report, folder, name, result.run_id)
    result.model.save(result.cleaned.df.sparkSession, f"{folder}/model/{result.run_id}")
