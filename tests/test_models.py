from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabsight.operators import explain as J
from tabsight.operators import metrics as M
from tabsight.operators import models as H
from tabsight.operators import score as K
from tabsight.operators import split as G
from tabsight.operators.recipe import Recipe
from tabsight.operators.strategy import ColumnStrategy as One
from tabsight.streaming.scoring import read_stream, score_stream

QUICK = dict(trees=10, depth=5, rounds=5)


@pytest.fixture(scope="module")
def churn(spark):
    """support_calls decides the label; the other columns do not."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(160):
        calls = int(rng.integers(0, 10))
        rows.append((i, int(rng.integers(18, 70)), ["London", "Leeds", "Bristol"][i % 3], calls, "yes" if calls + rng.normal(0, 0.5) > 5 else "no"))
    return spark.createDataFrame(rows, "id long, age long, city string, support_calls long, churned string").cache()


STRATEGIES = [
    One("age", "numeric", "median", "none", "standard"),
    One("city", "categorical", "most_frequent", "onehot"),
    One("support_calls", "numeric", "median", "none", "standard"),
]


@pytest.fixture(scope="module")
def validated(churn):
    folded = G.stratified_kfold(churn, ["id"], "churned", 4)
    failing = H.Candidate("Broken", lambda n, c, r: (_ for _ in ()).throw(RuntimeError("cannot be built")))
    predictions, errors = H.cross_validate(folded, Recipe(STRATEGIES), "churned", "classification", "id", [*H.roster("classification", **QUICK), failing])
    return predictions, errors


def test_every_row_is_predicted_once_per_model(validated, churn):
    predictions, errors = validated
    counts = {r["model"]: (r["n"], r["k"]) for r in predictions.groupBy("model").agg(F.count("id").alias("n"), F.count_distinct("id").alias("k")).collect()}
    assert set(counts) == {"Random forest", "Logistic regression", "Gradient-boosted trees", H.BASELINE}
    assert set(counts.values()) == {(160, 160)} and errors == {"Broken": "cannot be built"}


@pytest.mark.parametrize("small", [True, False])
def test_recipes_of_all_folds_equal_fits_on_the_training_rows(spark, monkeypatch, small):
    monkeypatch.setattr("tabsight.operators.ordinal.is_small", lambda *_: small)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(90):
        gap = lambda v, share: None if rng.random() < share else v
        rows.append(
            (i, i % 3 if i < 88 else None, gap(float(rng.normal(1e6, 3)), 0.2), 7.5 if i % 3 else None, gap("abc"[int(rng.integers(3))], 0.3),
             gap(f"t{int(rng.integers(12))}", 0.2), gap(f"2024-0{1 + i % 9}-11 0{i % 7}:00:00", 0.1), None if i % 3 == 1 else "only")
        )
    df = spark.createDataFrame(rows, "id long, fold long, x double, same double, kind string, tag string, at string, lone string")
    recipe = Recipe(
        [
            One("x", "numeric", "mean", "none", "standard"),
            One("same", "numeric", "median", "none", "standard"),
            One("kind", "categorical", "constant", "onehot", "standard"),
            One("tag", "text", "most_frequent", "frequency"),
            One("at", "datetime", "none", "none", "minmax"),
            One("lone", "categorical", "most_frequent", "onehot"),
        ]
    )
    table = lambda f: {r["v"]: r["share"] for r in f.frequencies["tag"].collect()}
    found = recipe.fit_folds(df, [0, 1, 2])
    assert set(found) == {0, 1, 2}
    for fold, got in found.items():
        want = recipe.fit(df.where(F.col("fold") != fold))
        assert (got.label_fill, got.vocabularies, got.lineage) == (want.label_fill, want.vocabularies, want.lineage)
        assert got.number_fill == pytest.approx(want.number_fill)
        assert set(got.scales) == set(want.scales)
        for name, scale in want.scales.items():
            assert got.scales[name] == pytest.approx(scale), name
        assert table(got) == pytest.approx(table(want))
    encoded = recipe.encode_folds(df, [0, 1, 2], ["id"]).collect()
    assert sorted(r["id"] for r in encoded) == list(range(88))
    assert recipe.fit_folds(df.limit(0), [0])[0].scales["x"] == (0.0, 1.0)


def test_leaderboard(validated):
    predictions, errors = validated
    scores = H.fold_scores(predictions, "classification", ["no", "yes"])
    board = H.rank_leaderboard(scores, "f1_macro", errors).orderBy("rank").collect()
    assert board[0]["is_winner"] and not board[0]["is_baseline"] and board[0]["score"] > 0.85
    assert board[-1]["model"] == "Broken" and board[-1]["score"] is None
    assert H.baseline_verdict(H.rank_leaderboard(scores, "f1_macro", errors)).isEmpty()
    auc = scores.where("metric = 'roc_auc' and model = 'Baseline'").agg(F.max("value")).first()[0]
    assert auc == 0.5


def test_time_folds_and_regression(spark):
    rows = [(i, float(i % 13), float(3 * (i % 13) + 7)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    parts = G.time_series_split(df, ["id"], 3)
    predictions, _ = H.cross_validate(parts, Recipe([One("x", "numeric", "median")]), "y", "regression", "id", H.roster("regression", **QUICK)[1:2])
    r2 = H.fold_scores(predictions, "regression").where("metric = 'r2'").collect()
    assert len(r2) == 3 and all(r["value"] > 0.9999 for r in r2)


def test_multiclass_boosting_has_probabilities(spark):
    rows = [(i, float(i % 3) + (i % 7) / 50, "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, x double, y string")
    model = H.fit_final(df, Recipe([One("x", "numeric", "median")]), H.roster("classification", **QUICK)[2], "y", "classification", "id")
    out = K.score(model, df, ["id", "y"]).collect()
    assert all(abs(sum(r["probabilities"].values()) - 1) < 1e-9 for r in out) and np.mean([r["pred"] == r["y"] for r in out]) > 0.95


def test_log_target_is_undone_and_survives_saving(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(np.exp(x))) for i, x in enumerate(rng.normal(4, 1.3, 400))]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    model = H.fit_final(df, Recipe([One("x", "numeric", "median")]), H.roster("regression")[1], "y", "regression", "id")
    assert model.use_log
    model.save(spark, str(tmp_path / "m"))
    back = H.FittedModel.load(spark, str(tmp_path / "m"))
    r2 = M.regression_metrics(back.predict(df, ["id", "y"])).where("metric = 'r2'").first()["value"]
    assert r2 > 0.99


def test_saved_recipe_with_every_encoding(spark, tmp_path, churn):
    df = churn.withColumn("note", F.concat_ws(" ", F.lit("calm river bridge"), "city", F.when(F.col("support_calls") > 5, "angry market").otherwise("happy garden")))
    parts = [*STRATEGIES[:1], One("city", "text", "most_frequent", "frequency"), One("note", "text", "constant", "tfidf")]
    model = H.fit_final(df, Recipe(parts, topics=3), H.roster("classification")[1], "churned", "classification", "id")
    model.save(spark, str(tmp_path / "m"))
    a = {r["id"]: r["pred"] for r in model.predict(df, ["id"]).collect()}
    b = {r["id"]: r["pred"] for r in H.FittedModel.load(spark, str(tmp_path / "m")).predict(df, ["id"]).collect()}
    assert a == b and "note_topic_0" in model.recipe.names


def test_align(spark):
    df = spark.createDataFrame([("41", "x", 1)], "age string, city string, extra long")
    out, missing, unexpected = K.align(df, [("city", "string"), ("age", "bigint"), ("gone", "double")])
    assert out.columns == ["city", "age", "gone"] and missing == ["gone"] and unexpected == ["extra"]
    assert out.first()["age"] == 41.0
    with pytest.raises(K.NothingToScore):
        K.align(df, [("gone", "double")])


def test_stream_equals_batch(spark, churn, tmp_path):
    model = H.fit_final(churn, Recipe(STRATEGIES), H.roster("classification")[1], "churned", "classification", "id")
    source = str(tmp_path / "in")
    churn.limit(100).write.parquet(source)
    card = [("age", "bigint"), ("city", "string"), ("support_calls", "bigint")]
    for _ in range(2):  # a restart neither loses nor repeats rows
        score_stream(model, read_stream(spark, source, churn.schema), card, ["id"], str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = {r["id"]: r["pred"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r["id"]: r["pred"] for r in model.predict(spark.read.parquet(source), ["id"]).collect()}
    assert got == batch and spark.read.parquet(str(tmp_path / "out")).count() == 100


# ---- metrics -------------------------------------------------------------------------------------


def test_ranking_metrics_by_hand(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (1, 0.4), (0, 0.4), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, s double")
    pairs = [(a, b) for y, a in rows for z, b in rows if y == 1 and z == 0]
    auc = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs])
    ap = (1 / 3) * 1 + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 5)
    for small in (True, False):
        got = {r["metric"]: r["value"] for r in M.ranking_metrics(df, F.col("y") == 1, F.col("s"), small=small).collect()}
        assert got["roc_auc"] == pytest.approx(auc) and got["pr_auc"] == pytest.approx(ap)


def test_zero_targets_are_left_out_of_the_percentage(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 15.0), (20.0, 22.0)], "y double, pred double")
    row = M.regression_metrics(df).where("metric = 'median_ape'").first()
    assert row["value"] == pytest.approx(0.3) and "zero" in row["reason"]


def test_medians_are_only_worked_out_where_wanted(spark, monkeypatch):
    df = spark.createDataFrame([(i % 2, float(i * i + 1), float(i)) for i in range(40)], "fold int, y double, pred double")
    every = {(r["fold"], r["metric"]): r["value"] for r in M.regression_metrics(df, by=["fold"]).collect()}
    asked, quantiles = [], M.quantiles
    monkeypatch.setattr(M, "quantiles", lambda d, columns, *a: asked.append(columns) or quantiles(d, columns, *a))
    for metrics in (["r2", "mse"], ["median_ae", "mae"]):
        got = {(r["fold"], r["metric"]): r["value"] for r in M.regression_metrics(df, by=["fold"], metrics=metrics).collect()}
        assert got == {k: v for k, v in every.items() if k[1] in metrics}
    assert asked == [["_a"]]


def test_concentrated_error_is_silent_when_spread_evenly(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 5, float(i), float(i + rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, fold int, y double, pred double")
    assert M.concentrated_error(df, ["id"]).isEmpty()
    hit = df.withColumn("pred", F.when(F.col("id") == 3, 5000.0).otherwise(F.col("pred")))
    for small in (True, False):
        row = M.concentrated_error(hit, ["id"], small=small).first()
        assert row["fold"] == 3 and row["heavy_rows"] == 1 and row["score_without_heavy"] > 0.99


# ---- attribution ---------------------------------------------------------------------------------


def brute_force(paths, x, width):
    """Shapley values by definition, over the path-dependent expectation of each coalition."""

    def value(present):
        total = 0.0
        for leaf, parts in paths:
            share = leaf
            for f, zero, rules in parts:
                if f in present:
                    share *= all((x[f] <= t) if left else (x[f] > t) for t, left in rules)
                else:
                    share *= zero
            total += share
        return total

    phi = np.zeros(width)
    for j in range(width):
        rest = [i for i in range(width) if i != j]
        for size in range(width):
            w = factorial(size) * factorial(width - 1 - size) / factorial(width)
            phi[j] += sum(w * (value({*c, j}) - value(set(c))) for c in combinations(rest, size))
    return phi, value(set())


@pytest.mark.parametrize("which", ["forest classifier", "forest regressor", "boosted classifier", "boosted regressor"])
def test_tree_attribution(spark, churn, which):
    task = "classification" if "classifier" in which else "regression"
    target = "churned" if task == "classification" else "support_calls"
    parts = [s for s in STRATEGIES if s.column != target] if task == "regression" else STRATEGIES
    if task == "regression":
        parts = [*parts, One("label", "categorical", "most_frequent", "onehot")]
        df = churn.withColumnRenamed("churned", "label")
    else:
        df = churn
    candidate = H.roster(task, trees=4, depth=4, rounds=4)[0 if "forest" in which else 2]
    model = H.fit_final(df, Recipe(parts), candidate, target, task, "id")
    width = len(model.recipe.names)
    scored = model.model.transform(model.recipe.transform(df, ["id"]))
    if task == "regression":
        raw = F.col("prediction")
    else:
        raw = vector_to_array("probability" if "forest" in which else "rawPrediction")[1]
        if "boosted" in which:
            raw = raw  # the margin of the positive class
    out = J.tree_shap(model.model, scored.withColumn("raw", raw), width, ["id", "raw"], 1)
    assert J.check_additivity(out, F.col("raw")).first()["holds"]
    paths = J.tree_paths(model.model, 1)
    xs = {r["id"]: list(r["x"]) for r in model.recipe.transform(df, ["id"]).select("id", vector_to_array("features").alias("x")).collect()}
    for r in out.orderBy("id").limit(5).collect():
        phi, base = brute_force(paths, xs[r["id"]], width)
        assert np.allclose(r["phi"], phi, atol=1e-9) and r["base"] == pytest.approx(base)


def test_a_cell_has_the_attribution_of_its_rows():
    """Values on, beside and far above thresholds, and NaN: one value a cell stands for all of its rows."""
    rng = np.random.default_rng(3)
    paths = [
        (2.0, [(0, 0.4, [(1.0, True)]), (1, 0.5, [(0.0, False), (2.5, True)])]),
        (-1.0, [(0, 0.6, [(1.0, False), (3.0, True)]), (2, 0.3, [(0.5, True)])]),
        (0.5, [(1, 0.7, [(2.5, False)])]),
    ]
    x = np.vstack([rng.choice([-1.0, 0.0, 0.5, 1.0, 1.0000001, 2.5, 3.0, 9.0, np.inf, np.nan], (400, 4)), rng.normal(1, 2, (400, 4))])
    thresholds = J._thresholds(paths, 4)
    codes = J._cells(x, thresholds)
    assert len(np.unique(codes, axis=0)) <= 4 * 4 * 3
    assert np.array_equal(J._path_phi(J._cell_values(codes, thresholds), paths, 4)[0], J._path_phi(x, paths, 4)[0])


def test_cells_meet_their_rows_with_and_without_broadcast(spark, churn, monkeypatch):
    model = H.fit_final(churn, Recipe(STRATEGIES), H.roster("classification", **QUICK)[0], "churned", "classification", "id")
    scored = model.recipe.transform(churn, ["id"])
    every = []
    for limit in (J.BROADCAST_VALUES, 0):
        monkeypatch.setattr(J, "BROADCAST_VALUES", limit)
        phi = J.tree_shap(model.model, scored, len(model.recipe.names), ["id"], 1)
        every.append(sorted((r["id"], tuple(r["phi"]), r["base"]) for r in phi.collect()))
    assert every[0] == every[1] and len(every[0]) == churn.count()


def test_top_driver_is_the_planted_one(spark, churn):
    model = H.fit_final(churn, Recipe(STRATEGIES), H.roster("classification", **QUICK)[0], "churned", "classification", "id")
    scored = model.recipe.transform(churn, ["id"])
    phi = J.tree_shap(model.model, scored, len(model.recipe.names), ["id"], 1)
    top = J.global_importance(J.long_phi(phi, model.recipe.names, ["id"]), model.recipe.lineage_table(spark)).orderBy("position").first()
    assert top["source"] == "support_calls" and top["share"] > 0.5


def test_a_target_of_too_many_values_is_refused(spark):
    many = spark.range(H.MAX_CLASSES + 5).select(F.concat(F.lit("v"), "id").alias("label"))
    with pytest.raises(H.TooManyClasses):
        H.class_labels(many, "label")
    assert H.class_labels(many.limit(3), "label") == sorted(r["label"] for r in many.limit(3).collect())


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_boosting_over_cells_gives_the_trees_of_the_rows(spark, monkeypatch, task):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        a, b, c = int(rng.integers(0, 12)), "uvw"[int(rng.integers(0, 3))], float(rng.integers(0, 9)) / 3
        v = a * (2.0 if b == "u" else -1.0) + c + float(rng.normal(0, 0.3))
        rows.append((i, a, b, c, v if task == "regression" else "yes" if v > 2 else "no"))
    df = spark.createDataFrame(rows, f"id long, a long, b string, c double, y {'double' if task == 'regression' else 'string'}")
    recipe = Recipe([One("a", "numeric", "median", "none", "standard"), One("b", "categorical", "most_frequent", "onehot"), One("c", "numeric", "median")])
    made = []
    fit = lambda: H.fit_final(df, recipe, H.roster(task, **QUICK)[2], "y", task, "id")
    plain = fit()
    seen = lambda cls, keep: (lambda self, data, *a: (made.append(data.count()), keep(self, data, *a))[1])
    for cls in (H.GBTRegressor, H.GBTClassifier):
        monkeypatch.setattr(cls, "fit", seen(cls, cls.fit))
    monkeypatch.setattr(H, "CELL_ROWS", 100)
    cells = fit()
    assert len(made) == 1 and made[0] <= 12 * 3 * 9 * (2 if task == "classification" else 1)
    score = "pred" if task == "regression" else "probabilities[1]"
    one, two = ({r["id"]: r["s"] for r in m.predict(df, ["id"]).selectExpr("id", f"{score} as s").collect()} for m in (plain, cells))
    assert max(abs(one[i] - two[i]) for i in one) < 1e-9
    # of complementary columns either may be split, so leaves are compared by value and share of rows
    leaves = lambda m: np.sort(np.array([(v, np.prod([z for _, z, _ in path])) for v, path in J.tree_paths(m.model)]), axis=0)
    assert np.allclose(leaves(plain), leaves(cells), rtol=0, atol=1e-9)


def test_thresholds_come_from_all_rows(spark):
    df = spark.range(20000).selectExpr("cast(id as double) as many", "cast(id % 3 as double) as few", "1.0D as one", "if(id = 77, 1.0D, 0.0D) as rare", "if(id % 10 = 0, cast(id as double), 0.0D) as tail")
    many, few, one, rare, tail = H._thresholds(df, 32)
    # a common value takes one bin, not those of the others
    assert tail[0] == 0.0 and len(tail) == 31 and max(b - a for a, b in zip(tail, tail[1:])) < 1500
    assert few == [0.5, 1.5] and one == [] and rare == [0.5]
    assert len(many) == 31 and max(abs(t - 20000 * (k + 1) / 32) for k, t in enumerate(many)) < 10
