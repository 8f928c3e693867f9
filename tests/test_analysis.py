import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.operators import models as H
from tabsight.plans import catalog
from tabsight.plans.analysis import Plan, analyse, write_analysis

QUICK = dict(trees=8, depth=5, rounds=5)


@pytest.fixture(scope="module")
def rent(spark):
    """Planted: rent = 200 + 15 area + 80 rooms - 30 distance, one duplicate, one gap."""
    rng = np.random.default_rng(21)
    rows = []
    for i in range(120):
        area, rooms, far = float(rng.integers(20, 120)), int(rng.integers(1, 6)), float(np.round(rng.uniform(0, 12), 1))
        rows.append((i, None if i == 5 else area, rooms, far, ["north", "south", "east"][i % 3], f"agent{i % 9}@home.org", 200 + 15 * area + 80 * rooms - 30 * far + float(rng.normal(0, 5))))
    rows.append((120, *rows[0][1:]))
    return spark.createDataFrame(rows, "id long, area double, rooms long, distance_km double, district string, email string, rent double")


def test_regression_end_to_end(spark, rent, tmp_path):
    out = analyse(rent, "id", plan=Plan(folds=4, candidates=H.roster("regression", **QUICK)), run_id="rent")
    assert (out.target, out.task, out.winner) == ("rent", "regression", "Linear regression")
    assert out.cleaned.df.count() == 120 and "email" not in out.cleaned.df.columns
    best = out.leaderboard.where("is_winner").first()
    assert best["score"] > 0.95 and out.model.use_log is False
    assert out.reports["importance"].orderBy("position").first()["source"] == "area"
    assert out.reports["passages"].where("source = 'explanation'").count() > 1
    steps = {r["step"]: r["n"] for r in out.cleaned.steps.collect()}
    assert steps["rows_before"] == 121 and steps["rows_after"] == 120
    write_analysis(out, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "leaderboard")).where("run_id = 'rent'").count() == 4
    assert H.FittedModel.load(spark, str(tmp_path / "model" / "rent")).predict(rent, ["id"]).count() == 121


def test_small_pilot_with_four_positives(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ["a", "b"][i % 2], int(rng.integers(18, 80)), float(rng.normal(50, 10)), "yes" if i % 40 == 7 else "no") for i in range(150)]
    df = spark.createDataFrame(rows, "participant long, cohort string, age long, baseline double, responded string")
    assert df.where("responded = 'yes'").count() == 4
    out = analyse(df, "participant", "responded", plan=Plan(cluster=False, candidates=H.roster("classification", **QUICK)))
    assert any("reduced to 4 folds" in n for n in out.notes) and any("oversampling was skipped" in n for n in out.notes)
    findings = {r["rule"] for r in out.reports["findings"].collect()}
    assert "few rows" in findings


def test_time_ordered_and_oversampled(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (i * 77) % 200, float(rng.normal()) + (2.0 if i % 4 == 0 else 0.0), "fail" if i % 4 == 0 else "pass") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, hour long, x double, state string")
    out = analyse(df, "id", "state", plan=Plan(folds=3, time_column="hour", cluster=False, candidates=H.roster("classification", **QUICK)[1:]))
    assert "folds: TimeSeriesSplit" in out.notes and out.leaderboard.where("is_winner").first()["score"] > 0.6


def test_text_keys_and_uneven_classes(spark):
    rng = np.random.default_rng(9)
    rows = [(f"listing {i:04d}", float(rng.normal()) + (2.0 if i % 5 == 0 else 0.0), float(rng.normal()), "yes" if i % 5 == 0 else "no") for i in range(200)]
    df = spark.createDataFrame(rows, "id string, x double, z double, sold string")
    out = analyse(df, "id", "sold", plan=Plan(folds=3, cluster=False, candidates=H.roster("classification", **QUICK)[1:]))
    assert out.leaderboard.where("error <> ''").count() == 0 and out.leaderboard.where("is_winner").first()["score"] > 0.6


def test_a_fold_that_cannot_be_prepared_is_reported(spark, rent, monkeypatch):
    prepare = H._prepare

    def broken(train, *rest):
        if train.where("fold = 1").isEmpty():
            raise RuntimeError("no such fold")
        return prepare(train, *rest)

    monkeypatch.setattr(H, "_prepare", broken)
    recipe = H.Recipe([])
    df = rent.withColumn("fold", F.col("id") % 2)
    predictions, errors = H.cross_validate(df, recipe, "rent", "regression", "id", [c for c in H.roster("regression", **QUICK) if c.is_baseline])
    assert set(errors.values()) == {"no such fold"} and predictions.count() == 0


def test_entry_and_every_query_is_declared(spark, folder):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    names, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(names) and len(names) > 150
    assert set(catalog.QUERIES) <= set(names)
    assert {n[0] for n in catalog.QUERIES} == set("abcdefghijklm")


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n in ("a1_csv_scan", "c13_cleaning_report", "f22_recipe", "g5_time_series_split", "i5_roc_auc", "l4_search_batch")))
def test_sample_of_queries_against_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "events", "lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, folder)
    relation = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in relation.description]
    expected = sorted(repr(row) for row in relation.fetchall())
    assert sorted(columns) == sorted(got.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == expected


def test_plans_push_down_and_prune(spark, folder):
    """A two-column question reads two columns, and its filter reaches the scan."""
    df = spark.read.parquet(f"{folder}/lineitem.parquet").where(F.col("l_quantity") > 40)
    from tabsight.operators.verbs import Agg, QuerySpec, run

    plan = run(df, QuerySpec(group_by=["l_returnflag"], agg={"m": Agg("mean", "l_quantity")}))._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
