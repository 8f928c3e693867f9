import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabsight.operators import cluster as E
from tabsight.operators import eda as D
from tabsight.operators import explain as J
from tabsight.operators import ledger as U
from tabsight.operators import retrieve as L
from tabsight.operators import verbs as V


@pytest.fixture(scope="module")
def groups(spark):
    """Three planted groups of 100."""
    rng = np.random.default_rng(0)
    rows = []
    for g, (age, income, city) in enumerate([(25, 20_000, "Leeds"), (45, 60_000, "London"), (65, 35_000, "Bristol")]):
        rows += [(g * 100 + i, float(rng.normal(age, 2)), float(rng.normal(income, 1500)), city, g) for i in range(100)]
    return spark.createDataFrame(rows, "id long, age double, income double, city string, truth int").cache()


def purity(df):
    counts = df.groupBy("cluster", "truth").count().toPandas()
    return counts.groupby("cluster")["count"].max().sum() / counts["count"].sum()


def test_planted_groups_are_found(groups):
    mixed = E.cluster_table(groups.drop("truth"), "id")
    assert mixed["method"] == "kprototypes" and mixed["overridden"] and mixed["k"] == 3 and not mixed["weak"]
    assert purity(mixed["labels"].join(groups, "id")) == 1.0
    plain = E.cluster_table(groups.drop("truth", "city"), "id")
    assert plain["method"] == "kmeans" and plain["k"] == 3
    assert "cluster" not in groups.columns


def test_noise_is_weak(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, *[float(v) for v in rng.normal(0, 1, 3)]) for i in range(200)], "id long, a double, b double, c double")
    assert E.cluster_table(df, "id")["weak"]


def test_kprototypes_cost_never_rises(groups):
    scaled = E.prepare_matrix(groups, ["age", "income"], []).encode(groups, ["id", "city"])
    model = E.kprototypes(scaled, ["age", "income"], ["city"], 3, "id")
    assert all(b <= a * (1 + 1e-9) for a, b in zip(model.costs, model.costs[1:]))
    assert model.assign(scaled).agg(F.sum("cost")).first()[0] == pytest.approx(model.cost)


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (200, 4)) @ rng.normal(0, 1, (4, 4)) + 10
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>").select("id", array_to_vector("x").alias("features"))
    scatter, shares = E.pca_scatter(df, "id")
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(shares, (values / values.sum())[:2])
    assert abs(scatter.agg(F.avg("x")).first()[0]) < 1e-9


def test_eda_leaves_the_table_alone(groups):
    before = groups.schema
    reports = D.eda(groups.drop("id"), "city", "classification")
    assert groups.schema == before and {"columns", "correlations", "class_balance", "histograms", "boxplots"} <= set(reports)
    assert reports["histograms"].where("column = 'age'").agg(F.sum("n")).first()[0] == 300


def test_correlation_of_constant_and_gappy_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0, 5.0), (2.0, 4.0, None, 5.0), (3.0, 7.0, 3.0, 5.0), (4.0, 8.0, 2.0, 5.0)], "a double, b double, c double, k double")
    got = {(r["left"], r["right"]): r["correlation"] for r in D.correlation_matrix(df).collect()}
    expected = df.toPandas().corr()
    for (a, b), v in got.items():
        e = expected.loc[a, b]
        assert (v is None and np.isnan(e)) or v == pytest.approx(e)


def test_outliers_without_spread(spark):
    df = spark.createDataFrame([(5.0,)] * 30 + [(99.0,)], "x double")
    assert D.outlier_counts(df).first()["outlier_count"] == 0


# ---- verbs ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(20, "A", 1, 10.0), (30, "B", 0, 20.0), (40, "A", 1, 30.0), (50, "B", 0, None)], "age long, city string, churn long, charge double")


def one(df):
    return df.first()[0]


def test_questions(people):
    assert one(V.run(people, V.QuerySpec(agg={"m": V.Agg("mean", "age")}))) == 35
    assert one(V.run(people, V.QuerySpec(where=F.col("age") > 25, agg={"m": V.Agg("median", "age")}))) == 40
    assert one(V.run(people.where("age > 99"), V.QuerySpec(agg={"s": V.Agg("sum", "age")}))) == 0
    assert one(V.run(people.where("age > 99"), V.QuerySpec(agg={"s": V.Agg("prod", "age")}))) == 1
    both = V.run(people, V.QuerySpec(group_by=["city"], agg={"hi": V.Agg("max", "charge"), "mid": V.Agg("median", "charge")}, order_by=[("city", True)]))
    assert [tuple(r) for r in both.collect()] == [("A", 30.0, 20.0), ("B", 20.0, 20.0)]


def test_unknown_verbs_and_columns_are_refused(people):
    for spec in (V.QuerySpec(select=["salary"]), V.QuerySpec(agg={"x": V.Agg("eval", "age")}), V.QuerySpec(agg={"x": V.Agg("mean", "salary")})):
        with pytest.raises(V.UnknownVerb):
            V.run(people, spec)
    with pytest.raises(V.UnknownVerb):
        V.compare(F.col("age"), "like", "x")


def test_null_comparison(people):
    kept = people.where(V.compare(F.col("charge"), "!=", 10.0))
    assert kept.count() == 3 and people.where(V.compare(F.col("charge"), ">", 0)).count() == 3


def test_capped_result(people, spark):
    assert V.capped(people, ["age"], 3).collect()[0]["remaining"] == 1
    empty = V.capped(people.where("age > 99"), ["age"]).collect()
    assert len(empty) == 1 and empty[0]["note"] == "no rows matched"


def test_undefined_statistics_are_null(spark):
    one_row = spark.createDataFrame([(1.0,)], "x double")
    out = V.run(one_row, V.QuerySpec(agg={v: V.Agg(v, "x") for v in ("std", "var", "sem", "skew", "kurt")})).first()
    assert all(v is None for v in out)


# ---- search and ledgers --------------------------------------------------------------------------


def test_batch_search_ways_agree(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    queries = vectors.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    a, b = (
        sorted((r["query"], r["position"], r["key"]) for r in L.search_batch(vectors, queries, "vec_id", "embedding", k=3, small=s).collect()) for s in (True, False)
    )
    assert a == b and all(q == k for q, p, k in a if p == 1)
    named = vectors.selectExpr("'v' || lpad(vec_id, 9, '0') AS vec_id", "embedding")
    asked = queries.where("query < 40").selectExpr("'v' || lpad(query, 9, '0') AS query", "q")
    for small in (True, False):
        found = L.search_batch(named, asked, "vec_id", "embedding", k=3, small=small).collect()
        assert sorted((int(r["query"][1:]), r["position"], int(r["key"][1:])) for r in found) == [t for t in a if t[0] < 40]
    single = L.search(vectors, vectors.where("vec_id = 7").first()["embedding"], "vec_id", "embedding", k=3)
    assert [r["vec_id"] for r in single.collect()] == [k for q, p, k in a if q == 7]


def test_cost_is_exact_decimal(spark):
    usage = spark.createDataFrame([("j", "small", 5, 1), ("j", "small", 7, 0), ("k", "none", 9, 9)], "job string, tier string, input_tokens long, output_tokens long")
    rates = spark.createDataFrame([("small",)], "tier string").select("tier", F.lit("0.1").cast("decimal(12,6)").alias("input_rate"), F.lit("0").cast("decimal(12,6)").alias("output_rate"))
    got = {r["job"]: (str(r["cost"]), r["requests"]) for r in U.usage_totals(usage, rates, ["job"]).collect()}
    # 0.5 millionths round half to even, 0.7 up
    assert got == {"j": ("0.000001", 2), "k": ("0.000000", 1)}


def test_representative_rows_of_a_regression(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "id long, pred double")
    assert {r["reason"]: r["id"] for r in J.representative_rows(df, "id", "regression").collect()} == {"lowest": 0, "middle": 4, "highest": 8}
