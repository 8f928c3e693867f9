import itertools
import tracemalloc

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabsight.functions import columns as C
from tabsight.operators import recipe as R
from tabsight.operators import select as L
from tabsight.operators import split as G
from tabsight.operators import strategy as S
from tabsight.operators import target as Y
from tabsight.operators.neighbours import kth_reach, near_pairs, nearest, nearest_centre
from tabsight.operators.resample import refusal, smote
from tabsight.operators.text import TextTopics, Tfidf, corpus_counts

One = S.ColumnStrategy


def test_frequency_is_a_training_proportion(spark):
    train = spark.createDataFrame([("London",)] * 3 + [("Leeds",)] * 2 + [("Bristol",)], "city string")
    test = spark.createDataFrame([("London",), ("Leeds",), ("Bristol",), ("York",)], "city string")
    out = R.Recipe([One("city", "text", "none", "frequency")]).fit(train).encode(test, ["city"])
    assert {r["city"]: r["city_frequency"] for r in out.collect()} == {"London": 3 / 6, "Leeds": 2 / 6, "Bristol": 1 / 6, "York": 0.0}


def test_calendar_parts(spark):
    df = spark.createDataFrame([("2024-01-15 09:00:00",), ("2023-06-30 17:30:00",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("signed_up"))
    out = R.Recipe([One("signed_up", "datetime", "median")]).fit(df).encode(df)
    got = {tuple(r[f"signed_up_{p}"] for p in R.DATETIME_PARTS) for r in out.collect()}
    assert got == {(2024, 1, 15, 0, 9), (2023, 6, 30, 4, 17)}


@pytest.mark.parametrize("how", ["dropped", "scrambled"])
def test_fit_does_not_see_held_out_rows(spark, how):
    """Fitting on fold <> 0 must not change when the held-out rows are deleted or scrambled."""
    rows = [(i, float(i), f"c{i % 3}" if i < 80 else "unseen", i % 5) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, x double, c string, fold long")
    held = F.col("fold") == 0
    other = df.where(~held) if how == "dropped" else df.withColumn("x", F.when(held, 1e9).otherwise(F.col("x"))).withColumn("c", F.when(held, "zzz").otherwise(F.col("c")))
    recipe = R.Recipe([One("x", "numeric", "median", "none", "standard"), One("c", "categorical", "most_frequent", "onehot")])
    a, b = (recipe.fit(d.where(~held)) for d in (df, other))
    assert (a.number_fill, a.scales, a.vocabularies, a.label_fill) == (b.number_fill, b.scales, b.vocabularies, b.label_fill)
    assert not hasattr(R.Recipe, "fit_transform")


def test_names_with_odd_characters(spark):
    df = spark.createDataFrame([(1.0, "a.b"), (2.0, "c `d`"), (3.0, "a.b")], "`x.y` double, `naïve score` string")
    fitted = R.Recipe([One("naïve score", "categorical", "most_frequent", "onehot")]).fit(df)
    assert fitted.names == ["naïve score_a.b", "naïve score_c `d`"]


def test_strategy_refusals(spark):
    rows = [(i, f"name {i}", "S" if i % 2 else "L", float(i), None if i % 5 == 0 else 1.0 * (i % 2)) for i in range(100)]
    df = spark.createDataFrame(rows, "code long, name string, size string, x double, gappy double")
    chosen, rejected, overrides = S.validate(
        df,
        [
            One("ghost", "numeric"),
            One("name", "categorical", "most_frequent", "onehot"),
            One("size", "ordinal", "most_frequent", "ordinal", "none", ("S",)),
            One("x", "categorical", "most_frequent", "onehot"),
            One("gappy", "numeric", "none", "none", "standard"),
        ],
    )
    got = {c.column: c for c in chosen}
    assert rejected == ["ghost"] and [c.column for c in chosen] == df.columns
    assert got["name"].role == "drop" and got["size"].role == "categorical" and got["x"].role == "numeric"
    assert got["gappy"].impute == "median" and got["code"].impute == "median"
    assert {o.column for o in overrides} == {"name", "size", "x", "gappy"}


def test_selection_keeps_the_signal(spark):
    rng = np.random.default_rng(0)
    rows = [(float(y) + float(rng.normal(0, 0.1)), float(rng.normal()), "ab"[y]) for y in rng.integers(0, 2, 200)]
    df = spark.createDataFrame(rows, "good double, noise double, y string")
    fitted = R.Recipe([One("good", "numeric", "median"), One("noise", "numeric", "median")], 1, "y", "classification").fit(df)
    assert fitted.names == ["good"]


@pytest.mark.parametrize("value", [7.0, 0.1])
def test_constants_have_no_spread_however_rows_are_cut(spark, value):
    # merged partial moments of this many equal values are off by rounding
    n = next(n for n in range(2, 10_000) if value / n * n != value)
    df = spark.range(0, 6 * n, 1, 6).select(F.lit(value).alias("x"), (F.col("id") % 2).alias("y"), F.col("id").cast("double").alias("t"))
    assert df.agg(C.variance(F.col("x"))).first()[0] == 0 and df.agg(F.var_pop("x")).first()[0] > 0
    assert L.anova_f(df, ["x"], "y").first()["f"] is None
    assert L.regression_f(df, ["x"], "t").first()["f"] is None
    perfect = df.withColumn("x", F.col("y") * value)
    assert L.anova_f(perfect, ["x"], "y").first()["f"] == float("inf")
    assert R.Recipe([One("x", "numeric", "none", "none", "standard")]).fit(df).scales["x"][1] == 1.0


def test_log_target(spark):
    rng = np.random.default_rng(0)
    skewed = spark.createDataFrame([(float(v),) for v in rng.lognormal(3, 1.2, 500)], "y double")
    signed = spark.createDataFrame([(float(v),) for v in rng.normal(0, 1, 500)], "y double")
    assert Y.choose_target_transform(skewed, "y").first()["use_log"]
    assert not Y.choose_target_transform(signed, "y").first()["use_log"]


# ---- text ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def prose(spark):
    words = ["garden", "kitchen", "river", "tower", "market", "bridge", "forest", "castle"]
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words[:4] if i % 2 else words[4:], 30))) for i in range(40)] + [(40, None), (41, "the of and")]
    return spark.createDataFrame(rows, "id long, t string")


def test_tfidf_rows_have_unit_length(prose):
    out = Tfidf.fit(prose, "id", "t").transform(prose)
    norms = out.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert len(norms) == 40 and all(abs(r["n"] - 1) < 1e-9 for r in norms)


def test_terms_are_tokenised_once_and_rows_of_a_key_are_one_document(spark, monkeypatch):
    monkeypatch.setattr("tabsight.operators.text.SLICE_TOKENS", 2)
    rows = [("a", "red blue red"), ("b", "blue"), ("a", "red"), (None, "blue red"), (None, None), ("c", "")]
    df = spark.createDataFrame(rows, "id string, t string")
    counts = {r["term"]: (r["df"], r["total"]) for r in corpus_counts(df, "t").collect()}
    assert counts == {"red": (3, 4), "blue": (3, 3), "red blue": (1, 1), "blue red": (2, 2)}
    out = Tfidf.fit(df, "id", "t", min_df=1).transform(df)
    assert {(r["id"], r["term"]) for r in out.collect()} == {(i, t) for i in ("a", None) for t in ("red", "blue", "blue red")} | {("a", "red blue"), ("b", "blue")}
    for plan in (corpus_counts(df, "t"), out):
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_min_df_is_relaxed_when_nothing_passes(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta")], "id long, t string")
    assert {r["term"] for r in Tfidf.fit(df, "id", "t").vocab.collect()} >= {"alpha", "beta", "gamma", "delta"}


def test_topics_match_a_dense_svd(prose):
    model = TextTopics.fit(prose, "t", topics=4)
    assert model.kind == "topic" and np.allclose(model.topics.T @ model.topics, np.eye(4), atol=1e-8)
    long = Tfidf.fit(prose, "id", "t").transform(prose).toPandas()
    dense = long.pivot(index="id", columns="term", values="weight").fillna(0)[model.words].to_numpy()
    exact = np.linalg.svd(dense, compute_uv=False)[:4]
    assert np.allclose(np.linalg.norm(dense @ model.topics, axis=0), exact, rtol=1e-4)
    out = model.transform(prose, "t", "v").collect()
    assert all(len(r["v"]) == 4 for r in out) and np.allclose([r["v"] for r in out if r["id"] >= 40], 0)


def test_few_terms_stay_terms(spark):
    df = spark.createDataFrame([(i, "red blue") for i in range(30)], "id long, t string")
    assert TextTopics.fit(df, "t", topics=20).kind == "term"


# ---- splits and resampling -----------------------------------------------------------------------


def test_folds_drop_to_the_rarest_class(spark):
    df = spark.createDataFrame([(i, "yes" if i < 4 else "no") for i in range(150)], "id long, y string")
    assert G.stratified_folds(df, "y", 5) == (4, "StratifiedKFold")
    per = G.stratified_kfold(df, ["id"], "y", 5).where("y = 'yes'").groupBy("fold").count().collect()
    assert [r["count"] for r in per] == [1] * 4
    lone = spark.createDataFrame([(i, "yes" if i < 1 else "no") for i in range(50)], "id long, y string")
    assert G.stratified_folds(lone, "y", 5) == (5, "KFold")


def test_sampling_ways_agree(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    a, b = (sorted(r["k"] for r in G.sample_rows(df, ["k"], 300, small=s).collect()) for s in (True, False))
    assert a == b and len(a) == 300
    assert G.sample_rows(df.limit(10), ["k"], 300, small=False).count() == 10


def test_kfold_sizes(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    assert sorted(r["count"] for r in G.kfold(df, ["k"], 5).groupBy("fold").count().collect()) == [4, 4, 5, 5, 5]


def test_time_folds_train_only_on_the_past(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "id long, day long")
    parts = G.time_series_split(df, ["day", "id"], 4)
    for fold in range(4):
        rows = parts.where(F.col("fold") == fold)
        assert rows.where("role = 'train'").agg(F.max("day")).first()[0] < rows.where("role = 'test'").agg(F.min("day")).first()[0]


def test_unreadable_clock(spark):
    rows = [(i, "2024-01-%02d" % (i % 28 + 1) if i >= 3 else "?") for i in range(40)]
    timed, applied = G.order_by_time(spark.createDataFrame(rows, "id long, d string"), "d")
    assert applied and timed.count() == 37
    mostly = [(i, "2024-01-01" if i % 2 else None) for i in range(40)]
    assert not G.order_by_time(spark.createDataFrame(mostly, "id long, d string"), "d")[1]
    with pytest.raises(G.CannotSplit):
        G.order_by_time(spark.createDataFrame([(1, "x"), (2, "y")], "id long, d string"), "d")


@pytest.mark.parametrize("extra, day_first", [(["15/01/2024"], True), (["15/01/2024", "01/15/2024"], False), ([], False), (["1/15/24 9:00 pm"], False), (["31.1.24 9:00 pm"], True)])
def test_one_reading_of_numeric_dates(spark, extra, day_first):
    """A column that holds days over twelve in first place only is day first in all of its rows."""
    texts = ["05/01/2024", "04/02/2024", "2024-03-01", "March 9, 2024", *extra]
    timed, applied = G.order_by_time(spark.createDataFrame(list(enumerate(texts)), "id int, d string"), "d")
    got = {r["id"]: (r["_time"].month, r["_time"].day) for r in timed.collect()}
    assert applied and len(got) == len(texts)
    assert [got[0], got[1]] == ([(1, 5), (2, 4)] if day_first else [(5, 1), (4, 2)])
    assert [got[2], got[3]] == [(3, 1), (3, 9)]


def test_stratified_sample_keeps_every_class(spark):
    df = spark.createDataFrame([(i, None if i == 0 else "rare" if i == 1 else "common") for i in range(500)], "id long, y string")
    got = {r["y"]: r["count"] for r in G.stratified_sample(df, ["id"], "y", 50).groupBy("y").count().collect()}
    assert got == {None: 1, "rare": 1, "common": 50}


@pytest.mark.parametrize("block", [2048, 7])
def test_neighbours_match_brute_force(spark, block):
    """With a crowd of copies (a third of all rows) and with cells far larger than a block."""
    rng = np.random.default_rng(5)
    x = np.round(np.vstack([np.tile([1.0, 1.0, 1.0], (40, 1)), rng.normal(0, 1, (50, 3)), rng.normal(4, 0.2, (30, 3))]), 3)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "key long, x array<double>")
    k = 4
    got = nearest(df, k, pivots=6, block=block).toPandas()
    full = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(full, np.inf)
    for i in range(len(x)):
        mine = got[got["key"] == i].sort_values("before")
        spread = list(itertools.chain.from_iterable([d] * int(s) for d, s in zip(mine["distance"], mine["slots"])))[:k]
        assert np.allclose(spread, np.sort(full[i])[:k])


def test_neighbours_of_text_keys_in_many_cells(spark):
    rng = np.random.default_rng(6)
    x = np.round(np.vstack([rng.normal(c, 0.3, (60, 4)) for c in range(0, 40, 4)]), 2)
    df = spark.createDataFrame([(f"row {i}", [float(v) for v in r]) for i, r in enumerate(x)], "key string, x array<double>")
    report = {}
    got = nearest(df, 3, report=report).toPandas()
    full = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(full, np.inf)
    for i in range(len(x)):
        mine = got[got["key"] == f"row {i}"].sort_values(["distance", "neighbour"])
        names = sorted(range(len(x)), key=lambda j: (full[i, j], f"row {j}"))[:3]
        if len(set(map(tuple, x))) == len(x):
            assert list(mine["neighbour"]) == [f"row {j}" for j in names]
        assert np.allclose(mine["distance"], np.sort(full[i])[:3])
    assert report["pairs"] < len(x) ** 2 / 4


def test_ball_tree_finds_all_near_pairs():
    rng = np.random.default_rng(8)
    for n, dims, k in ((300, 3, 4), (700, 16, 5), (50, 2, 60), (1, 3, 2)):
        points, own = np.round(rng.normal(size=(n, dims)), 1), np.full(40, -1)
        x = np.round(rng.normal(size=(40, dims)), 1)
        x[:1], own[:1] = points[:1], 0
        who, at, distance = near_pairs(x, np.full(40, np.inf), points, k, own)
        d = np.sqrt(((x[:, None] - points[None]) ** 2).sum(2))
        d[0, 0] = np.inf
        for q in range(40):
            kth = np.sort(d[q])[min(k, n) - 1]
            assert {j for j in range(n) if d[q, j] <= kth and np.isfinite(d[q, j])} <= set(at[who == q])
        assert np.allclose(distance, d[who, at], rtol=1e-12)


def test_memory_of_a_batch_does_not_grow_with_the_pivots():
    rng = np.random.default_rng(0)
    x, centres = rng.normal(size=(4000, 3)), rng.normal(size=(4096, 3))
    cell, r = np.repeat(np.arange(4096), 6), rng.random(6 * 4096)
    tracemalloc.start()
    at, least = nearest_centre(x, centres)
    d = np.sqrt(((x[:512, None] - centres[None]) ** 2).sum(axis=2))
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    kth = kth_reach(d, cell, r, 5)
    for peak in (tracemalloc.get_traced_memory()[1] - held, _peak_of(lambda: nearest_centre(x, centres))):
        assert peak < 64 << 20  # all rows at once: 200 MB and more
    tracemalloc.stop()
    assert np.array_equal(at[:512], d.argmin(1)) and np.allclose(least[:512], d.min(1))
    assert np.array_equal(kth, np.sort(d[:, cell] + r, axis=1)[:, 5])


def _peak_of(work):
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    work()
    return tracemalloc.get_traced_memory()[1] - held


@pytest.mark.parametrize("key", ["'k' || id", "cast(id AS int)", "cast(id AS date)"])
def test_smote_takes_any_key(spark, key):
    if "date" in key:
        key = "date_add(DATE '2020-01-01', cast(id AS int))"
    rows = [(i, "no" if i < 40 else "yes", [float(i % 7), float(i % 5)]) for i in range(52)]
    train = spark.createDataFrame(rows, "id long, y string, features array<double>").selectExpr(f"{key} AS id", "y", "features")
    out = smote(train, "id", "y")
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {"no": 40, "yes": 40}
    keys = {r["id"]: r["y"] for r in train.collect()}
    assert all(keys[r["base"]] == keys[r["neighbour"]] == "yes" for r in out.where("synthetic").collect())


def test_smote_balances_on_segments(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "no", [float(v) for v in rng.normal(0, 1, 2)]) for i in range(60)]
    rows += [(100 + i, "yes", [float(v) for v in rng.normal(5, 1, 2)]) for i in range(12)]
    train = spark.createDataFrame(rows, "id long, y string, features array<double>")
    out = smote(train, "id", "y")
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {"no": 60, "yes": 60}
    points = {r["id"]: np.array(r["features"]) for r in train.collect()}
    for r in out.where("synthetic").collect():
        a, b, p = points[r["base"]], points[r["neighbour"]], np.array(r["features"])
        assert r["base"] >= 100 and r["neighbour"] >= 100
        assert abs(np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b)) < 1e-9


def test_smote_refusals(spark):
    df = spark.createDataFrame([(i, "rare" if i < 5 else "no") for i in range(50)], "id long, y string")
    assert refusal(df, "y", "regression") and refusal(df, "y", "classification") and refusal(df.where("y = 'no'"), "y", "classification")
    assert refusal(df.withColumn("y", F.when(F.col("id") < 20, "a").otherwise("b")), "y", "classification") is None


def test_unknown_label_is_all_zeros(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    test = spark.createDataFrame([("z",)], "c string")
    out = R.Recipe([One("c", "categorical", "most_frequent", "onehot")]).fit(train).transform(test)
    assert out.select(vector_to_array("features").alias("v")).first()["v"] == [0.0, 0.0]
