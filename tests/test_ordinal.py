"""The small-input shortcut and the distributed way must agree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.operators.ordinal import average_rank, hashed_ordinal, ordinal, quantiles, running_total


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value and one group."""
    rng = np.random.default_rng(1)
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 7}", 5.0 if i % 3 == 0 else float(np.round(rng.exponential(10), 1))) for i in range(900)]
    return spark.createDataFrame(rows, "id long, g string, v double").cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ordinal_paths_agree(skewed):
    order = ["v", "id"]
    assert rows(ordinal(skewed, order, ["g"], small=True)) == rows(ordinal(skewed, order, ["g"], small=False))
    assert rows(ordinal(skewed, order, small=True)) == rows(ordinal(skewed, order, small=False))


def test_ordinal_descending(skewed):
    order = [F.col("v").desc(), F.col("id")]
    assert rows(ordinal(skewed, order, small=True)) == rows(ordinal(skewed, order, small=False))


def test_hashed_ordinal_paths_agree(skewed):
    assert rows(hashed_ordinal(skewed, ["id"], by=["g"], small=True)) == rows(hashed_ordinal(skewed, ["id"], by=["g"], small=False))


def test_running_total_paths_agree(skewed):
    counts = skewed.groupBy("g", "v").count()
    a = running_total(counts, ["v"], {"upto": "count"}, ["g"], small=True)
    assert rows(a) == rows(running_total(counts, ["v"], {"upto": "count"}, ["g"], small=False))


def test_average_rank_matches_pandas(skewed):
    expected = skewed.toPandas().set_index("id")["v"].rank()
    for small in (True, False):
        got = average_rank(skewed, "v", small=small).toPandas().set_index("id")["rank"]
        assert np.allclose(got.loc[expected.index], expected)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_paths_agree_with_pandas(skewed, by):
    probs = [0.0, 0.005, 0.25, 0.5, 0.9, 1.0]
    pdf = skewed.toPandas()
    groups = dict(list(pdf.groupby("g"))) if by else {None: pdf}
    for small in (True, False):
        for r in quantiles(skewed, ["v"], probs, by, small=small).collect():
            part = groups[r["g"] if by else None]
            assert np.allclose(r["q"], part["v"].quantile(probs).to_numpy())


def test_quantiles_with_gaps_and_several_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 4.0), (None, 8.0), (10.0, None)], "a double, b double")
    for small in (True, False):
        got = {r["column"]: list(r["q"]) for r in quantiles(df, ["a", "b"], [0.5], small=small).collect()}
        assert got == {"a": [2.0], "b": [6.0]}


@pytest.mark.parametrize("groups", [7, 0])
def test_only_values_about_a_quantile_are_ranked(spark, monkeypatch, groups):
    """30 000 different values a group with many copies of two: few rows are left to rank, and the result is exact. A sketch that
    misses, or too many groups, lead to the other way."""
    from tabsight.operators import ordinal as module

    df = spark.range(60_000).selectExpr("id % 2 AS g", "CASE WHEN id % 5 = 0 THEN 3.0 WHEN id % 7 = 0 THEN 9000.5 ELSE sqrt(id) * 40 END AS v")
    seen = []
    counted = module.counted_quantiles
    monkeypatch.setattr(module, "SKETCH_GROUPS", groups)
    monkeypatch.setattr(module, "counted_quantiles", lambda *a, **b: seen.append(1) or counted(*a, **b))
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["g"]: r["q"] for r in quantiles(df, ["v"], probs, ["g"], small=False).collect()}
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], part["v"].quantile(probs).to_numpy(), rtol=1e-12)
    assert bool(seen) == (groups == 0)
    if groups:
        monkeypatch.setattr(module.F, "percentile_approx", lambda c, p, a: module.F.array(*[module.F.min(c)] * 2 * len(probs)))
        again = {r["g"]: r["q"] for r in quantiles(df, ["v"], probs, ["g"], small=False).collect()}
        assert seen and again == got


def test_hashed_ordinal_leaves_one_task_early(spark):
    """Three megabytes of keys are many rows: they are ordered in buckets, not by one task."""
    df = spark.range(400_000)
    plan = hashed_ordinal(df, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan
    assert "_bucket" not in hashed_ordinal(df.limit(10), ["id"])._jdf.queryExecution().optimizedPlan().toString()
