import datetime as dt

import pytest

from tabsight.operators import clean as C
from tabsight.operators import profile as P
from tabsight.sources import csv as S
from tabsight.sources import tables as T


def write(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_na_stays_a_label(spark, tmp_path):
    df = S.ingest_csv(spark, write(tmp_path, "id,quality\n1,NA\n2,Good\n3,NA\n4,\n5,null\n"))
    assert [r["quality"] for r in df.orderBy("id").collect()] == ["NA", "Good", "NA", None, None]


def test_numeric_column_recovers_from_na(spark, tmp_path):
    df = S.ingest_csv(spark, write(tmp_path, "id,frontage\n1,65\n2,NA\n3,80\n4,70\n"))
    assert [r["frontage"] for r in df.orderBy("id").collect()] == [65.0, None, 80.0, 70.0]


def test_one_stray_word_does_not_flip_the_column(spark, tmp_path):
    lines = [f"{i},{i}" for i in range(40)] + ["40,NA", "41,unknown"]
    df = S.ingest_csv(spark, write(tmp_path, "id,n\n" + "\n".join(lines)))
    values = [r["n"] for r in df.collect()]
    assert sum(v is None for v in values) == 2 and sum(v for v in values if v is not None) == sum(range(40))


def test_only_sentinels_are_left_alone(spark, tmp_path):
    df = S.ingest_csv(spark, write(tmp_path, "a,b\n1,NA\n2,NA\n"))
    assert [r["b"] for r in df.collect()] == ["NA", "NA"]


def test_types_are_inferred_from_all_values(spark, tmp_path):
    df = S.ingest_csv(spark, write(tmp_path, "a,b,c,d\n1,1.5,True,x\n2,2,False,1d\n"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string"}


def test_quoted_fields(spark, tmp_path):
    df = S.ingest_csv(spark, write(tmp_path, 'a,b\n1,"x, ""y"""\n'))
    assert df.first()["b"] == 'x, "y"'


def test_duplicate_headers_are_refused(spark, tmp_path):
    with pytest.raises(S.UnusableTable, match="amount"):
        S.ingest_csv(spark, write(tmp_path, "amount,x,amount\n1,2,3\n"))


@pytest.mark.parametrize("text", ["only\n1\n", "a,b\n"])
def test_unusable_tables(spark, tmp_path, text):
    with pytest.raises(S.UnusableTable):
        S.ingest_csv(spark, write(tmp_path, text))


def test_report_sink_replaces_only_its_run(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "n long")
    for run, rows in (("a", df), ("b", df), ("a", df.limit(1))):
        T.write_report(rows, str(tmp_path), "numbers", run)
    back = T.read_report(spark, str(tmp_path), "numbers")
    assert {r["run_id"]: r["count"] for r in back.groupBy("run_id").count().collect()} == {"a": 1, "b": 2}


# ---- profiling -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def basic(spark):
    rows = [
        ("a@x.com", 25, "London", "yes"),
        ("b@x.com", 31, "Leeds", "no"),
        ("c@x.com", None, "London", "no"),
        ("d@x.com", 44, "London", "no"),
        ("d@x.com", 44, "London", "no"),
        ("e@x.com", 52, "Leeds", "no"),
    ]
    return spark.createDataFrame(rows, "email string, age long, city string, churn string")


def test_profile(basic):
    got = {r["column"]: r for r in P.profile(basic).collect()}
    assert got["email"]["pii_type"] == "email" and got["email"]["exclude"]
    assert got["age"]["null_count"] == 1 and got["age"]["semantic_type"] == "numeric"
    assert got["city"]["semantic_type"] == "categorical" and got["city"]["n_unique"] == 2
    report = P.profile(basic)
    assert P.suggest_target(report).first()["target"] == "churn"
    assert P.infer_task(report, "churn").first()["task"] == "classification"


def test_annotation_adds_but_never_removes(basic):
    got = {r["column"]: r["is_pii"] for r in P.annotate(P.profile(basic), {"city": "place", "nowhere": "x"}).collect()}
    assert got == {"email": True, "age": False, "city": True, "churn": False}


def test_zero_one_is_boolean_and_phone_needs_text(spark):
    df = spark.createDataFrame([(0, 2079460000, "+44 20 7946 0000"), (1, 2079460001, "020 7946 0001")], "f long, n long, p string")
    got = {r["column"]: r for r in P.profile(df).collect()}
    assert got["f"]["semantic_type"] == "boolean"
    assert got["n"]["pii_type"] is None and got["p"]["pii_type"] == "phone"


def test_bare_digits_are_not_dates(spark):
    df = spark.createDataFrame([("20240101", "2024-01-01"), ("20240102", "02/01/2024"), ("20240103", "NA")], "a string, b string")
    got = {r["column"]: r["looks_like_datetime"] for r in P.datetime_evidence(df, ["a", "b"]).collect()}
    assert got == {"a": False, "b": True}


# ---- cleaning ------------------------------------------------------------------------------------


def test_clean_basic(basic):
    out = C.clean(basic, "churn", "classification", excluded=["email", "churn"])
    assert out.df.columns == ["age", "city", "churn"]
    steps = {r["step"]: r["n"] for r in out.steps.collect()}
    assert steps["rows_before"] == 6 and steps["rows_after"] == 5
    assert {r["column"]: r["missing"] for r in out.remaining.collect()} == {"age": 1}


def test_constant_and_sparse_columns_go(spark):
    df = spark.createDataFrame([(i, "k", None if i % 4 else 1.0 * i, i % 2) for i in range(20)], "a long, k string, s double, y long")
    out = C.clean(df, "y", "classification")
    assert out.df.columns == ["a", "y"]
    assert dict(out.dropped) == {"k": "constant", "s": "mostly missing"}


def test_classification_target_is_never_coerced(spark):
    df = spark.createDataFrame([(str(i), str(i % 3)) for i in range(30)], "x string, y string")
    out = C.correct_dtypes(df, {"x": "text", "y": "text"}, "y", "classification")
    assert dict(out.dtypes) == {"x": "double", "y": "string"}


def test_target_tail_needs_rows_and_spread(spark):
    few = spark.createDataFrame([(float(i),) for i in range(100)], "y double")
    flat = spark.createDataFrame([(1.0,)] * 500, "y double")
    tailed = spark.createDataFrame([(float(i),) for i in range(1000)] + [(1e6,)] * 4, "y double")
    assert C.target_tail(few, "y").isEmpty() and C.target_tail(flat, "y").isEmpty()
    row = C.target_tail(tailed, "y").first()
    assert row["maximum"] == 1e6 and row["n"] > 0


def test_infinite_targets_go(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (None,), (2.0,)], "y double")
    assert C.drop_nonfinite_target(df, "y").count() == 2


def test_mixed_dates(spark):
    from pyspark.sql import functions as F

    from tabsight.functions.columns import parse_datetime

    said = {
        "2024-03-09": (2024, 3, 9),
        "03/09/2024": (2024, 3, 9),
        "05/03/2024": (2024, 5, 3),
        "15/01/2024": (2024, 1, 15),
        "1/5/24": (2024, 1, 5),
        "1-5-69": (1969, 1, 5),
        "15.01.2024 7:05": (2024, 1, 15, 7, 5),
        "2024-01-15 09:00": (2024, 1, 15, 9),
        "2024/1/5": (2024, 1, 5),
        "15 Jan 2024": (2024, 1, 15),
        "15th of January, 2024": (2024, 1, 15),
        "  March 9, 2024 ": (2024, 3, 9),
        "Sept. 9 2024": (2024, 9, 9),
        "Monday, January 15, 2024 12:30 AM": (2024, 1, 15, 0, 30),
        "jan 15, 2024 12:30 pm": (2024, 1, 15, 12, 30),
        "2024-01-15T09:00:01Z": (2024, 1, 15, 9, 0, 1),
        "2024-01-15T09:00:01.5": (2024, 1, 15, 9, 0, 1, 500000),
        "2024-01-15 00:30:00.123456789-0500": (2024, 1, 15, 5, 30, 0, 123456),
        "2024-01-15T00:30+01": (2024, 1, 14, 23, 30),
        "29 February 2024": (2024, 2, 29),
        "2024-01-15 09:00 UTC": (2024, 1, 15, 9),
        "01/15/2024 09:00:00gmt": (2024, 1, 15, 9),
        "15-Jan-24 9:00 +0130": (2024, 1, 15, 7, 30),
    }
    wrong = ["soon", "1000", "20240109", "2024-02-30", "13/13/2024", "29 February 2023", "2024-01/15", "2024-01-15 25:00", "12.5", "1.2.3.4", "Mayor 5, 2024", "", None]
    df = spark.createDataFrame([(x,) for x in [*said, *wrong]], "d string")
    got = {r[0]: r[1] for r in df.select("d", parse_datetime(F.col("d"))).collect()}
    assert got == {x: dt.datetime(*y) for x, y in said.items()} | dict.fromkeys(wrong)


def test_guard(spark):
    with pytest.raises(C.NothingLeft):
        C.guard_usable(spark.createDataFrame([(1, "a"), (2, "a")], "x long, y string"), "y")
