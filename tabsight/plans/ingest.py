"""Groups A, B and C: ingest rules, profiling and cleaning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tabsight.functions.columns import NUMBER_PATTERN, rounded
from tabsight.operators import clean as C
from tabsight.operators import eda as E
from tabsight.operators import profile as P
from tabsight.plans.dirty import WITH_DIRTY, dirty, dirty_raw
from tabsight.plans.eda import numbers
from tabsight.plans.registry import query, r, table, union_all
from tabsight.sources import csv as S
from tabsight.sources import tables as T

_TOKENS = ", ".join(f"'{t}'" for t in S.MISSING_TOKENS)
_LABELS = ", ".join(f"'{t}'" for t in S.NOT_APPLICABLE)


def sql_number(x):
    return f"CASE WHEN regexp_matches({x}, '{NUMBER_PATTERN}') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def sql_date(x):
    return (
        f"CASE WHEN regexp_matches(trim({x}), '[-/:\\s.]') THEN coalesce(try_strptime(trim({x}), '%Y-%m-%d'), "
        f"try_strptime(trim({x}), '%m/%d/%Y'), try_strptime(trim({x}), '%d/%m/%Y'), try_strptime(trim({x}), '%B %-d, %Y')) END"
    )


# ---- A -------------------------------------------------------------------------------------------


@query(
    "a1_csv_scan",
    f"SELECT o_orderstatus, count(*) AS n, {r('sum(o_totalprice)', 2)} AS total, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus",
)
def _(spark, d):
    path = T.scratch_path(spark, "orders-csv")
    T.write_table(table(spark, d, "orders"), path, "csv")
    back = S.ingest_csv(spark, path)
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"),
        F.count_distinct("o_custkey").alias("customers"),
    )


@query("a2_map_missing", WITH_DIRTY + f" SELECT event_id, CASE WHEN label NOT IN ({_TOKENS}) THEN label END AS label FROM dirty")
def _(spark, d):
    return S.map_missing(dirty(spark, d).select("event_id", "label"))


@query("a3_duplicate_headers", "SELECT 'amount' AS name, CAST(2 AS BIGINT) AS n FROM region HAVING count(*) > 0")
def _(spark, d):
    path = T.scratch_path(spark, "twice-csv")
    orders = table(spark, d, "orders")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), F.col("o_totalprice").cast("string"))

    def with_header(batches):
        # every CSV file starts with its own header line
        yield pd.DataFrame({"value": ['id,"amount",amount']})
        yield from batches

    orders.select(line.alias("value")).mapInPandas(with_header, "value string").write.mode("overwrite").text(path)
    return S.duplicate_headers(spark, path)


@query(
    "a4_recover_numeric",
    WITH_DIRTY
    + f""", e AS (SELECT count(CASE WHEN value_text IN ({_LABELS}) THEN 1 END) AS s, count(CASE WHEN value_text NOT IN ({_LABELS}) THEN 1 END) AS p,
    count(CASE WHEN value_text NOT IN ({_LABELS}) AND regexp_matches(value_text, '{NUMBER_PATTERN}') THEN 1 END) AS n FROM dirty)
    SELECT event_id, label, CASE WHEN (SELECT s > 0 AND n / p >= 0.95 FROM e) THEN {sql_number('value_text')} END AS value_text FROM dirty""",
)
def _(spark, d):
    return S.recover_numeric(dirty(spark, d).select("event_id", "label", "value_text"))


@query(
    "a4_recovery_evidence",
    WITH_DIRTY
    + " "
    + union_all(
        [
            f"""SELECT '{c}' AS "column", count(CASE WHEN {c} IN ({_LABELS}) THEN 1 END) AS sentinels, count(CASE WHEN {c} NOT IN ({_LABELS}) THEN 1 END) AS present,
    count(CASE WHEN {c} NOT IN ({_LABELS}) AND regexp_matches({c}, '{NUMBER_PATTERN}') THEN 1 END) AS numbers,
    sentinels > 0 AND present > 0 AND numbers / present >= 0.95 AS numeric FROM dirty"""
            for c in ["label", "value_text", "date_text"]
        ]
    ),
)
def _(spark, d):
    return S.recoverable_columns(dirty(spark, d).select("label", "value_text", "date_text"))


@query(
    "a5_typed_projection",
    WITH_DIRTY
    + f""" SELECT event_id, {sql_number('value_text')} AS value_text, {sql_date('date_text')} AS date_text, TRY_CAST(CAST(user_id AS VARCHAR) AS BIGINT) AS user_text,
    CASE WHEN flag = 1 THEN true ELSE false END AS flag_text FROM dirty""",
)
def _(spark, d):
    text = dirty(spark, d).select(
        "event_id", "value_text", "date_text", F.col("user_id").cast("string").alias("user_text"), F.when(F.col("flag") == 1, "True").otherwise("False").alias("flag_text")
    )
    return S.apply_schema(text, {"value_text": "double", "date_text": "timestamp", "user_text": "bigint", "flag_text": "boolean"})


@query(
    "a7_preview",
    """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS row FROM customer ORDER BY c_custkey LIMIT 10""",
)
def _(spark, d):
    return S.preview(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"])


@query(
    "a8_parquet_round_trip",
    f"SELECT p_type, count(*) AS n, {r('sum(p_retailprice)', 2)} AS price FROM part GROUP BY p_type",
)
def _(spark, d):
    path = T.scratch_path(spark, "part-parquet")
    T.write_table(table(spark, d, "part"), path, partition_by=["p_type"])
    return T.read_table(spark, path).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("p_retailprice"), 2).alias("price"))


@query(
    "a9_report_sink",
    "SELECT o_orderstatus AS label, count(*) AS n, 'second' AS run_id FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*), 'first' FROM orders GROUP BY 1",
)
def _(spark, d):
    folder = T.scratch_path(spark, "reports")
    orders = table(spark, d, "orders")
    for run, column in (("first", "o_orderstatus"), ("second", "o_orderstatus"), ("first", "o_orderpriority")):
        T.write_report(E.class_balance(orders, column).select("label", "n"), folder, "class_balance", run)
    return T.read_report(spark, folder, "class_balance")


# ---- B -------------------------------------------------------------------------------------------

_PROFILED = ["event_id", "value", "value_text", "date_text", "label", "email", "phone", "constant", "sparse", "flag"]
_TEXT = {"value_text", "date_text", "label", "email", "phone", "constant"}
_EMPTY_PII = "NULL"


def _profile_sql(columns, text, source, longs=()):
    parts = []
    for i, c in enumerate(columns):
        nn = f"count({c})"
        uniq = f"count(DISTINCT {c})"
        if c in text:
            tested = f"({c} IS NOT NULL AND trim({c}) NOT IN ({_LABELS}))"
            n_tested = f"count(CASE WHEN {tested} THEN 1 END)"
            sep = f"count(CASE WHEN {tested} AND regexp_matches(trim({c}), '[-/:\\s.]') THEN 1 END)"
            parsed = f"count(CASE WHEN {tested} THEN {sql_date(c)} END)"
            semantic = (
                f"CASE WHEN {uniq} = 0 THEN 'categorical' WHEN {sep} > 0 AND {parsed} / {n_tested} >= 0.9 THEN 'datetime' "
                f"WHEN {uniq} <= 20 OR {uniq} < 0.5 * {nn} THEN 'categorical' ELSE 'text' END"
            )

            def share(p):
                return f"count(CASE WHEN regexp_matches({c}, '{p}') THEN 1 END) / {nn} >= 0.8"

            pii = f"CASE WHEN {semantic} IN ('datetime', 'boolean') THEN NULL WHEN {share(P.EMAIL)} THEN 'email' WHEN {share(P.SSN)} THEN 'ssn' WHEN {share(P.PHONE)} THEN 'phone' END"
            dtype = "string"
        else:
            semantic = f"CASE WHEN {uniq} = 0 OR ({uniq} <= 2 AND min({c}) IN (0, 1) AND max({c}) IN (0, 1)) THEN 'boolean' ELSE 'numeric' END"
            pii = "CAST(NULL AS VARCHAR)"
            dtype = "bigint" if c in longs else "double"
        parts.append(
            f"""SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS "column", '{dtype}' AS dtype, count(*) AS n_rows, count(*) - {nn} AS null_count,
        {r(f'(count(*) - {nn}) / count(*)')} AS null_rate, {uniq} AS n_unique, {semantic} AS semantic_type, {pii} AS pii_type FROM {source}"""
        )
    return f"SELECT *, pii_type IS NOT NULL AS is_pii, pii_type IS NOT NULL AS exclude FROM ({union_all(parts)})"


def _dirty_profile(spark, d):
    return P.profile(dirty(spark, d).select(*_PROFILED))


_PROFILE = _profile_sql(_PROFILED, _TEXT, "dirty", {"event_id", "flag"})


@query("b1_column_profile", _profile_sql(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"], {"o_orderstatus", "o_orderpriority"}, "orders", {"o_orderkey", "o_custkey"}))
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return numbers(P.profile(orders), 6)


@query("b2_semantic_type", f"{WITH_DIRTY} {_PROFILE}")
def _(spark, d):
    return numbers(_dirty_profile(spark, d), 6)


@query(
    "b3_date_like",
    WITH_DIRTY
    + " "
    + union_all(
        [
            f"""SELECT '{c}' AS "column", count(CASE WHEN trim({c}) NOT IN ({_LABELS}) THEN 1 END) AS tested,
    count(CASE WHEN trim({c}) NOT IN ({_LABELS}) AND regexp_matches(trim({c}), '[-/:\\s.]') THEN 1 END) AS separated,
    count(CASE WHEN trim({c}) NOT IN ({_LABELS}) THEN {sql_date(c)} END) AS parsed, separated > 0 AND parsed / tested >= 0.9 AS looks_like_datetime FROM dirty"""
            for c in ["date_text", "value_text", "label"]
        ]
    ),
)
def _(spark, d):
    return P.datetime_evidence(dirty(spark, d), ["date_text", "value_text", "label"])


@query(
    "b4_detect_pii",
    WITH_DIRTY
    + " "
    + union_all(
        [
            f"""SELECT '{c}' AS "column", {r(f"count(CASE WHEN regexp_matches({c}, '{P.EMAIL}') THEN 1 END) / count({c})")} AS email,
    {r(f"count(CASE WHEN regexp_matches({c}, '{P.SSN}') THEN 1 END) / count({c})")} AS ssn, {r(f"count(CASE WHEN regexp_matches({c}, '{P.PHONE}') THEN 1 END) / count({c})")} AS phone,
    CASE WHEN count(CASE WHEN regexp_matches({c}, '{P.EMAIL}') THEN 1 END) / count({c}) >= 0.8 THEN 'email' WHEN count(CASE WHEN regexp_matches({c}, '{P.PHONE}') THEN 1 END) / count({c}) >= 0.8 THEN 'phone' END AS pii_type FROM dirty"""
            for c in ["email", "phone", "label", "value_text"]
        ]
    ),
)
def _(spark, d):
    return numbers(P.pii_evidence(dirty(spark, d), ["email", "phone", "label", "value_text"]), 6)


@query("b5_default_exclusions", f"""{WITH_DIRTY} SELECT "column", pii_type FROM ({_PROFILE}) WHERE is_pii AND "column" <> 'phone'""")
def _(spark, d):
    return P.default_exclusions(_dirty_profile(spark, d), "phone")


_SAMPLED = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@query(
    "b6_sample_values",
    union_all(
        [
            f"""SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, row_number() OVER (ORDER BY min(o_orderkey), CAST({c} AS VARCHAR)) AS position
    FROM orders GROUP BY {c}) WHERE position <= 5"""
            for c in _SAMPLED
        ]
    ),
)
def _(spark, d):
    return P.sample_values(table(spark, d, "orders").select("o_orderkey", *_SAMPLED), "o_orderkey")


@query(
    "b7_suggest_target",
    f"""{WITH_DIRTY} SELECT arg_max("column", ordinal) AS target FROM ({_PROFILE}) WHERE NOT is_pii AND n_unique > 1""",
)
def _(spark, d):
    return P.suggest_target(_dirty_profile(spark, d))


@query(
    "b8_infer_task",
    f"""{WITH_DIRTY} SELECT "column" AS target, CASE WHEN semantic_type IN ('categorical', 'boolean', 'text') OR n_unique <= 20 THEN 'classification' ELSE 'regression' END AS task
    FROM ({_PROFILE}) WHERE "column" IN ('value', 'flag')""",
)
def _(spark, d):
    report = _dirty_profile(spark, d)
    return P.infer_task(report, "value").unionByName(P.infer_task(report, "flag"))


@query(
    "b9_class_balance",
    f"""WITH c AS (SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1)
    SELECT label, n, {r('(SELECT max(n) / min(n) FROM c)')} AS imbalance_ratio, (SELECT max(n) / min(n) FROM c) > 1.5 AS imbalanced FROM c""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id")
    return numbers(E.class_balance(docs, "quality"), 6)


@query(
    "b10_target_distribution",
    f"""SELECT event_type, {r('min(value)')} AS minimum, {r('max(value)')} AS maximum, {r('avg(value)')} AS mean, {r('skewness(value)', 5)} AS skew,
    {r('median(value)')} AS median, abs(skewness(value)) >= 2 AS heavy_tailed FROM events GROUP BY event_type""",
)
def _(spark, d):
    out = E.target_distribution(table(spark, d, "events"), "value", ["event_type"])
    return out.select(
        "event_type", *[rounded(F.col(c)).alias(c) for c in ("minimum", "maximum", "mean", "median")], rounded(F.col("skew"), 5).alias("skew"), "heavy_tailed"
    )


@query(
    "b11_retarget",
    """SELECT 'class_balance' AS part, count(DISTINCT event_type) AS n FROM events UNION ALL SELECT 'columns' AS part, CAST(4 AS BIGINT) AS n FROM events HAVING count(*) > 0""",
)
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    parts = P.retarget(P.profile(events), events, "event_type", "classification")
    return parts["columns"].agg(F.lit("columns").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(
        parts["class_balance"].agg(F.lit("class_balance").alias("part"), F.count(F.lit(1)).alias("n"))
    )


# ---- C -------------------------------------------------------------------------------------------


@query("c1_drop_excluded", WITH_DIRTY + " SELECT event_id, value FROM dirty")
def _(spark, d):
    return C.drop_excluded(dirty(spark, d).select("event_id", "value", "email", "phone"), ["email", "phone", "value"], "value")


@query("c2_drop_missing_target", WITH_DIRTY + " SELECT event_id, value FROM dirty WHERE value IS NOT NULL")
def _(spark, d):
    return C.drop_missing_target(dirty(spark, d).select("event_id", "value"), "value")


@query("c3_drop_nonfinite_target", WITH_DIRTY + f" SELECT event_id, value_text FROM dirty WHERE {sql_number('value_text')} IS NOT NULL")
def _(spark, d):
    return C.drop_nonfinite_target(dirty(spark, d).select("event_id", "value_text"), "value_text")


_TAIL = "SELECT quantile_cont(value, 0.005) AS lower, quantile_cont(value, 0.995) AS upper FROM events"


@query(
    "c4_target_tail",
    f"""WITH q AS ({_TAIL}) SELECT {r('lower')} AS lower, {r('upper')} AS upper, {r('(SELECT median(value) FROM events)')} AS median,
    {r('(SELECT max(value) FROM events)')} AS maximum, (SELECT count(*) FROM events WHERE value < lower OR value > upper) AS n FROM q""",
)
def _(spark, d):
    return numbers(C.target_tail(table(spark, d, "events"), "value"), 6)


@query("c5_trim_target", f"WITH q AS ({_TAIL}) SELECT event_id, value FROM events, q WHERE value BETWEEN lower AND upper")
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "value")
    bounds = C.target_tail(events, "value").first()
    return C.trim_target(events, "value", bounds["lower"], bounds["upper"])


@query("c6_drop_duplicate_rows", WITH_DIRTY + " SELECT DISTINCT event_id, event_type, value, label, sparse FROM dirty")
def _(spark, d):
    return C.drop_duplicate_rows(dirty(spark, d).select("event_id", "event_type", "value", "label", "sparse"))


_SEMANTICS = {"date_text": "datetime", "value_text": "text", "label": "categorical", "email": "text"}


@query(
    "c7_coercion_evidence",
    WITH_DIRTY
    + f""" SELECT 'date_text' AS "column", 'timestamp' AS to_type, count(date_text) AS had, count({sql_date('date_text')}) AS kept, kept / had >= 0.95 AS accepted FROM dirty
    UNION ALL SELECT 'value_text', 'double', count(value_text) AS had, count({sql_number('value_text')}) AS kept, kept / had >= 0.95 FROM dirty
    UNION ALL SELECT 'email', 'double', count(email) AS had, count({sql_number('email')}) AS kept, kept / had >= 0.95 FROM dirty""",
)
def _(spark, d):
    return C.coercion_evidence(dirty(spark, d).select("date_text", "value_text", "label", "email"), _SEMANTICS)


@query("c7_correct_dtypes", WITH_DIRTY + f" SELECT event_id, {sql_date('date_text')} AS date_text, {sql_number('value_text')} AS value_text, label, email FROM dirty")
def _(spark, d):
    return C.correct_dtypes(dirty(spark, d).select("event_id", "date_text", "value_text", "label", "email"), _SEMANTICS)


@query("c8_mixed_dates", WITH_DIRTY + f" SELECT event_id, {sql_date('date_text')} AS day FROM dirty")
def _(spark, d):
    from tabsight.functions.columns import parse_datetime

    return dirty(spark, d).select("event_id", parse_datetime(F.col("date_text")).alias("day"))


#: Layouts of a date, each with the SQL of what it says; the texts are made from the events' times and parsed again.
_DAY = "date_trunc('day', ts)"
_SWAPPED = f"CASE WHEN day(ts) <= 12 THEN make_timestamp(year(ts), day(ts), month(ts), 0, 0, 0) ELSE {_DAY} END"
DATE_LAYOUTS = (
    ("yyyy-MM-dd", _DAY),
    ("yyyy-MM-dd HH:mm", "date_trunc('minute', ts)"),
    ("yyyy-MM-dd HH:mm:ss", "date_trunc('second', ts)"),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "date_trunc('second', ts)"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSS'+02:30'", "date_trunc('millisecond', ts) - INTERVAL 150 MINUTE"),
    ("MM/dd/yyyy", _DAY),
    ("dd/MM/yyyy", _SWAPPED),
    ("dd.MM.yyyy HH:mm", f"CASE WHEN day(ts) <= 12 THEN {_SWAPPED} + (date_trunc('minute', ts) - {_DAY}) ELSE date_trunc('minute', ts) END"),
    ("dd MMM yyyy", _DAY),
    ("MMMM d, yyyy", _DAY),
    ("EEE, MMM d, yyyy h:mm a", "date_trunc('minute', ts)"),
    ("yyyy/M/d", _DAY),
    ("d-MMM-yy", _DAY),
    ("MMMM yyyy", "date_trunc('month', ts)"),
)


@query(
    "c8_date_layouts",
    f"SELECT event_id, CASE event_id % {len(DATE_LAYOUTS)} "
    + " ".join(f"WHEN {i} THEN {said}" for i, (_, said) in enumerate(DATE_LAYOUTS))
    + " END AS moment FROM events",
)
def _(spark, d):
    from tabsight.functions.columns import parse_datetime

    text = F.lit(None).cast("string")
    for i, (layout, _) in enumerate(DATE_LAYOUTS):
        text = F.when(F.col("event_id") % len(DATE_LAYOUTS) == i, F.date_format("ts", layout)).otherwise(text)
    return table(spark, d, "events").select("event_id", parse_datetime(text).alias("moment"))


@query("c9_drop_constant", WITH_DIRTY + " SELECT event_id, value, label FROM dirty")
def _(spark, d):
    return C.drop_constant(dirty(spark, d).select("event_id", "value", "label", "constant"), "value")


@query("c10_drop_sparse", WITH_DIRTY + " SELECT event_id, value, label FROM dirty")
def _(spark, d):
    return C.drop_sparse(dirty(spark, d).select("event_id", "value", "label", "sparse"), "value")


_KEPT = ["event_id", "value", "sparse", "label", "constant"]


@query(
    "c11_missing_report",
    WITH_DIRTY + " SELECT * FROM (" + union_all([f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing FROM dirty""" for c in _KEPT]) + ") WHERE missing > 0",
)
def _(spark, d):
    return C.missing_report(dirty(spark, d).select(*_KEPT))


@query(
    "c12_usability",
    WITH_DIRTY
    + """ SELECT 'value' AS target, true AS usable FROM dirty HAVING count(*) >= 2 UNION ALL SELECT 'constant', count(DISTINCT constant) >= 2 FROM dirty""",
)
def _(spark, d):
    frame = dirty(spark, d).select("event_id", "value", "constant")
    rows = []
    for target in ("value", "constant"):
        try:
            C.guard_usable(frame, target)
            rows.append((target, True))
        except C.NothingLeft:
            rows.append((target, False))
    return spark.createDataFrame(rows, "target string, usable boolean")


_CLEANED = "user_id, event_type, value, value_text, date_text, constant, sparse"


@query(
    "c13_cleaning_report",
    WITH_DIRTY
    + f""", kept AS (SELECT {_CLEANED} FROM dirty WHERE value IS NOT NULL), q AS (SELECT quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM kept),
    inside AS (SELECT kept.* FROM kept, q WHERE value BETWEEN lo AND hi)
    SELECT 'rows_before' AS step, count(*) AS n FROM dirty UNION ALL SELECT 'missing_target', count(*) - count(value) FROM dirty
    UNION ALL SELECT 'nonfinite_target', 0 UNION ALL SELECT 'rows_before_duplicates', count(*) FROM inside
    UNION ALL SELECT 'rows_after', count(*) FROM (SELECT DISTINCT * FROM inside) UNION ALL SELECT 'trimmed_target', count(*) FROM kept, q WHERE value < lo OR value > hi
    UNION ALL SELECT 'columns_before', 8 UNION ALL SELECT 'columns_after', 5""",
)
def _(spark, d):
    frame = dirty(spark, d).select("user_id", "event_type", "value", "value_text", "date_text", "label", "constant", "sparse")
    return C.clean(frame, "value", "regression", _SEMANTICS, excluded=["label"], trim=True).steps
