"""Group D: exploratory statistics and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.functions.columns import rounded
from tabsight.operators import eda as E
from tabsight.plans.dirty import WITH_DIRTY, dirty
from tabsight.plans.registry import query, r, table, union_all

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def numbers(df, digits=4):
    return df.select(*[rounded(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema])


def _outliers(c, source):
    return (
        f"(WITH q AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {source}) SELECT CASE WHEN b - a <= 0 THEN 0 ELSE "
        f"(SELECT count(*) FROM {source} WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) END FROM q)"
    )


def _summary(c, source):
    return f"""{r(f'avg({c})', 4)} AS mean, {r(f'stddev_pop({c})', 4)} AS std, {r(f'min({c})', 4)} AS minimum, {r(f'max({c})', 4)} AS maximum,
    {r(f'quantile_cont({c}, 0.25)', 4)} AS q1, {r(f'median({c})', 4)} AS median, {r(f'quantile_cont({c}, 0.75)', 4)} AS q3, {_outliers(c, source)} AS outlier_count"""


@query("d1_numeric_summary", union_all([f"""SELECT '{c}' AS "column", {_summary(c, 'lineitem')} FROM lineitem""" for c in LINE]))
def _(spark, d):
    return numbers(E.numeric_summary(table(spark, d, "lineitem"), LINE))


@query(
    "d2_outlier_counts",
    WITH_DIRTY + " " + union_all([f"""SELECT '{c}' AS "column", {_outliers(c, 'dirty')} AS outlier_count""" for c in ["value", "sparse", "flag"]]),
)
def _(spark, d):
    return E.outlier_counts(dirty(spark, d), ["value", "sparse", "flag"])


_CAT = ["o_orderstatus", "o_orderpriority"]


def _top(source, columns, k=10):
    return union_all(
        [
            f"""SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n, count(*) OVER () AS n_unique,
        row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS position FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE position <= {k}"""
            for c in columns
        ]
    )


@query("d3_category_summary", _top("part", ["p_brand", "p_type", "p_name"]))
def _(spark, d):
    return E.category_summary(table(spark, d, "part"), ["p_brand", "p_type", "p_name"])


def _describe_sql():
    parts = []
    for c in ["event_id", "user_id", "value", "sparse", "flag"]:
        parts.append(
            f"""SELECT '{c}' AS "column", 'numeric' AS kind, count({c}) AS count, count(*) - count({c}) AS missing, {r(f'(count(*) - count({c})) / count(*)')} AS missing_rate,
        {_summary(c, 'dirty')}, NULL AS n_unique, NULL AS top_value, NULL AS top_count FROM dirty"""
        )
    for c, kind in [("event_type", "categorical"), ("value_text", "categorical"), ("label", "categorical"), ("constant", "categorical")]:
        parts.append(
            f"""SELECT '{c}' AS "column", '{kind}' AS kind, count({c}) AS count, count(*) - count({c}) AS missing, {r(f'(count(*) - count({c})) / count(*)')} AS missing_rate,
        NULL AS mean, NULL AS std, NULL AS minimum, NULL AS maximum, NULL AS q1, NULL AS median, NULL AS q3, NULL AS outlier_count, count(DISTINCT {c}) AS n_unique,
        (SELECT {c} FROM dirty WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top_value,
        (SELECT count(*) FROM dirty WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS top_count FROM dirty"""
        )
    return WITH_DIRTY + " " + union_all(parts)


@query("d4_describe_columns", _describe_sql())
def _(spark, d):
    chosen = dirty(spark, d).select("event_id", "user_id", "value", "sparse", "flag", "event_type", "value_text", "label", "constant")
    out = E.describe_columns(chosen)
    return out.select(
        *[
            rounded(F.col(f.name), 6 if f.name == "missing_rate" else 4).alias(f.name) if f.dataType.typeName() == "double" else f.name
            for f in out.schema
        ]
    )


def _pairs(columns, source):
    return union_all(
        [
            f"""SELECT '{a}' AS "left", '{b}' AS "right", {r(f'corr({a}, {b})')} AS correlation FROM {source}"""
            for i, a in enumerate(columns)
            for b in columns[i + 1 :]
        ]
    )


_CORR = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE]


_MIXED = ["event_id", "user_id", "value", "sparse", "flag"]


@query("d5_top_correlations", f"{WITH_DIRTY} SELECT * FROM ({_pairs(_MIXED, 'dirty')}) WHERE abs(correlation) >= 0.1 ORDER BY abs(correlation) DESC LIMIT 10")
def _(spark, d):
    return numbers(E.top_correlations(dirty(spark, d), _MIXED), 6)


@query("d6_correlation_matrix", _pairs(_CORR, "lineitem"))
def _(spark, d):
    return numbers(E.correlation_matrix(table(spark, d, "lineitem"), _CORR), 6)


@query(
    "d6_correlation_wide",
    f"""WITH u AS (SELECT vec_id, 'e' || lpad(CAST(i AS VARCHAR), 2, '0') AS name, CASE WHEN vec_id % 11 <> i % 11 THEN CAST(embedding[i + 1] AS DOUBLE) END AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS i))
    SELECT a.name AS "left", b.name AS "right", {r('corr(a.v, b.v)', 6)} AS correlation FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.name < b.name WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    wide = table(spark, d, "embeddings").select(
        *[F.when(F.col("vec_id") % 11 != i % 11, F.col("embedding")[i].cast("double")).alias(f"e{i:02d}") for i in range(64)]
    )
    return numbers(E.correlation_matrix(wide), 6)


@query(
    "d7_heatmap_columns",
    f"SELECT * FROM ({union_all([f'''SELECT '{c}' AS \"column\", {r(f'stddev_pop({c})', 4)} AS spread FROM lineitem''' for c in _CORR])}) ORDER BY spread DESC LIMIT 25",
)
def _(spark, d):
    return numbers(E.heatmap_columns(table(spark, d, "lineitem")), 4)


def _histogram_sql(columns, source, with_clause=""):
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS "column", CAST(least(floor(({c} - lo) / w), k - 1) AS BIGINT) AS bin, lo, w, count(*) AS n FROM {source},
        (SELECT lo, k, CASE WHEN hi > lo THEN (hi - lo) / k ELSE 1.0 END AS w FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi,
        greatest(5, least(40, floor(log2(count({c}))) + 1)) AS k FROM {source})) WHERE {c} IS NOT NULL GROUP BY ALL"""
        )
    return with_clause + f""" SELECT "column", bin, {r('lo + w * bin')} AS lower, {r('lo + w * (bin + 1)')} AS upper, n FROM ({union_all(parts)})"""


@query("d8_histogram", _histogram_sql(["value", "sparse", "flag"], "dirty", WITH_DIRTY))
def _(spark, d):
    return numbers(E.histogram(dirty(spark, d), ["value", "sparse", "flag"]), 6)


@query(
    "d9_boxplot_stats",
    union_all(
        [
            f"""SELECT '{c}' AS "column", {r('q1')} AS q1, {r('m')} AS median, {r('q3')} AS q3,
        {r(f'(SELECT min({c}) FROM events WHERE {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1))')} AS whisker_low,
        {r(f'(SELECT max({c}) FROM events WHERE {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1))')} AS whisker_high,
        (SELECT count(*) FROM events WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS fliers
        FROM (SELECT quantile_cont({c}, 0.25) AS q1, median({c}) AS m, quantile_cont({c}, 0.75) AS q3 FROM events)"""
            for c in ["value", "user_id"]
        ]
    ),
)
def _(spark, d):
    return numbers(E.boxplot_stats(table(spark, d, "events"), ["value", "user_id"]), 6)


@query("d10_target_classes", "SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    return E.target_table(table(spark, d, "lineitem"), "l_returnflag", "classification")


@query("d10_target_histogram", _histogram_sql(["o_totalprice"], "orders"))
def _(spark, d):
    return numbers(E.target_table(table(spark, d, "orders"), "o_totalprice", "regression"), 6)


_GAPPY = ["event_id", "value", "value_text", "sparse", "constant"]


@query(
    "d11_missingness",
    WITH_DIRTY
    + " SELECT * FROM ("
    + union_all(
        [f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, {r(f'(count(*) - count({c})) / count(*)')} AS share FROM dirty""" for c in _GAPPY]
    )
    + ") WHERE missing > 0",
)
def _(spark, d):
    return numbers(E.missingness(dirty(spark, d).select(*_GAPPY)), 6)


@query("d13_eda_report")
def _(spark, d):
    reports = E.eda(table(spark, d, "events").select("event_type", "user_id", "value"), "value", "regression")
    parts = [df.select(F.lit(name).alias("report"), F.to_json(F.struct(*df.columns)).alias("row")) for name, df in reports.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
