"""Group M: the ad-hoc table verbs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.functions.columns import rounded
from tabsight.operators import verbs as V
from tabsight.operators.ordinal import ordinal
from tabsight.plans.dirty import WITH_DIRTY, dirty
from tabsight.plans.registry import query, r, table, union_all

Agg, QuerySpec = V.Agg, V.QuerySpec


def _numbers(df, digits=6):
    """Round every floating column of a finished result for comparison."""
    return df.select(*[rounded(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema])


@query("m1_select", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, d):
    return V.run(table(spark, d, "orders"), QuerySpec(select=["o_orderkey", "o_orderstatus", "o_totalprice"]))


@query(
    "m2_filter",
    WITH_DIRTY + " SELECT event_id, event_type, value FROM dirty WHERE (coalesce(value > 20, false) AND event_type = 'click') "
    "OR (NOT coalesce(value > 20, false) AND coalesce(value <> 5.0, true) AND event_type <> 'click')",
)
def _(spark, d):
    over = V.compare(F.col("value"), ">", 20)
    click = V.compare(F.col("event_type"), "==", "click")
    cond = (over & click) | (~over & V.compare(F.col("value"), "!=", 5.0) & ~click)
    return V.run(dirty(spark, d), QuerySpec(where=cond, select=["event_id", "event_type", "value"]))


@query(
    "m3_arithmetic",
    f"""SELECT p_partkey, p_size + 1 AS plus, {r('p_retailprice - p_size')} AS minus, p_size * 2 AS times,
    CASE WHEN p_size = 7 THEN NULL ELSE {r('p_retailprice / (p_size - 7)')} END AS divided,
    CAST(floor(p_retailprice / -7) AS BIGINT) AS floored, {r('p_retailprice - (-7) * floor(p_retailprice / -7)')} AS remainder,
    {r('power(p_size, 2)')} AS squared, -p_size AS negated FROM part""",
)
def _(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select(
        "p_partkey",
        (size + 1).alias("plus"),
        rounded(price - size).alias("minus"),
        (size * 2).alias("times"),
        rounded(V.true_divide(price, size - 7)).alias("divided"),
        V.floor_divide(price, F.lit(-7)).alias("floored"),
        rounded(V.modulo(price, F.lit(-7))).alias("remainder"),
        rounded(F.pow(size, 2)).alias("squared"),
        (-size).alias("negated"),
    )


@query("m4_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def _(spark, d):
    return table(spark, d, "part").where(F.col("p_size").between(10, 20)).select("p_partkey", "p_size")


@query("m5_isin", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
def _(spark, d):
    return (
        table(spark, d, "orders")
        .where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("F"))
        .select("o_orderkey", "o_orderpriority")
    )


@query(
    "m6_isna",
    WITH_DIRTY + " SELECT event_type, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, "
    "CAST(sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS present FROM dirty GROUP BY event_type",
)
def _(spark, d):
    return dirty(spark, d).groupBy("event_type").agg(
        F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(F.col("value").isNotNull()).alias("present")
    )


@query("m7_fillna", WITH_DIRTY + f" SELECT event_id, {r('coalesce(value, 0)')} AS value, coalesce(sparse, -1.0) AS sparse FROM dirty")
def _(spark, d):
    return dirty(spark, d).na.fill({"value": 0.0, "sparse": -1.0}).select("event_id", rounded(F.col("value")).alias("value"), "sparse")


@query("m8_dropna", WITH_DIRTY + " SELECT event_id, value, sparse FROM dirty WHERE value IS NOT NULL AND sparse IS NOT NULL")
def _(spark, d):
    return dirty(spark, d).select("event_id", "value", "sparse").na.drop()


@query(
    "m9_drop_duplicates",
    "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type",
)
def _(spark, d):
    return V.drop_duplicates(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("m10_astype", WITH_DIRTY + " SELECT event_id, CAST(flag AS BOOLEAN) AS flag, TRY_CAST(value_text AS DOUBLE) AS number, CAST(user_id AS VARCHAR) AS user_id FROM dirty")
def _(spark, d):
    return dirty(spark, d).select(
        "event_id", F.col("flag").cast("boolean").alias("flag"), F.col("value_text").try_cast("double").alias("number"), F.col("user_id").cast("string").alias("user_id")
    )


@query("m11_abs", f"SELECT c_custkey, {r('abs(c_acctbal)')} AS size FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", rounded(F.abs("c_acctbal")).alias("size"))


@query("m12_round", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) + 0.0 AS half FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.round_half_even(F.col("l_quantity") / 2).alias("half"))


def _scalar(name, verb, sql, digits=6, **kw):
    """One aggregate over the dirty value column, whole and per event type."""

    @query(
        name,
        WITH_DIRTY
        + f" SELECT 'all' AS slice, {sql} AS result FROM dirty UNION ALL SELECT event_type AS slice, {sql} AS result FROM dirty GROUP BY event_type",
    )
    def _(spark, d):
        base = dirty(spark, d)
        agg = {"result": Agg(verb, "value", **kw)}
        whole = V.run(base, QuerySpec(agg=agg)).select(F.lit("all").alias("slice"), "result")
        parts = V.run(base, QuerySpec(group_by=["event_type"], agg=agg)).select(F.col("event_type").alias("slice"), "result")
        out = whole.unionByName(parts)
        return _numbers(out, digits)


_scalar("m13_mean", "mean", r("avg(value)"))
_scalar("m14_median", "median", r("median(value)"))
_scalar("m15_sum", "sum", r("coalesce(sum(value), 0)", 4), 4)
_scalar("m16_min", "min", r("min(value)"))
_scalar("m16_max", "max", r("max(value)"))
_scalar("m17_std", "std", r("stddev_samp(value)"))
_scalar("m17_var", "var", r("var_samp(value)", 5), 5)
_scalar("m18_count", "count", "count(value)")
_scalar("m18_size", "size", "count(*)")
_scalar("m19_nunique", "nunique", "count(DISTINCT value)")
_scalar("m20_quantile", "quantile", r("quantile_cont(value, 0.9)"), q=0.9)
_scalar("m23_sem", "sem", r("stddev_samp(value) / sqrt(count(value))"))
_scalar("m24_skew", "skew", r("skewness(value)", 5), 5)
_scalar("m24_kurt", "kurt", r("kurtosis(value)", 4), 4)


@query("m25_prod", "SELECT l_returnflag, round(ln(product(1 + l_tax / 100)), 6) AS log_product FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    grown = table(spark, d, "lineitem").select("l_returnflag", (1 + F.col("l_tax") / 100).alias("x"))
    return V.aggregate(grown, {"p": Agg("prod", "x")}, ["l_returnflag"]).select("l_returnflag", F.round(F.ln("p"), 6).alias("log_product"))


@query(
    "m21_mode",
    "WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY p_size) SELECT p_size, n FROM c WHERE n = (SELECT max(n) FROM c)",
)
def _(spark, d):
    return V.mode(table(spark, d, "part"), "p_size")


@query(
    "m22_corr_cov",
    f"SELECT l_returnflag, {r('corr(l_quantity, l_extendedprice)')} AS corr, {r('covar_samp(l_quantity, l_extendedprice)', 3)} AS cov FROM lineitem GROUP BY l_returnflag",
)
def _(spark, d):
    out = V.run(
        table(spark, d, "lineitem"),
        QuerySpec(group_by=["l_returnflag"], agg={"corr": Agg("corr", "l_quantity", "l_extendedprice"), "cov": Agg("cov", "l_quantity", "l_extendedprice")}),
    )
    return out.select("l_returnflag", rounded(F.col("corr")).alias("corr"), rounded(F.col("cov"), 3).alias("cov"))


@query(
    "m26_groupby",
    WITH_DIRTY + f", k AS (SELECT CASE WHEN label = '' THEN NULL ELSE label END AS label, value FROM dirty) SELECT label, {r('avg(value)')} AS mean_value FROM k WHERE label IS NOT NULL GROUP BY label",
)
def _(spark, d):
    keyed = dirty(spark, d).select(F.nullif("label", F.lit("")).alias("label"), "value")
    return _numbers(V.run(keyed, QuerySpec(group_by=["label"], agg={"mean_value": Agg("mean", "value")}, order_by=[("label", True)])))


@query(
    "m27_agg",
    f"""SELECT l_returnflag, l_linestatus, {r('sum(l_quantity)', 2)} AS sum_qty, {r('avg(l_extendedprice)', 4)} AS avg_price,
    {r('median(l_extendedprice)', 4)} AS mid_price, max(l_shipdate) AS last_ship, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def _(spark, d):
    out = V.run(
        table(spark, d, "lineitem"),
        QuerySpec(
            group_by=["l_returnflag", "l_linestatus"],
            agg={
                "sum_qty": Agg("sum", "l_quantity"),
                "avg_price": Agg("mean", "l_extendedprice"),
                "mid_price": Agg("median", "l_extendedprice"),
                "last_ship": Agg("max", "l_shipdate"),
                "n": Agg("size"),
            },
        ),
    )
    return out.select(
        "l_returnflag",
        "l_linestatus",
        rounded(F.col("sum_qty"), 2).alias("sum_qty"),
        rounded(F.col("avg_price"), 4).alias("avg_price"),
        rounded(F.col("mid_price"), 4).alias("mid_price"),
        "last_ship",
        "n",
    )


@query("m28_value_counts", "SELECT p_type, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY p_type")
def _(spark, d):
    return V.sort_values(V.counts(table(spark, d, "part"), "p_type"), [("n", False), ("p_type", True)])


@query("m29_unique", "SELECT DISTINCT p_brand FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_brand").distinct()


_DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "m30_describe",
    union_all(
        [
            f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, {r(f'min({c})', 4)} AS min,
        {r(f'quantile_cont({c}, 0.25)', 4)} AS q1, {r(f'median({c})', 4)} AS median, {r(f'quantile_cont({c}, 0.75)', 4)} AS q3, {r(f'max({c})', 4)} AS max FROM lineitem"""
            for c in _DESCRIBED
        ]
    ),
)
def _(spark, d):
    return _numbers(V.describe(table(spark, d, "lineitem"), _DESCRIBED), 4)


@query("m31_sort_values", WITH_DIRTY + " SELECT event_id, value, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS position FROM dirty")
def _(spark, d):
    rows = dirty(spark, d).select("event_id", "value")
    return ordinal(V.sort_values(rows, [("value", False), ("event_id", True)]), [F.col("value").desc_nulls_last(), "event_id"], name="position")


@query("m32_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def _(spark, d):
    return V.head(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("m32_tail", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def _(spark, d):
    return V.tail(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("m33_nlargest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def _(spark, d):
    return V.nlargest(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 7)


@query("m33_nsmallest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7")
def _(spark, d):
    return V.nsmallest(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 7)


@query(
    "m34_idxmax_idxmin",
    "SELECT (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS idxmax, (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) AS idxmin",
)
def _(spark, d):
    orders = table(spark, d, "orders")
    high = V.idxmax(orders, "o_totalprice", "o_orderkey").withColumn("_k", F.lit(1))
    low = V.idxmin(orders, "o_totalprice", "o_orderkey").withColumn("_k", F.lit(1))
    return high.join(low, "_k").drop("_k")


@query(
    "m35_rank",
    WITH_DIRTY + ", k AS (SELECT event_id, value, rank() OVER (ORDER BY value) AS rk, count(*) OVER (PARTITION BY value) AS n FROM dirty WHERE value IS NOT NULL) "
    "SELECT event_id, rk + (n - 1) / 2.0 AS rank FROM k UNION ALL SELECT event_id, NULL AS rank FROM dirty WHERE value IS NULL",
)
def _(spark, d):
    return V.rank(dirty(spark, d).select("event_id", "value"), "value").select("event_id", "rank")


@query("m36_loc", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R'")
def _(spark, d):
    return V.run(
        table(spark, d, "lineitem"),
        QuerySpec(where=V.compare(F.col("l_quantity"), ">", 40) & V.compare(F.col("l_returnflag"), "==", "R"), select=["l_orderkey", "l_extendedprice"]),
    )


@query("m37_text", "SELECT p_partkey, substring(p_name, 1, 3) AS head, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS BIGINT) AS vowels FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", V.text_slice(F.col("p_name"), 0, 3).alias("head"), V.text_count(F.col("p_name"), "[aeiou]").alias("vowels"))


@query(
    "m38_time_round",
    """WITH e AS (SELECT event_id, epoch_us(ts) AS us FROM events), q AS (SELECT event_id, us // 3600000000 AS h, us % 3600000000 AS rest FROM e)
    SELECT event_id, make_timestamp((h + CASE WHEN rest * 2 > 3600000000 OR (rest * 2 = 3600000000 AND h % 2 = 1) THEN 1 ELSE 0 END) * 3600000000) AS hour FROM q""",
)
def _(spark, d):
    return table(spark, d, "events").select("event_id", V.round_time(F.col("ts"), 3600).alias("hour"))


@query(
    "m40_result_cap",
    """SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS row,
    greatest((SELECT count(*) FROM orders) - 25, 0) AS remaining, CAST(NULL AS VARCHAR) AS note FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 25)""",
)
def _(spark, d):
    return V.capped(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
