"""Groups F and G: recipes, encoders, samples, folds and resampling."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabsight.functions import text as X
from tabsight.functions.columns import rounded
from tabsight.operators import recipe as R
from tabsight.operators import select as L
from tabsight.operators import split as G
from tabsight.operators import strategy as S
from tabsight.operators import target as Y
from tabsight.operators.ordinal import hashed_ordinal, ordinal
from tabsight.operators.resample import smote
from tabsight.operators.text import Tfidf, TextTopics, documents
from tabsight.plans.dirty import WITH_DIRTY, dirty
from tabsight.plans.eda import numbers
from tabsight.plans.registry import query, r, table, union_all

One = S.ColumnStrategy

# ---- F: roles and strategies ---------------------------------------------------------------------


def _words(c):
    return f"CASE WHEN trim({c}, ' \t\n\r\f\v') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '\\s+')) END"


def _roles_sql(columns, source):
    """``columns``: (name, kind) with kind numeric, datetime or label."""
    parts = []
    for i, (c, kind) in enumerate(columns):
        words = f"coalesce(avg(CASE WHEN {c} IS NOT NULL THEN {_words(c)} END), 0)" if kind == "label" else "0.0"
        prose = f"({words} >= 20)" if kind == "label" else "false"
        role = f"CASE WHEN {prose} OR count(DISTINCT {c}) > 50 THEN 'text' ELSE 'categorical' END" if kind == "label" else f"'{kind}'"
        parts.append(
            f"""SELECT '{c}' AS "column", CAST({i} AS BIGINT) AS ordinal, count(*) AS n_rows, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique,
        {r(words)} AS mean_words, {prose} AS is_long_form, count(DISTINCT {c}) / count(*) > 0.9 AS is_near_unique, {role} AS role FROM {source}"""
        )
    return union_all(parts)


_DOCS = [("doc_id", "numeric"), ("text", "label"), ("lang", "label"), ("source", "label"), ("n_chars", "numeric")]
_CUST = [("c_custkey", "numeric"), ("c_name", "label"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"), ("c_mktsegment", "label")]
_PART = [("p_partkey", "numeric"), ("p_name", "label"), ("p_brand", "label"), ("p_type", "label"), ("p_size", "numeric")]


@query("f1_observed_role", _roles_sql(_PART, "part"))
def _(spark, d):
    return numbers(S.observed_roles(table(spark, d, "part").select(*[c for c, _ in _PART])), 6)


@query("f2_near_unique", f"""SELECT "column", n_unique, is_near_unique FROM ({_roles_sql(_CUST, 'customer')})""")
def _(spark, d):
    return S.observed_roles(table(spark, d, "customer").select(*[c for c, _ in _CUST])).select("column", "n_unique", "is_near_unique")


@query("f3_prose", f"""SELECT "column", mean_words, is_long_form FROM ({_roles_sql([('text', 'label'), ('lang', 'label'), ('source', 'label')], 'documents')})""")
def _(spark, d):
    return numbers(S.mean_words(table(spark, d, "documents"), ["text", "lang", "source"]), 6)


def _strategy_sql(columns, source):
    return f"""SELECT ordinal, "column", CASE WHEN role = 'text' AND NOT is_long_form AND is_near_unique THEN 'drop' ELSE role END AS role,
    CASE WHEN role IN ('numeric', 'datetime') THEN 'median' WHEN role = 'text' AND is_long_form THEN 'constant' WHEN role = 'text' AND is_near_unique THEN 'none' ELSE 'most_frequent' END AS impute,
    CASE WHEN role IN ('numeric', 'datetime') THEN 'none' WHEN role = 'text' AND is_long_form THEN 'tfidf' WHEN role = 'text' AND is_near_unique THEN 'none' WHEN role = 'text' THEN 'frequency' ELSE 'onehot' END AS encode,
    CASE WHEN role IN ('numeric', 'datetime') THEN 'standard' ELSE 'none' END AS scale FROM ({_roles_sql(columns, source)})"""


@query("f4_default_strategy", _strategy_sql(_DOCS, "documents"))
def _(spark, d):
    return S.default_strategy(S.observed_roles(table(spark, d, "documents")))


@query("f4_default_strategy_labels", _strategy_sql(_CUST, "customer"))
def _(spark, d):
    return S.default_strategy(S.observed_roles(table(spark, d, "customer").select(*[c for c, _ in _CUST])))


@query("f7_ordinal_gaps", "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def _(spark, d):
    return S.ordinal_gaps(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


# ---- F: encoders, fitted on the earlier part of the table and applied to all of it -----------------

_SPLIT = "TIMESTAMP '2024-01-24'"
_TRAIN = f"train AS (SELECT * FROM dirty WHERE ts < {_SPLIT})"


def _train(df, column="ts", before="2024-01-24"):
    return df.where(F.col(column) < F.lit(before).cast("timestamp_ntz"))


def _encoded(df, strategies, keep=("event_id", "event_type"), digits=6, **kw):
    fitted = R.Recipe(strategies, **kw).fit(_train(df))
    return numbers(fitted.encode(df, keep), digits)


_KEYS = "event_id, event_type"


@query("f9_impute_median", f"{WITH_DIRTY}, {_TRAIN} SELECT {_KEYS}, {r('coalesce(value, (SELECT median(value) FROM train))')} AS value FROM dirty")
def _(spark, d):
    return _encoded(dirty(spark, d), [One("value", "numeric", "median")])


@query("f9_impute_mean", f"{WITH_DIRTY}, {_TRAIN} SELECT {_KEYS}, {r('coalesce(value, (SELECT avg(value) FROM train))')} AS value, {r('coalesce(sparse, 0)')} AS sparse FROM dirty")
def _(spark, d):
    return _encoded(dirty(spark, d), [One("value", "numeric", "mean"), One("sparse", "numeric", "constant")])


_LABEL = "CASE WHEN label = '' THEN NULL ELSE label END"


@query(
    "f10_impute_label",
    f"""{WITH_DIRTY}, k AS (SELECT *, {_LABEL} AS named FROM dirty), m AS (SELECT named FROM k WHERE ts < {_SPLIT} AND named IS NOT NULL GROUP BY named ORDER BY count(*) DESC, named LIMIT 1),
    f AS (SELECT {_KEYS}, coalesce(named, (SELECT named FROM m)) AS common, coalesce(named, 'missing') AS marked FROM k)
    SELECT {_KEYS}, common, marked FROM f""",
)
def _(spark, d):
    df = dirty(spark, d).withColumn("label", F.nullif("label", F.lit("")))
    common = One("label", "categorical", "most_frequent", "onehot")
    marked = One("label", "categorical", "constant", "onehot")
    fitted = R.Recipe([common]).fit(_train(df))
    return df.select("event_id", "event_type", fitted._label(common).alias("common"), fitted._label(marked).alias("marked"))


@query(
    "f11_standard_scale",
    f"""{WITH_DIRTY}, {_TRAIN}, f AS (SELECT coalesce(value, (SELECT median(value) FROM train)) AS x FROM train), s AS (SELECT avg(x) AS m, stddev_pop(x) AS w FROM f)
    SELECT {_KEYS}, {r('(coalesce(value, (SELECT median(value) FROM train)) - m) / w')} AS value FROM dirty, s""",
)
def _(spark, d):
    return _encoded(dirty(spark, d), [One("value", "numeric", "median", "none", "standard")])


@query(
    "f12_minmax_scale",
    f"""{WITH_DIRTY}, {_TRAIN}, f AS (SELECT coalesce(value, (SELECT median(value) FROM train)) AS x FROM train), s AS (SELECT min(x) AS lo, max(x) AS hi FROM f)
    SELECT {_KEYS}, {r('(coalesce(value, (SELECT median(value) FROM train)) - lo) / (hi - lo)')} AS value FROM dirty, s""",
)
def _(spark, d):
    return _encoded(dirty(spark, d), [One("value", "numeric", "median", "none", "minmax")])


@query(
    "f13_one_hot",
    "SELECT event_id, "
    + ", ".join(f"CAST(event_type = '{v}' AND known AS DOUBLE) AS event_type_{v}" for v in ["click", "error", "purchase", "view"])
    + f" FROM (SELECT event_id, event_type, event_type IN (SELECT event_type FROM events WHERE event_type <> 'signup' AND ts < {_SPLIT}) AS known FROM events)",
)
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", "event_type")
    seen = _train(events).where("event_type <> 'signup'")
    return R.Recipe([One("event_type", "categorical", "none", "onehot")]).fit(seen).encode(events, ["event_id"])


_ORDER = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH")


@query(
    "f14_ordinal_encode",
    "SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0.0 WHEN '4-NOT SPECIFIED' THEN 1.0 WHEN '3-MEDIUM' THEN 2.0 WHEN '2-HIGH' THEN 3.0 ELSE -1.0 END AS DOUBLE) AS o_orderpriority FROM orders",
)
def _(spark, d):
    orders = table(spark, d, "orders")
    fitted = R.Recipe([One("o_orderpriority", "ordinal", "none", "ordinal", "none", _ORDER)]).fit(orders)
    return fitted.encode(orders, ["o_orderkey"])


@query(
    "f15_frequency_encode",
    """WITH t AS (SELECT * FROM part WHERE p_retailprice < 950), a AS (SELECT p_name, count(*) / (SELECT count(*) FROM t) AS s FROM t GROUP BY 1),
    b AS (SELECT p_brand, count(*) / (SELECT count(*) FROM t) AS s FROM t GROUP BY 1)
    SELECT p_partkey, round(coalesce(a.s, 0), 6) + 0.0 AS p_name_frequency, round(coalesce(b.s, 0), 6) + 0.0 AS p_brand_frequency FROM part LEFT JOIN a USING (p_name) LEFT JOIN b USING (p_brand)""",
)
def _(spark, d):
    part = table(spark, d, "part")
    fitted = R.Recipe([One("p_name", "text", "none", "frequency"), One("p_brand", "text", "none", "frequency")]).fit(part.where("p_retailprice < 950"))
    return numbers(fitted.encode(part, ["p_partkey"]), 6)


@query(
    "f16_datetime_parts",
    """SELECT event_id, CAST(year(ts) AS DOUBLE) AS ts_year, CAST(month(ts) AS DOUBLE) AS ts_month, CAST(day(ts) AS DOUBLE) AS ts_day,
    CAST(isodow(ts) - 1 AS DOUBLE) AS ts_dayofweek, CAST(hour(ts) AS DOUBLE) AS ts_hour FROM events""",
)
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "ts")
    return R.Recipe([One("ts", "datetime", "constant")]).fit(events).encode(events, ["event_id"])


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TFIDF = f"""WITH tok AS (SELECT doc_id, list_filter(regexp_extract_all(translate(lower(text), '{X.ACCENTED}', '{X.PLAIN}'), '{X.TOKEN_PATTERN}'), lambda t: t NOT IN ({_STOP})) AS w FROM documents),
 terms AS (SELECT doc_id, unnest(w) AS term FROM tok UNION ALL
   SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM tok),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
 voc AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= 3 ORDER BY sum(tf) DESC, term LIMIT 30000),
 raw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN voc USING (term))"""


@query("f17_tfidf_weights", _TFIDF + f" SELECT doc_id, term, {r('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM raw")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return Tfidf.fit(docs, "doc_id", "text").transform(docs).select("doc_id", "term", rounded(F.col("weight")).alias("weight"))


@query("f17_tfidf_vocabulary", _TFIDF + f" SELECT term, {r('idf')} AS idf FROM voc")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return numbers(Tfidf.fit(docs, "doc_id", "text").vocab, 6)


@query("f18_tfidf_topics")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = TextTopics.fit(docs, "text", topics=8, max_terms=2000)
    return model.transform(docs, "text", "topics").select("doc_id", "topics")


@query("f19_null_documents", WITH_DIRTY + f" SELECT event_id, coalesce({_LABEL}, '') AS document FROM dirty")
def _(spark, d):
    return dirty(spark, d).select("event_id", documents(F.nullif("label", F.lit(""))).alias("document"))


@query(
    "f20_lineage",
    union_all([f"SELECT 'ts_{p}' AS encoded, 'ts' AS source" for p in R.DATETIME_PARTS])
    + " UNION ALL SELECT 'value', 'value' UNION ALL SELECT DISTINCT 'event_type_' || event_type, 'event_type' FROM events",
)
def _(spark, d):
    events = table(spark, d, "events")
    fitted = R.Recipe([One("ts", "datetime", "median"), One("value", "numeric", "median"), One("event_type", "categorical", "none", "onehot")]).fit(events)
    return fitted.lineage_table(spark)


@query(
    "f20_lineage_by_prefix",
    """WITH e AS (SELECT DISTINCT 'o_' || lower(o_orderstatus) || '_frequency' AS encoded FROM orders UNION SELECT DISTINCT 'o_' || lower(o_orderstatus) || '_extra_' || o_orderpriority FROM orders),
    s AS (SELECT DISTINCT 'o_' || lower(o_orderstatus) AS source FROM orders UNION SELECT DISTINCT 'o_' || lower(o_orderstatus) || '_extra' FROM orders)
    SELECT encoded, arg_max(source, len(source)) AS source FROM e JOIN s ON starts_with(encoded, source) AND (len(encoded) = len(source) OR substr(encoded, len(source) + 1, 1) = '_') GROUP BY encoded""",
)
def _(spark, d):
    orders = table(spark, d, "orders")
    stem = F.concat(F.lit("o_"), F.lower("o_orderstatus"))
    encoded = orders.select(F.concat(stem, F.lit("_frequency")).alias("encoded")).union(orders.select(F.concat(stem, F.lit("_extra_"), "o_orderpriority"))).distinct()
    sources = orders.select(stem.alias("source")).union(orders.select(F.concat(stem, F.lit("_extra")))).distinct()
    return R.source_by_prefix(encoded, sources)


_FCOLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _anova(c, label, source):
    return f"""SELECT '{c}' AS "column", {r('(sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))', 5)} AS f FROM
    (SELECT {label}, count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM {source}) AS g FROM {source} GROUP BY {label})"""


@query("f21_anova_f", union_all([_anova(c, "l_returnflag", "lineitem") for c in _FCOLS]))
def _(spark, d):
    return numbers(L.anova_f(table(spark, d, "lineitem"), _FCOLS, "l_returnflag"), 5)


_CODED = "CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 2.0 ELSE 3.0 END"


@query(
    "f21_perfect_predictors",
    f"""SELECT 'classification' AS task, 'perfect' AS "column", true AS infinite, NULL AS f UNION ALL SELECT 'classification', 'constant', false, NULL
    UNION ALL SELECT 'classification', "column", false, f FROM ({_anova('l_tax', 'l_returnflag', 'lineitem')})
    UNION ALL SELECT 'regression', 'perfect', true, NULL UNION ALL SELECT 'regression', 'constant', false, NULL
    UNION ALL SELECT 'regression', 'l_tax', false, {r('corr(l_tax, l_quantity) ** 2 * (count(*) - 2) / (1 - corr(l_tax, l_quantity) ** 2)', 5)} FROM lineitem""",
)
def _(spark, d):
    line = table(spark, d, "lineitem").withColumn("constant", F.lit(7.0))
    coded = line.withColumn("perfect", F.expr(_CODED).cast("double"))
    scaled = line.withColumn("perfect", 3 - 2 * F.col("l_quantity"))
    columns = ["perfect", "constant", "l_tax"]
    both = L.anova_f(coded, columns, "l_returnflag").withColumn("task", F.lit("classification")).unionByName(
        L.regression_f(scaled, columns, "l_quantity").withColumn("task", F.lit("regression"))
    )
    infinite = F.coalesce(F.col("f") == float("inf"), F.lit(False))
    return both.select("task", "column", infinite.alias("infinite"), rounded(F.when(~infinite, F.col("f")), 5).alias("f"))


@query(
    "f21_select_k_best",
    "SELECT * FROM ("
    + union_all(
        [
            f"""SELECT '{c}' AS "column", {r(f'corr({c}, l_extendedprice) ** 2 * (count(*) - 2) / (1 - corr({c}, l_extendedprice) ** 2)', 2)} AS f FROM lineitem"""
            for c in ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
        ]
    )
    + ") ORDER BY f DESC LIMIT 2",
)
def _(spark, d):
    return numbers(L.select_k_best(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice", "regression", 2), 2)


@query(
    "f22_recipe",
    f"""{WITH_DIRTY}, {_TRAIN}, f AS (SELECT coalesce(value, (SELECT median(value) FROM train)) AS x FROM train), s AS (SELECT avg(x) AS m, stddev_pop(x) AS w FROM f),
    q AS (SELECT user_id, count(*) / (SELECT count(*) FROM train) AS share FROM train GROUP BY 1)
    SELECT event_id, event_type, list_transform([(coalesce(value, (SELECT median(value) FROM train)) - m) / w, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END, coalesce(share, 0)], lambda v: round(v, 6) + 0.0) AS features
    FROM dirty LEFT JOIN q USING (user_id), s""",
)
def _(spark, d):
    df = dirty(spark, d)
    fitted = R.Recipe(
        [One("value", "numeric", "median", "none", "standard"), One("event_type", "categorical", "most_frequent", "onehot"), One("user_id", "text", "none", "frequency")]
    ).fit(_train(df))
    out = fitted.transform(df, ["event_id", "event_type"])
    return out.select("event_id", "event_type", F.transform(vector_to_array("features"), lambda v: F.round(v, 6) + 0.0).alias("features"))


@query(
    "f23_target_transform",
    f"""WITH m AS (SELECT event_type, min(value) AS minimum, skewness(value) AS a, skewness(ln(1 + value)) AS b FROM events GROUP BY 1)
    SELECT event_type, {r('minimum')} AS minimum, {r('a', 5)} AS skew_before, {r('b', 5)} AS skew_after, minimum >= 0 AND abs(a) >= 2 AND abs(b) <= abs(a) * 0.5 AS use_log FROM m""",
)
def _(spark, d):
    return numbers(Y.choose_target_transform(table(spark, d, "events"), "value", ["event_type"]), 5)


@query("f24_target_scale", f"SELECT event_id, {r('ln(1 + value)')} AS modelled, {r('exp(ln(1 + value)) - 1', 5)} AS original FROM events")
def _(spark, d):
    y = Y.to_model_scale(F.col("value"))
    return table(spark, d, "events").select("event_id", rounded(y).alias("modelled"), rounded(Y.from_model_scale(y), 5).alias("original"))


# ---- G -------------------------------------------------------------------------------------------


def _md5(key, seed=42):
    return f"md5(CAST({key} AS VARCHAR) || ':{seed}')"


@query("g1_sample_rows", f"SELECT event_id, value FROM events ORDER BY {_md5('event_id')} LIMIT 500")
def _(spark, d):
    return G.sample_rows(table(spark, d, "events").select("event_id", "value"), ["event_id"], 500)


def _stratified(source, key, target, n):
    return f"""SELECT * EXCLUDE (pos, quota) FROM (SELECT t.*, row_number() OVER (PARTITION BY {target} ORDER BY {_md5(key)}) AS pos,
    greatest(1, round_even(count(*) OVER (PARTITION BY {target}) * least({float(n)} / (SELECT count(*) FROM {source}), 1.0), 0)) AS quota FROM {source} AS t) WHERE pos <= quota"""


@query("g2_stratified_sample", f"WITH docs AS (SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)) {_stratified('docs', 'doc_id', 'quality', 100)}")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return G.stratified_sample(docs, ["doc_id"], "quality", 100)


@query(
    "g3_kfold",
    f"""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_md5('o_orderkey')}) - 1 AS i, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, CAST(CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE (n % 7) + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS BIGINT) AS fold FROM p""",
)
def _(spark, d):
    return G.kfold(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query(
    "g4_stratified_kfold",
    f"""SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY {_md5('doc_id')}) - 1) % 5 AS BIGINT) AS fold FROM documents JOIN labels USING (doc_id)""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return G.stratified_kfold(docs, ["doc_id"], "quality", 5)


_TIMED = """WITH p AS (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events),
 w AS (SELECT CAST(unnest(range(5)) AS BIGINT) AS fold), s AS (SELECT event_id, event_type, fold, i, n - (5 - fold) * (n // 6) AS start, n // 6 AS size FROM p, w)"""


@query("g5_time_series_split", _TIMED + " SELECT event_id, fold, CASE WHEN i < start THEN 'train' ELSE 'test' END AS role FROM s WHERE i < start + size")
def _(spark, d):
    return G.time_series_split(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 5).select("event_id", "fold", "role")


@query(
    "g6_order_by_time",
    WITH_DIRTY
    + """, t AS (SELECT event_id, CASE WHEN minute(ts) = 3 THEN NULL ELSE date_trunc('day', ts) END AS clock FROM events) SELECT event_id, row_number() OVER (ORDER BY clock, event_id) AS position FROM t WHERE clock IS NOT NULL""",
)
def _(spark, d):
    once = dirty(spark, d).select("event_id", "date_text").dropDuplicates(["event_id"])
    timed, applied = G.order_by_time(once, "date_text")
    if not applied:
        raise AssertionError("more than a tenth of the dates could not be read")
    return ordinal(timed, ["_time", "event_id"], name="position").select("event_id", "position")


@query(
    "g6_too_many_undated",
    WITH_DIRTY + f" SELECT count(*) AS rows, count(*) - count(value) AS unreadable, {r('(count(*) - count(value)) / count(*)')} AS rate FROM dirty",
)
def _(spark, d):
    df = dirty(spark, d)
    _, applied = G.order_by_time(df, "value")
    if applied:
        raise AssertionError("the gaps should have ruled the column out")
    return numbers(G.time_gap_report(df, "value"), 6)


@query(
    "g7_smote",
    """WITH c AS (SELECT CASE WHEN label < 2 THEN 1 ELSE 0 END AS target, count(*) AS n FROM embeddings GROUP BY 1), t AS (SELECT max(n) AS top FROM c)
    SELECT target, false AS synthetic, n, 0 AS bases FROM c UNION ALL SELECT target, true, top - n, least(n, top - n) FROM c, t WHERE top > n""",
)
def _(spark, d):
    vectors = table(spark, d, "embeddings").select(
        "vec_id", (F.col("label") < 2).cast("int").alias("target"), F.transform("embedding", lambda v: v.cast("double")).alias("features")
    )
    out = smote(vectors, "vec_id", "target")
    return out.groupBy("target", "synthetic").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("base").alias("bases"))


@query(
    "g8_ordinal",
    "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) AS ordinal FROM lineitem",
)
def _(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag")
    order = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    return ordinal(line, order, ["l_returnflag"], small=False).select("l_orderkey", "l_linenumber", "l_partkey", "ordinal")


@query("g8_hashed_ordinal", f"SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY {_md5('event_id', 7)}) AS ordinal FROM events")
def _(spark, d):
    return hashed_ordinal(table(spark, d, "events").select("event_id", "event_type"), ["event_id"], 7, ["event_type"], small=False).select("event_id", "ordinal")


@query("g9_single_class_folds", _TIMED + " SELECT fold, count(DISTINCT event_type) AS classes, count(DISTINCT event_type) < 2 AS single FROM s WHERE i >= start AND i < start + size GROUP BY fold")
def _(spark, d):
    parts = G.time_series_split(table(spark, d, "events").select("event_id", "ts", "event_type"), ["ts", "event_id"], 5)
    return G.single_class_folds(parts.where("role = 'test'"), "event_type")
