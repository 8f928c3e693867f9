"""Groups H, I and K: models, metrics and scoring."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabsight.functions.columns import rounded
from tabsight.operators import metrics as M
from tabsight.operators import models as H
from tabsight.operators import score as K
from tabsight.operators import split as G
from tabsight.operators.recipe import Recipe
from tabsight.operators.strategy import ColumnStrategy as One
from tabsight.operators.strategy import strategies_for
from tabsight.operators.target import from_model_scale
from tabsight.plans.eda import numbers
from tabsight.plans.registry import query, r, table, union_all
from tabsight.sources.tables import scratch_path
from tabsight.streaming.scoring import read_stream, score_stream

# ---- inputs --------------------------------------------------------------------------------------


def labelled_docs(spark, d):
    """Documents with a quality label: an imbalanced two-class table."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, d, "labels").select("doc_id", "toxic", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("quality"))
    return docs.join(labels, "doc_id")


DOC_STRATEGIES = [
    One("lang", "categorical", "most_frequent", "onehot"),
    One("source", "categorical", "most_frequent", "onehot"),
    One("n_chars", "numeric", "median", "none", "standard"),
    One("toxic", "numeric", "median", "none", "standard"),
]

EVENT_STRATEGIES = [
    One("event_type", "categorical", "most_frequent", "onehot"),
    One("user_id", "numeric", "median", "none", "standard"),
    One("ts", "datetime", "median", "none", "standard"),
]


def guesses(spark, d):
    """A fixed three-class prediction over lineitem, folds by line number."""
    line = table(spark, d, "lineitem")
    q, disc = F.col("l_quantity"), F.col("l_discount")
    pred = F.when(disc > 0.06, "R").when(q > 30, "N").otherwise("A")
    score = F.col("l_tax") * 10 + disc
    return line.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", F.col("l_linenumber").cast("long").alias("fold"), F.col("l_returnflag").alias("y"), pred.alias("pred"), score.alias("score")
    )


_GUESS = """WITH g AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, CAST(l_linenumber AS BIGINT) AS fold, l_returnflag AS y, CASE WHEN l_discount > 0.06 THEN 'R' WHEN l_quantity > 30 THEN 'N' ELSE 'A' END AS pred,
 l_tax * 10 + l_discount AS score FROM lineitem)"""


def prices(spark, d):
    """A fixed numeric prediction over lineitem with a few very wrong rows in fold 3."""
    line = table(spark, d, "lineitem")
    odd = (F.col("l_linenumber") == 3) & (F.col("l_quantity") == 50) & (F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08)
    pred = F.col("l_quantity") * 1500 + F.when(odd, 2000000 + F.col("l_partkey") * 1000).otherwise(0)
    return line.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("fold"), F.col("l_extendedprice").alias("y"), pred.alias("pred"))


_PRICE = """WITH p AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS fold, l_extendedprice AS y, l_quantity * 1500 +
 CASE WHEN l_linenumber = 3 AND l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0.08 THEN 2000000 + l_partkey * 1000 ELSE 0 END AS pred FROM lineitem)"""

# ---- H -------------------------------------------------------------------------------------------


def _fit(spark, d, position, task, **kw):
    """One roster entry fitted on the whole table, and what it predicts there."""
    candidate = H.roster(task, **kw)[position]
    if task == "classification":
        df, strategies, target, key = labelled_docs(spark, d), DOC_STRATEGIES, "quality", "doc_id"
    else:
        df = table(spark, d, "events").select("event_id", "event_type", "user_id", "ts", "value")
        strategies, target, key = EVENT_STRATEGIES, "value", "event_id"
    model = H.fit_final(df, Recipe(strategies), candidate, target, task, key)
    return model.predict(df, [key, target]).withColumnRenamed(target, "y")


@query("h1_random_forest")
def _(spark, d):
    return _fit(spark, d, 0, "classification")


@query("h2_logistic_regression")
def _(spark, d):
    return _fit(spark, d, 1, "classification")


@query(
    "h3_linear_regression",
    f"SELECT {r('regr_slope(l_extendedprice, l_quantity)', 3)} AS slope, {r('regr_intercept(l_extendedprice, l_quantity)', 3)} AS intercept FROM lineitem",
)
def _(spark, d):
    line = table(spark, d, "lineitem")
    encoded = Recipe([One("l_quantity", "numeric", "median")]).fit(line).transform(line, ["l_extendedprice"])
    model = LinearRegression(regParam=0.0, labelCol="l_extendedprice").fit(encoded)
    # the fitted numbers next to the number of rows they came from
    return line.agg(F.count(F.lit(1)).alias("n")).select(
        F.round(F.lit(float(model.coefficients[0])), 3).alias("slope"), F.round(F.lit(float(model.intercept)), 3).alias("intercept")
    )


@query("h4_boosted_trees")
def _(spark, d):
    return _fit(spark, d, 2, "regression")


@query(
    "h5_baseline",
    "SELECT 'classification' AS task, (SELECT event_type FROM events WHERE ts < TIMESTAMP '2024-01-24' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS prediction UNION ALL "
    "SELECT 'regression', CAST(round(median(value), 4) AS VARCHAR) FROM events WHERE ts < TIMESTAMP '2024-01-24'",
)
def _(spark, d):
    train = table(spark, d, "events").where(F.col("ts") < F.lit("2024-01-24").cast("timestamp_ntz"))
    a = H.baseline(train, "event_type", "classification").select(F.lit("classification").alias("task"), "prediction")
    b = H.baseline(train, "value", "regression").select(F.lit("regression").alias("task"), F.round("prediction", 4).cast("string").alias("prediction"))
    return a.unionByName(b)


@query(
    "h6_label_encode",
    "WITH l AS (SELECT DISTINCT o_orderpriority AS v FROM orders), i AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS idx FROM l) "
    "SELECT o_orderkey, idx AS encoded, o_orderpriority AS decoded FROM orders JOIN i ON v = o_orderpriority",
)
def _(spark, d):
    orders = table(spark, d, "orders")
    labels = H.class_labels(orders, "o_orderpriority")
    encoded = orders.select("o_orderkey", H.encode_label(F.col("o_orderpriority"), labels).alias("encoded"))
    return encoded.withColumn("decoded", H.decode_label(F.col("encoded"), labels))


def _cross_validated(spark, d):
    docs = G.stratified_kfold(labelled_docs(spark, d), ["doc_id"], "quality", 5)
    return H.cross_validate(docs, Recipe(DOC_STRATEGIES), "quality", "classification", "doc_id", H.roster("classification", trees=20, depth=8, rounds=10))


@query("h7_cross_validate")
def _(spark, d):
    predictions, _ = _cross_validated(spark, d)
    return H.fold_scores(predictions, "classification", ["good", "poor"])


@query(
    "h7_out_of_fold",
    f"""WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS DOUBLE) END AS quantity, CAST(l_extendedprice AS DOUBLE) AS price,
    l_returnflag AS mode, l_orderkey % 5 AS fold FROM lineitem), f AS (SELECT DISTINCT fold FROM d),
    m AS (SELECT f.fold, quantile_cont(quantity, 0.5) AS mid FROM f JOIN d ON d.fold <> f.fold GROUP BY f.fold),
    s AS (SELECT m.fold, avg(coalesce(quantity, mid)) AS mean, stddev_pop(coalesce(quantity, mid)) AS sd, min(price) AS lo, max(price) AS hi, count(*) AS n
     FROM m JOIN d ON d.fold <> m.fold GROUP BY m.fold),
    c AS (SELECT f.fold, mode, count(*) AS n_mode FROM f JOIN d ON d.fold <> f.fold GROUP BY f.fold, mode)
    SELECT CAST(d.fold AS BIGINT) AS fold, l_orderkey, l_linenumber, {r('(coalesce(quantity, mid) - mean) / sd')} AS quantity, {r('(price - lo) / (hi - lo)')} AS price,
     {r('coalesce(n_mode / n, 0)')} AS mode_frequency FROM d JOIN m USING (fold) JOIN s USING (fold) LEFT JOIN c ON c.fold = d.fold AND c.mode = d.mode""",
)
def _(spark, d):
    line = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("mode"),
        (F.col("l_orderkey") % 5).cast("long").alias("fold"),
    )
    recipe = Recipe(
        [One("quantity", "numeric", "median", "none", "standard"), One("price", "numeric", "none", "none", "minmax"), One("mode", "categorical", "none", "frequency")]
    )
    encoded = recipe.encode_folds(line, range(5), ["l_orderkey", "l_linenumber"])
    return numbers(encoded, 6)


_BOARD_SCORES = """s AS (SELECT CASE l_returnflag WHEN 'A' THEN 'Forest' WHEN 'N' THEN 'Linear' ELSE 'Baseline' END AS model, l_linenumber AS fold,
 avg(l_quantity) / 50 - CASE WHEN l_returnflag = 'R' THEN 0.2 ELSE 0 END AS value FROM lineitem GROUP BY l_returnflag, l_linenumber)"""


def _board(spark, d, lift=0.2):
    line = table(spark, d, "lineitem")
    model = F.when(F.col("l_returnflag") == "A", "Forest").when(F.col("l_returnflag") == "N", "Linear").otherwise("Baseline")
    scores = line.groupBy("l_returnflag", F.col("l_linenumber").alias("fold")).agg((F.avg("l_quantity") / 50).alias("v"))
    value = F.col("v") - F.when(F.col("l_returnflag") == "R", lift).otherwise(0.0)
    scores = scores.select(model.alias("model"), "fold", F.lit("r2").alias("metric"), value.alias("value"))
    return H.rank_leaderboard(scores, "r2", {"Boosted": "did not converge"})


@query(
    "h10_rank_leaderboard",
    f"""WITH {_BOARD_SCORES}, b AS (SELECT model, avg(value) AS score, stddev_pop(value) AS std, '' AS error FROM s GROUP BY model UNION ALL SELECT 'Boosted', NULL, NULL, 'did not converge'),
    k AS (SELECT *, row_number() OVER (ORDER BY error <> '', score DESC NULLS LAST, model) AS rank FROM b)
    SELECT rank, model, {r('score')} AS score, {r('std')} AS std, error, model = 'Baseline' AS is_baseline, rank = (SELECT min(rank) FROM k WHERE model <> 'Baseline' AND error = '') AS is_winner FROM k""",
)
def _(spark, d):
    return numbers(_board(spark, d), 6)


@query(
    "h11_baseline_verdict",
    f"""WITH {_BOARD_SCORES.replace('0.2 ELSE', '-0.2 ELSE')}, b AS (SELECT model, avg(value) AS score, stddev_pop(value) AS std FROM s GROUP BY model),
    w AS (SELECT * FROM b WHERE model <> 'Baseline' ORDER BY score DESC, model LIMIT 1), v AS (SELECT w.score - b.score AS gap, w.std AS std FROM w, b WHERE b.model = 'Baseline')
    SELECT {r('gap')} AS gap, CASE WHEN gap <= 0 THEN 'not beaten' WHEN gap < std THEN 'unproven' END AS verdict FROM v WHERE gap <= 0 OR gap < std""",
)
def _(spark, d):
    return numbers(H.baseline_verdict(_board(spark, d, -0.2)), 6)


@query("h13_fit_final")
def _(spark, d):
    docs = labelled_docs(spark, d)
    model = H.fit_final(docs, Recipe(DOC_STRATEGIES), H.roster("classification")[1], "quality", "classification", "doc_id")
    path = scratch_path(spark, "final-model")
    model.save(spark, path)
    return H.FittedModel.load(spark, path).predict(docs, ["doc_id"])


def _card_sql():
    parts = []
    for i, (c, dtype, role, used) in enumerate(
        [("p_name", "string", "text", True), ("p_brand", "string", "categorical", True), ("p_type", "string", "categorical", True), ("p_size", "bigint", "numeric", True)]
    ):
        parts.append(
            f"""SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS "column", '{dtype}' AS dtype, '{role}' AS role, {str(used).lower()} AS used, arg_min(CAST({c} AS VARCHAR), p_partkey) AS example FROM part"""
        )
    return union_all(parts)


@query("h14_model_card", _card_sql())
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return H.model_card(part, strategies_for(part.drop("p_partkey"), "p_retailprice"), "p_partkey", "p_retailprice")


# ---- I -------------------------------------------------------------------------------------------

_CLASSES = """, c AS (SELECT fold, label, sum(hit) AS hit, sum(actual) AS actual, sum(predicted) AS predicted FROM (
 SELECT fold, y AS label, CASE WHEN y = pred THEN 1 ELSE 0 END AS hit, 1 AS actual, 0 AS predicted FROM g UNION ALL SELECT fold, pred, 0, 0, 1 FROM g) GROUP BY ALL)"""


def _macro(name, expr):
    return f"SELECT fold, '{name}' AS metric, {r(expr)} AS value FROM c GROUP BY fold"


_MACRO = {
    "accuracy": "sum(hit) / sum(actual)",
    "precision_macro": "avg(CASE WHEN predicted = 0 THEN 0 ELSE hit / predicted END)",
    "recall_macro": "avg(CASE WHEN actual = 0 THEN 0 ELSE hit / actual END)",
    "f1_macro": "avg(CASE WHEN actual + predicted = 0 THEN 0 ELSE 2 * hit / (actual + predicted) END)",
}


def _classified(spark, d, metric):
    out = M.classification_metrics(guesses(spark, d), by=["fold"])
    return numbers(out.where(F.col("metric") == metric).select("fold", "metric", "value"), 6)


@query("i1_accuracy", _GUESS + _CLASSES + _macro("accuracy", _MACRO["accuracy"]))
def _(spark, d):
    return _classified(spark, d, "accuracy")


@query("i2_macro_precision", _GUESS + _CLASSES + _macro("precision_macro", _MACRO["precision_macro"]))
def _(spark, d):
    return _classified(spark, d, "precision_macro")


@query("i3_macro_recall", _GUESS + _CLASSES + _macro("recall_macro", _MACRO["recall_macro"]))
def _(spark, d):
    return _classified(spark, d, "recall_macro")


@query("i4_macro_f1", _GUESS + _CLASSES + _macro("f1_macro", _MACRO["f1_macro"]))
def _(spark, d):
    return _classified(spark, d, "f1_macro")


def _auc_sql(source, by, hit, score):
    """Rank-sum AUC with average ranks."""
    return f"""SELECT {by}, (sum(CASE WHEN hit THEN ar END) - count(CASE WHEN hit THEN 1 END) * (count(CASE WHEN hit THEN 1 END) + 1) / 2.0)
    / (count(CASE WHEN hit THEN 1 END) * count(CASE WHEN NOT hit THEN 1 END)) AS auc FROM (SELECT {by}, {hit} AS hit,
    rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS ar FROM {source}) GROUP BY {by}"""


@query("i5_roc_auc", f"{_GUESS}, a AS ({_auc_sql('g', 'fold', chr(39) + 'R' + chr(39) + ' = y', 'score')}) SELECT fold, 'roc_auc' AS metric, {r('auc')} AS value FROM a")
def _(spark, d):
    out = M.ranking_metrics(guesses(spark, d), F.col("y") == "R", F.col("score"), ["fold"])
    return numbers(out.where("metric = 'roc_auc'").select("fold", "metric", "value"), 6)


@query(
    "i6_roc_auc_multiclass",
    f"""{_GUESS}, e AS (SELECT fold, 'A' AS k, y = 'A' AS hit, 1 - l_quantity / 50 AS s FROM g UNION ALL SELECT fold, 'N', y = 'N', l_quantity / 100 FROM g UNION ALL SELECT fold, 'R', y = 'R', score / 2 FROM g),
    a AS ({_auc_sql('e', 'fold, k', 'hit', 's')}) SELECT fold, 'roc_auc' AS metric, {r('avg(auc)')} AS value FROM a GROUP BY fold""",
)
def _(spark, d):
    g = guesses(spark, d)
    probs = F.array(1 - F.col("l_quantity") / 50, F.col("l_quantity") / 100, F.col("score") / 2)
    out = M.multiclass_auc(g.select("fold", "y", probs.alias("p")), "y", "p", ["A", "N", "R"], ["fold"])
    return numbers(out.select("fold", "metric", "value"), 6)


@query(
    "i7_pr_auc",
    f"""{_GUESS}, s AS (SELECT fold, score, count(*) FILTER (y = 'R') AS pos, count(*) AS n FROM g GROUP BY ALL),
    k AS (SELECT fold, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM s WINDOW w AS (PARTITION BY fold ORDER BY score DESC))
    SELECT fold, 'pr_auc' AS metric, {r('sum(pos * tp / seen) / sum(pos)')} AS value FROM k GROUP BY fold""",
)
def _(spark, d):
    out = M.ranking_metrics(guesses(spark, d), F.col("y") == "R", F.col("score"), ["fold"])
    return numbers(out.where("metric = 'pr_auc'").select("fold", "metric", "value"), 6)


@query(
    "i8_undefined_metric",
    f"{_GUESS} SELECT y, metric, CAST(NULL AS DOUBLE) AS value, CASE WHEN metric = 'roc_auc' THEN 'only one class is present' ELSE 'no positive row is present' END AS reason "
    "FROM (SELECT DISTINCT y FROM g WHERE y <> 'R'), (VALUES ('roc_auc'), ('pr_auc')) AS m(metric) "
    "UNION ALL SELECT DISTINCT 'R', 'roc_auc', CAST(NULL AS DOUBLE), 'only one class is present' FROM g UNION ALL SELECT DISTINCT 'R', 'pr_auc', 1.0, NULL FROM g",
)
def _(spark, d):
    return numbers(M.ranking_metrics(guesses(spark, d), F.col("y") == "R", F.col("score"), ["y"]), 6)


def _regression(name, expr, digits):
    @query(name, f"{_PRICE} SELECT fold, '{name.split('_', 1)[1]}' AS metric, {r(expr, digits)} AS value FROM p GROUP BY fold")
    def _(spark, d):
        out = M.regression_metrics(prices(spark, d), by=["fold"], metrics=[name.split("_", 1)[1]])
        return numbers(out.select("fold", "metric", "value"), digits)


_regression("i9_mae", "avg(abs(y - pred))", 4)
_regression("i10_median_ae", "median(abs(y - pred))", 4)
_regression("i11_mse", "avg((y - pred) * (y - pred))", 0)
_regression("i11_rmse", "sqrt(avg((y - pred) * (y - pred)))", 4)
_regression("i12_r2", "1 - avg((y - pred) * (y - pred)) / var_pop(y)", 6)
_regression("i13_median_ape", "median(CASE WHEN y <> 0 THEN abs(y - pred) / abs(y) END)", 6)

_FOLD_METRICS = f"""f AS (SELECT fold, unnest(['mae', 'median_ae', 'rmse', 'r2']) AS metric, unnest([avg(abs(y - pred)), median(abs(y - pred)), sqrt(avg((y - pred) * (y - pred))),
 1 - avg((y - pred) * (y - pred)) / var_pop(y)]) AS value FROM p GROUP BY fold)"""
_FOUR = ["mae", "median_ae", "rmse", "r2"]


@query("i14_fold_summary", f"{_PRICE}, {_FOLD_METRICS} SELECT metric, {r('avg(value)', 4)} AS mean, {r('stddev_pop(value)', 4)} AS std, count(value) AS folds FROM f GROUP BY metric")
def _(spark, d):
    scores = M.regression_metrics(prices(spark, d), by=["fold"], metrics=_FOUR)
    return numbers(M.summarise_folds(scores), 4)


@query(
    "i15_concentrated_error",
    f"""{_PRICE}, s AS (SELECT fold, 1 - avg((y - pred) * (y - pred)) / var_pop(y) AS r2 FROM p GROUP BY fold), w AS (SELECT fold, r2 FROM s ORDER BY r2, fold LIMIT 1),
    m AS (SELECT median(r2) AS mid FROM s WHERE fold <> (SELECT fold FROM w)),
    e AS (SELECT y, (y - pred) * (y - pred) AS e2, sum((y - pred) * (y - pred)) OVER (ORDER BY (y - pred) * (y - pred) DESC, l_orderkey, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS cum,
      sum((y - pred) * (y - pred)) OVER () AS total, count(*) OVER () AS n FROM p WHERE fold = (SELECT fold FROM w)),
    t AS (SELECT *, (cum - e2) / total < 0.5 AS dom FROM e)
    SELECT (SELECT fold FROM w) AS fold, {r('(SELECT r2 FROM w)', 4)} AS score, {r('(SELECT mid FROM m)', 4)} AS middle_score, any_value(n) AS scored_rows, count(*) FILTER (dom) AS heavy_rows,
    {r('max(cum) FILTER (dom) / any_value(total)')} AS heavy_share, {r('1 - avg(e2) FILTER (NOT dom) / var_pop(y) FILTER (NOT dom)', 4)} AS score_without_heavy FROM t
    HAVING (SELECT mid FROM m) - (SELECT r2 FROM w) >= 0.05 AND count(*) FILTER (dom) <= greatest(1, floor(any_value(n) * 0.05))""",
)
def _(spark, d):
    out = M.concentrated_error(prices(spark, d), ["l_orderkey", "l_partkey", "l_suppkey"])
    digits = {"heavy_share": 6}
    return out.select(*[rounded(F.col(f.name), digits.get(f.name, 4)).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in out.schema])


@query(
    "i16_error_shape",
    f"""{_PRICE}, {_FOLD_METRICS}, m AS (SELECT avg(value) FILTER (metric = 'mae') AS mae, avg(value) FILTER (metric = 'rmse') AS rmse, avg(value) FILTER (metric = 'median_ae') AS med FROM f)
    SELECT {r('rmse / mae')} AS rmse_to_mae, {r('mae / med')} AS mae_to_median, rmse / mae >= 1.5 AS tail_dominated, mae / med >= 1.5 AS typical_is_better FROM m""",
)
def _(spark, d):
    return numbers(M.error_shape(M.summarise_folds(M.regression_metrics(prices(spark, d), by=["fold"], metrics=_FOUR))), 6)


@query("i17_confusion", _GUESS + " SELECT fold, y, pred, count(*) AS n FROM g GROUP BY ALL")
def _(spark, d):
    return M.confusion(guesses(spark, d), by=["fold"])


@query("i17_fold_sizes", _GUESS + " SELECT fold, (SELECT count(*) FROM g) - count(*) AS n_train, count(*) AS n_test FROM g GROUP BY fold")
def _(spark, d):
    return M.fold_sizes(guesses(spark, d))


@query(
    "i18_fold_spread",
    f"""{_PRICE}, {_FOLD_METRICS}, s AS (SELECT metric, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS folds FROM f GROUP BY metric)
    SELECT metric, {r('mean', 4)} AS mean, {r('std', 4)} AS std, folds, CASE WHEN metric <> 'r2' THEN 'spread only' WHEN std < 0.02 THEN 'stable' WHEN std < 0.08 THEN 'moderate' ELSE 'wide' END AS band FROM s""",
)
def _(spark, d):
    scores = M.regression_metrics(prices(spark, d), by=["fold"], metrics=_FOUR)
    return numbers(M.spread_note(M.summarise_folds(scores)), 4)


# ---- K -------------------------------------------------------------------------------------------


@query(
    "k1_align",
    "SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value, event_type, CAST(NULL AS DOUBLE) AS absent, CAST(user_id AS DOUBLE) AS user_id FROM events",
)
def _(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", "user_id", "event_type", F.when(F.col("event_type") == "error", "bad").otherwise(F.col("value").cast("string")).alias("value"), "props"
    )
    aligned, _, _ = K.align(rows, [("value", "double"), ("event_type", "string"), ("absent", "double"), ("user_id", "bigint")], ["event_id"])
    return aligned


_LINE_STRATEGIES = [One("l_quantity", "numeric", "median"), One("l_discount", "numeric", "median")]
_LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _line_model(spark, d):
    line = table(spark, d, "lineitem")
    return H.fit_final(line, Recipe(_LINE_STRATEGIES), H.roster("regression")[1], "l_extendedprice", "regression", "l_orderkey")


_PREDICTED = f"""WITH m AS (SELECT avg(l_quantity) AS x1, avg(l_discount) AS x2, avg(l_extendedprice) AS y, var_pop(l_quantity) AS v1, var_pop(l_discount) AS v2, covar_pop(l_quantity, l_discount) AS c,
    covar_pop(l_quantity, l_extendedprice) AS c1, covar_pop(l_discount, l_extendedprice) AS c2 FROM lineitem),
    b AS (SELECT *, (c1 * v2 - c2 * c) / (v1 * v2 - c * c) AS b1, (c2 * v1 - c1 * c) / (v1 * v2 - c * c) AS b2 FROM m)
    SELECT {', '.join(_LINE_KEYS)}, {r('y + b1 * (l_quantity - x1) + b2 * (l_discount - x2)', 3)} AS pred FROM lineitem, b"""


@query("k3_predict", _PREDICTED)
def _(spark, d):
    model = _line_model(spark, d)
    return numbers(K.score(model, table(spark, d, "lineitem"), _LINE_KEYS), 3)


@query("k4_probabilities", "SELECT doc_id, true AS sums_to_one, true AS named FROM documents JOIN labels USING (doc_id)")
def _(spark, d):
    docs = labelled_docs(spark, d)
    model = H.fit_final(docs, Recipe(DOC_STRATEGIES), H.roster("classification")[1], "quality", "classification", "doc_id")
    p = F.col("probabilities")
    total = F.aggregate(F.map_values(p), F.lit(0.0), lambda a, v: a + v)
    names = F.array_sort(F.map_keys(p))
    return K.score(model, docs, ["doc_id"]).select(
        "doc_id", (F.abs(total - 1) < 1e-9).alias("sums_to_one"), (names == F.array(F.lit("good"), F.lit("poor"))).alias("named")
    )


@query("k5_inverse_target", f"SELECT event_id, {r('exp(value / 20) - 1', 4)} AS pred FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", rounded(from_model_scale(F.col("value") / 20), 4).alias("pred"))


@query("k6_score_stream", _PREDICTED)
def _(spark, d):
    model = _line_model(spark, d)
    schema = table(spark, d, "lineitem").schema
    source = scratch_path(spark, "incoming")
    table(spark, d, "lineitem").write.parquet(source)
    rows = read_stream(spark, source, schema)
    out = scratch_path(spark, "scored")
    stream = score_stream(model, rows, [("l_quantity", "double"), ("l_discount", "double")], _LINE_KEYS, out, once=True)
    stream.awaitTermination()
    return spark.read.parquet(out).select(*_LINE_KEYS, rounded(F.col("pred"), 3).alias("pred"))
