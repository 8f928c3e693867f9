"""Groups E, J and L: clusters, attribution, findings, passages, search and ledgers."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabsight.functions.columns import rounded, word_count
from tabsight.operators import cluster as E
from tabsight.operators import explain as J
from tabsight.operators import ledger as U
from tabsight.operators import models as H
from tabsight.operators import retrieve as L
from tabsight.operators import review as V
from tabsight.operators.recipe import Recipe
from tabsight.operators.split import stratified_sample
from tabsight.operators.strategy import ColumnStrategy as One
from tabsight.plans.eda import numbers
from tabsight.plans.models import EVENT_STRATEGIES
from tabsight.plans.registry import query, r, table, union_all
from tabsight.sources.tables import read_report, scratch_path

# ---- E -------------------------------------------------------------------------------------------

_EV = [("event_id", "numeric"), ("user_id", "numeric"), ("event_type", "categorical"), ("props", "categorical")]


@query(
    "e1_cluster_columns",
    union_all([f"""SELECT '{c}' AS "column", '{k}' AS kind, count(DISTINCT {c}) AS n_unique, '{k}' = 'numeric' OR count(DISTINCT {c}) <= 30 AS eligible FROM events""" for c, k in _EV]),
)
def _(spark, d):
    return E.cluster_columns(table(spark, d, "events"), "value")


def _mixed(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")


@query(
    "e3_prepare_matrix",
    "WITH s AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2 FROM part), t AS (SELECT list(DISTINCT p_type ORDER BY p_type) AS types FROM part) "
    "SELECT p_partkey, list_concat([round((p_size - m1) / s1, 6) + 0.0, round((p_retailprice - m2) / s2, 6) + 0.0], list_transform(types, lambda t: CASE WHEN t = p_type THEN 1.0 ELSE 0.0 END)) AS features FROM part, s, t",
)
def _(spark, d):
    part = _mixed(spark, d)
    out = E.prepare_matrix(part, ["p_size", "p_retailprice"], ["p_type"]).transform(part, ["p_partkey"])
    return out.select("p_partkey", F.transform(vector_to_array("features"), lambda v: F.round(v, 6) + 0.0).alias("features"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))


@query("e4_kmeans")
def _(spark, d):
    vectors = _vectors(spark, d).persist()
    return E.kmeans(vectors, 5).transform(vectors).select("vec_id", F.col("cluster").cast("long").alias("cluster"))


@query("e5_kprototypes")
def _(spark, d):
    part = _mixed(spark, d)
    prepared = E.prepare_matrix(part, ["p_size", "p_retailprice"], [])
    scaled = prepared.encode(part, ["p_partkey", "p_type"]).persist()
    model = E.kprototypes(scaled, ["p_size", "p_retailprice"], ["p_type"], 4, "p_partkey")
    return model.assign(scaled).select("p_partkey", F.col("cluster").cast("long").alias("cluster"), rounded(F.col("cost")).alias("cost"))


@query("e6_select_k")
def _(spark, d):
    vectors = _vectors(spark, d)

    def fit(frame, k):
        return E.kmeans(frame, k).transform(frame).select("vec_id", "cluster", vector_to_array("features").alias("features"))

    best, scores = E.select_k(vectors, "vec_id", fit)
    shown = spark.createDataFrame([(k, v) for k, v in scores.items()], "k long, silhouette double")
    return shown.withColumn("chosen", F.col("k") == best)


def _silhouette_sql(distance: str, rows: str) -> str:
    """Mean distances over all pairs, one row a pair."""
    return f"""WITH v AS ({rows}), p AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum({distance}) AS total, count(*) AS n
    FROM v a, v b GROUP BY ALL), s AS (SELECT vec_id, own, max(CASE WHEN own = other THEN total / (n - 1) END) AS inside, min(CASE WHEN own <> other THEN total / n END) AS outside FROM p GROUP BY ALL)
    SELECT own AS cluster, count(*) AS n, {r('avg((outside - inside) / greatest(inside, outside))', 5)} AS silhouette"""


_SQUARE = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))"


@query("e7_silhouette", _silhouette_sql(_SQUARE, "SELECT vec_id, label, embedding FROM embeddings") + " FROM s GROUP BY own")
def _(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    each = E.silhouette(vectors, "x", "label", "vec_id")
    return each.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("silhouette"), 5).alias("silhouette"))


@query(
    "e7_silhouette_of_sample",
    _silhouette_sql(f"sqrt({_SQUARE})", "SELECT vec_id, label, embedding FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42') LIMIT 400")
    + ", 400 AS sample_rows FROM s GROUP BY own",
)
def _(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    each = E.silhouette_of_sample(vectors, 400, "x", "label", "vec_id")
    return each.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("silhouette"), 5).alias("silhouette"), F.max("sample_rows").alias("sample_rows"))


@query(
    "e8_profile_vectors",
    f"""WITH u AS (SELECT label AS cluster, 'e' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS feature, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
    o AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s FROM u GROUP BY feature), g AS (SELECT cluster, feature, (avg(v) - any_value(m)) / any_value(s) AS z FROM u JOIN o USING (feature) GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, feature) AS position FROM g WHERE abs(z) >= 0.5),
    z AS (SELECT label AS cluster, count(*) AS size, count(*) / (SELECT count(*) FROM embeddings) AS share FROM embeddings GROUP BY label)
    SELECT cluster, size, {r('share')} AS share, feature, CASE WHEN feature IS NOT NULL THEN 'numeric' END AS kind, CASE WHEN z IS NOT NULL THEN {r('abs(z)', 5)} END AS strength,
    CASE WHEN z > 0 THEN 'higher' WHEN z <= 0 THEN 'lower' END AS detail, position FROM z LEFT JOIN (SELECT * FROM k WHERE position <= 4) USING (cluster)""",
)
def _(spark, d):
    wide = table(spark, d, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"e{i:02d}") for i in range(64)])
    out = E.profile_clusters(wide, "label", [f"e{i:02d}" for i in range(64)])
    return out.withColumn("share", rounded(F.col("share"))).withColumn("strength", rounded(F.col("strength"), 5))


@query(
    "e8_profile_mixed",
    f"""WITH o AS (SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus, CASE WHEN o_totalprice > 300000 THEN 'large' ELSE 'small' END AS cluster, CASE WHEN o_totalprice > 300000 AND o_orderstatus <> 'F' THEN 'big' ELSE 'any' END AS band FROM orders),
    s AS (SELECT cluster, count(*) AS size, count(*) / (SELECT count(*) FROM o) AS share FROM o GROUP BY cluster),
    z AS (SELECT cluster, 'o_totalprice' AS feature, 'numeric' AS kind, abs((avg(o_totalprice) - (SELECT avg(o_totalprice) FROM o)) / (SELECT stddev_pop(o_totalprice) FROM o)) AS strength,
      CASE WHEN avg(o_totalprice) > (SELECT avg(o_totalprice) FROM o) THEN 'higher' ELSE 'lower' END AS detail FROM o GROUP BY cluster),
    c AS (SELECT cluster, 'band' AS feature, 'categorical' AS kind, max_by(l, l) - 0 AS strength, arg_max(band, n) AS detail FROM (SELECT cluster, band, count(*) AS n, count(*) / (SELECT size FROM s WHERE s.cluster = o.cluster) - (SELECT count(*) FROM o AS a WHERE a.band = o.band) / (SELECT count(*) FROM o) AS l,
      row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, band) AS rn FROM o GROUP BY cluster, band) WHERE rn = 1 GROUP BY cluster),
    f AS (SELECT * FROM z WHERE strength >= 0.5 UNION ALL SELECT * FROM c WHERE strength >= 0.15), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY strength DESC, feature) AS position FROM f)
    SELECT cluster, size, {r('share')} AS share, feature, kind, {r('strength', 5)} AS strength, detail, position FROM s LEFT JOIN k USING (cluster)""",
)
def _(spark, d):
    orders = table(spark, d, "orders")
    large = F.col("o_totalprice") > 300000
    df = orders.select("o_totalprice", F.when(large, "large").otherwise("small").alias("cluster"), F.when(large & (F.col("o_orderstatus") != "F"), "big").otherwise("any").alias("band"))
    out = E.profile_clusters(df, "cluster", ["o_totalprice"], ["band"])
    return out.withColumn("share", rounded(F.col("share"))).withColumn("strength", rounded(F.col("strength"), 5))


@query("e10_pca_scatter")
def _(spark, d):
    scatter, shares = E.pca_scatter(_vectors(spark, d), "vec_id")
    centres = E.cluster_centres(scatter, "label")
    return centres.select("label", "x", "y", *[F.lit(v).alias(f"variance_{i + 1}") for i, v in enumerate(shares)])


@query("e11_cluster_sample", "SELECT event_id, value FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || ':42') LIMIT 5000")
def _(spark, d):
    return E.cluster_sample(table(spark, d, "events").select("event_id", "value"), "event_id")


# ---- J -------------------------------------------------------------------------------------------

_XS = ["l_quantity", "l_discount", "l_tax"]
_BETAS = [1500.0, -20000.0, 5000.0]
_LK = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _phi(spark, d):
    """Attribution of a fixed linear model over lineitem: phi_i = beta_i * (x_i - mean_i)."""
    line = table(spark, d, "lineitem").select(*_LK, *_XS)
    means = J.feature_means(line, _XS)
    return J.linear_shap(line, _XS, _BETAS, 100.0, means, [*_LK, *_XS])


def _keyed_phi(spark, d):
    """The same over orders-sized rows with a single key, in long form by encoded feature."""
    part = table(spark, d, "part")
    fitted = Recipe([One("p_size", "numeric", "median"), One("p_retailprice", "numeric", "median"), One("p_type", "categorical", "none", "onehot")]).fit(part)
    encoded = fitted.encode(part, ["p_partkey"])
    betas = [2.0, 0.5, *[10.0 * (i + 1) for i in range(len(fitted.names) - 2)]]
    means = J.feature_means(encoded, fitted.names)
    phi = J.linear_shap(encoded, fitted.names, betas, 0.0, means, ["p_partkey"])
    return part, fitted, encoded, phi


_LONG = """WITH t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS i FROM (SELECT DISTINCT p_type FROM part)),
 l AS (SELECT p_partkey, 'p_size' AS encoded, 'p_size' AS source, 2.0 * (p_size - (SELECT avg(p_size) FROM part)) AS phi, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL
 SELECT p_partkey, 'p_retailprice', 'p_retailprice', 0.5 * (p_retailprice - (SELECT avg(p_retailprice) FROM part)), p_retailprice FROM part UNION ALL
 SELECT p_partkey, 'p_type_' || t.p_type, 'p_type', 10.0 * i * (CASE WHEN part.p_type = t.p_type THEN 1 ELSE 0 END - (SELECT count(*) FROM part AS a WHERE a.p_type = t.p_type) / (SELECT count(*) FROM part)), CASE WHEN part.p_type = t.p_type THEN 1.0 ELSE 0.0 END FROM part, t)"""


@query(
    "j1_linear_shap",
    f"""WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem) SELECT {', '.join(_LK)},
    list_transform([1500.0 * (l_quantity - q), -20000.0 * (l_discount - d), 5000.0 * (l_tax - t)], lambda v: round(v, 4) + 0.0) AS phi, {r('100 + 1500 * q - 20000 * d + 5000 * t', 4)} AS base FROM lineitem, m""",
)
def _(spark, d):
    return _phi(spark, d).select(*_LK, F.transform("phi", lambda v: F.round(v, 4) + 0.0).alias("phi"), rounded(F.col("base"), 4).alias("base"))


def _tree_phi(spark, d):
    events = table(spark, d, "events")
    recipe = Recipe(EVENT_STRATEGIES)
    model = H.fit_final(events, recipe, H.roster("regression", depth=8)[0], "value", "regression", "event_id")
    encoded = model.recipe.transform(events, ["event_id"])
    phi = J.tree_shap(model.model, model.model.transform(encoded), len(model.recipe.names), ["event_id", "prediction"])
    return model, phi


@query("j2_tree_shap")
def _(spark, d):
    _, phi = _tree_phi(spark, d)
    return phi.select("event_id", "phi", "base", "prediction")


@query("j3_check_additivity", "SELECT true AS holds, count(*) AS n FROM events")
def _(spark, d):
    _, phi = _tree_phi(spark, d)
    n = phi.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("_k"))
    return J.check_additivity(phi, F.col("prediction")).select("holds", F.lit(1).alias("_k")).join(n, "_k").select("holds", "n")


@query("j4_to_source", f"{_LONG} SELECT p_partkey, source, {r('sum(phi)')} AS phi FROM l GROUP BY ALL")
def _(spark, d):
    _, fitted, _, phi = _keyed_phi(spark, d)
    return numbers(J.to_source(J.long_phi(phi, fitted.names, ["p_partkey"]), fitted.lineage_table(spark), ["p_partkey"]), 6)


@query(
    "j5_global_importance",
    f"""{_LONG}, f AS (SELECT encoded, source, avg(abs(phi)) AS i FROM l GROUP BY ALL), s AS (SELECT source, sum(i) AS importance, count(*) AS encoded_features FROM f GROUP BY source)
    SELECT source, {r('importance')} AS importance, encoded_features, {r('importance / sum(importance) OVER ()')} AS share, row_number() OVER (ORDER BY importance DESC, source) AS position FROM s QUALIFY position <= 15""",
)
def _(spark, d):
    _, fitted, _, phi = _keyed_phi(spark, d)
    return numbers(J.global_importance(J.long_phi(phi, fitted.names, ["p_partkey"]), fitted.lineage_table(spark)), 6)


@query("j6_direction", "SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS source, unnest(['up', 'down', 'up']) AS direction")
def _(spark, d):
    values = _phi(spark, d).select(*_XS, *[F.col("phi")[i].alias(f"phi_{c}") for i, c in enumerate(_XS)])
    return J.direction(values, _XS)


@query(
    "j7_representative_rows",
    """WITH p AS (SELECT o_orderkey, o_totalprice AS pred, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i, count(*) OVER () AS n FROM orders)
    SELECT CASE WHEN i = n THEN 'highest' WHEN i = 1 THEN 'lowest' ELSE 'middle' END AS reason, o_orderkey FROM p WHERE i = n OR i = 1 OR i = n // 2 + 1""",
)
def _(spark, d):
    return J.representative_rows(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("pred")), "o_orderkey", "regression")


@query(
    "j7_representative_classes",
    "SELECT 'high' AS reason, (SELECT c_custkey FROM customer ORDER BY c_acctbal / 10000 DESC, c_custkey LIMIT 1) AS c_custkey UNION ALL SELECT 'low', (SELECT c_custkey FROM customer ORDER BY 1 - c_acctbal / 10000 DESC, c_custkey LIMIT 1)",
)
def _(spark, d):
    p = F.col("c_acctbal") / 10000
    return J.representative_rows(table(spark, d, "customer").select("c_custkey", F.array(p, 1 - p).alias("probabilities")), "c_custkey", "classification", ["high", "low"])


@query(
    "j8_explain_rows",
    f"""{_LONG}, s AS (SELECT p_partkey, source, sum(phi) AS phi FROM l GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(phi) DESC, source) AS position, 7.0 + sum(phi) OVER (PARTITION BY p_partkey) AS output FROM s)
    SELECT p_partkey, least(position, 3) AS position, CASE WHEN position <= 2 THEN source ELSE '(other)' END AS source, {r('sum(phi)', 5)} AS phi, {r('any_value(output)', 5)} AS output FROM k GROUP BY 1, 2, 3""",
)
def _(spark, d):
    _, fitted, _, phi = _keyed_phi(spark, d)
    source = J.to_source(J.long_phi(phi, fitted.names, ["p_partkey"]), fitted.lineage_table(spark), ["p_partkey"])
    return numbers(J.explain_rows(source, "p_partkey", 7.0, 2).withColumn("position", F.col("position").cast("long")), 5)


@query(
    "j9_explain_sample",
    """SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR) || ':42')) AS pos,
    greatest(1, round_even(count(*) OVER (PARTITION BY event_type) * (500.0 / (SELECT count(*) FROM events)), 0)) AS quota FROM events) WHERE pos <= quota""",
)
def _(spark, d):
    return stratified_sample(table(spark, d, "events").select("event_id", "event_type"), ["event_id"], "event_type", J.EXPLAINED_ROWS)


def _values(spark, d):
    _, fitted, encoded, phi = _keyed_phi(spark, d)
    entries = F.array(*[F.struct(F.lit(n).alias("encoded"), F.col(f"`{n}`").alias("value"), F.col("phi")[i].alias("phi")) for i, n in enumerate(fitted.names)])
    return encoded.join(phi, "p_partkey").select("p_partkey", F.inline(entries))


@query(
    "j10_beeswarm",
    f"""{_LONG}, s AS (SELECT encoded FROM l GROUP BY encoded HAVING avg(abs(phi)) > 0 ORDER BY avg(abs(phi)) DESC, encoded LIMIT 10)
    SELECT p_partkey, encoded, {r('phi', 5)} AS phi, {r('(row_number() OVER (PARTITION BY encoded ORDER BY value, p_partkey) - 1) / (count(*) OVER (PARTITION BY encoded) - 1)')} AS shade FROM l JOIN s USING (encoded)""",
)
def _(spark, d):
    out = J.beeswarm(_values(spark, d), "p_partkey")
    return out.select("p_partkey", "encoded", rounded(F.col("phi"), 5).alias("phi"), rounded(F.col("shade")).alias("shade"))


@query(
    "j10_dependence",
    f"""{_LONG}, s AS (SELECT encoded FROM l GROUP BY encoded HAVING avg(abs(phi)) > 0 AND count(DISTINCT value) >= 8 ORDER BY avg(abs(phi)) DESC, encoded LIMIT 1)
    SELECT p_partkey, encoded, {r('value', 5)} AS value, {r('phi', 5)} AS phi FROM l JOIN s USING (encoded)""",
)
def _(spark, d):
    return numbers(J.dependence(_values(spark, d), "p_partkey"), 5)


# ---- report tables of many runs, one run per nation, derived from the business tables ----------------


def run_tables(spark, d):
    cust, sup = table(spark, d, "customer"), table(spark, d, "supplier")
    run = F.concat(F.lit("run"), F.col("c_nationkey").cast("string")).alias("run_id")
    ten = F.lit(10000.0)
    seg = cust.groupBy("c_nationkey", "c_mktsegment").agg((F.avg("c_acctbal") / ten).alias("score"), (F.coalesce(F.stddev_pop("c_acctbal"), F.lit(0.0)) / ten).alias("std"))
    from pyspark.sql import Window

    board = seg.select(
        run, F.col("c_mktsegment").alias("model"), "score", "std", F.when(F.col("score") < 0.25, "failed").otherwise("").alias("error"), (F.col("c_mktsegment") == "BUILDING").alias("is_baseline")
    )
    # five candidates per run
    board = board.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("error") != "", F.col("score").desc(), "model")).cast("long"))
    whole = cust.groupBy("c_nationkey").agg((F.avg("c_acctbal") / ten).alias("mean"), (F.stddev_pop("c_acctbal") / ten).alias("std"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("c_acctbal") < 0).alias("warnings"))
    evaluation = whole.select(run, F.lit("balance").alias("target"), F.lit("Random forest").alias("model"), F.lit("r2").alias("metric"), "mean", "std", "n_rows", "warnings", F.lit(True).alias("is_primary"))
    srun = F.concat(F.lit("run"), F.col("s_nationkey").cast("string")).alias("run_id")
    clustering = sup.groupBy("s_nationkey").agg((F.avg("s_acctbal") / ten).alias("silhouette"), F.count(F.lit(1)).alias("k")).select(srun, F.lit("kmeans").alias("method"), "k", "silhouette")
    share = seg.withColumn("_t", F.sum("score").over(Window.partitionBy("c_nationkey")))
    importance = share.select(run, F.col("c_mktsegment").alias("source"), (F.col("score") / F.col("_t")).alias("share"))
    importance = importance.withColumn("position", F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("share").desc(), "source")).cast("long"))
    explanation = whole.select(run, (F.col("mean") / 400).alias("additivity_error")).join(importance.groupBy("run_id").agg((F.max("share") * 2.2).alias("top_share")), "run_id")
    cleaning = whole.select(run, F.col("n_rows").alias("rows_before"), (F.col("n_rows") - F.col("warnings")).alias("rows_after"), F.lit(10).alias("columns_before"), F.lit(7).alias("columns_after"))
    features = whole.select(run, (F.col("warnings") % 2).alias("rejected"), F.col("warnings").alias("overridden"))
    sizes = cust.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("size"))
    clusters = sizes.withColumn("_t", F.sum("size").over(Window.partitionBy("c_nationkey"))).select(
        run, F.dense_rank().over(Window.partitionBy("c_nationkey").orderBy("c_mktsegment")).cast("long").alias("cluster"), "size", (F.col("size") / F.col("_t")).alias("share")
    )
    return {"leaderboard": board, "evaluation": evaluation, "clustering": clustering, "importance": importance, "explanation": explanation, "cleaning": cleaning, "features": features, "clusters": clusters}


_RUNS = """seg AS (SELECT 'run' || c_nationkey AS run_id, c_mktsegment AS model, avg(c_acctbal) / 10000 AS score, coalesce(stddev_pop(c_acctbal), 0) / 10000 AS std FROM customer GROUP BY c_nationkey, c_mktsegment),
 board AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY error <> '', score DESC, model) AS rank FROM (SELECT *, CASE WHEN score < 0.25 THEN 'failed' ELSE '' END AS error, model = 'BUILDING' AS is_baseline FROM seg)),
 ev AS (SELECT 'run' || c_nationkey AS run_id, avg(c_acctbal) / 10000 AS mean, stddev_pop(c_acctbal) / 10000 AS std, count(*) AS n_rows, count(*) FILTER (c_acctbal < 0) AS warnings FROM customer GROUP BY c_nationkey),
 cl AS (SELECT 'run' || s_nationkey AS run_id, avg(s_acctbal) / 10000 AS silhouette, count(*) AS k FROM supplier GROUP BY s_nationkey),
 imp AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY share DESC, source) AS position FROM (SELECT run_id, model AS source, score / sum(score) OVER (PARTITION BY run_id) AS share FROM seg)),
 ex AS (SELECT run_id, any_value(ev.mean) / 400 AS additivity_error, max(share) * 2.2 AS top_share FROM ev JOIN imp USING (run_id) GROUP BY run_id)"""

_FINDINGS = """two AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rank) AS p FROM board WHERE error = '' AND NOT is_baseline QUALIFY p <= 2),
 lead_ AS (SELECT run_id, max(CASE WHEN p = 1 THEN score END) - max(CASE WHEN p = 2 THEN score END) AS gap, max(std) AS spread FROM two GROUP BY run_id),
 found AS (SELECT run_id, 'modelling' AS area, 'note' AS severity, 'failed models' AS rule, CAST(count(*) FILTER (error <> '') AS DOUBLE) AS detail FROM board GROUP BY run_id HAVING count(*) FILTER (error <> '') > 0
 UNION ALL SELECT run_id, 'modelling', 'concern', 'lead inside the fold spread', gap FROM lead_ WHERE spread > 0 AND gap < spread
 UNION ALL SELECT run_id, 'evaluation', 'concern', 'score varies across folds', abs(std / mean) FROM ev WHERE abs(std / mean) > 0.15
 UNION ALL SELECT run_id, 'evaluation', 'concern', 'few rows', n_rows FROM ev WHERE n_rows < 200
 UNION ALL SELECT run_id, 'evaluation', 'note', 'recorded caveats', warnings FROM ev WHERE warnings > 0
 UNION ALL SELECT run_id, 'data_quality', 'note', 'weakly separated groups', silhouette FROM cl WHERE silhouette < 0.5
 UNION ALL SELECT run_id, 'explainability', 'blocker', 'contributions do not add up', additivity_error FROM ex WHERE additivity_error > 0.001
 UNION ALL SELECT run_id, 'explainability', 'concern', 'one column dominates', top_share FROM ex WHERE top_share > 0.6
 UNION ALL SELECT run_id, 'features', 'note', 'unknown columns rejected', warnings % 2 FROM ev WHERE warnings % 2 > 0
 UNION ALL SELECT run_id, 'features', 'note', 'choices overruled', warnings FROM ev WHERE warnings > 0)"""


@query("j11_measured_findings", f"WITH {_RUNS}, {_FINDINGS} SELECT run_id, area, severity, rule, {r('detail')} AS detail FROM found")
def _(spark, d):
    return numbers(V.by_severity(V.measured_findings(run_tables(spark, d))), 6)


@query("j11_severity_counts", f"WITH {_RUNS}, {_FINDINGS} SELECT run_id, severity, count(*) AS n FROM found GROUP BY ALL")
def _(spark, d):
    return V.severity_counts(V.measured_findings(run_tables(spark, d)))


# ---- L -------------------------------------------------------------------------------------------


def _passages(spark, d):
    tables = run_tables(spark, d)
    findings = V.measured_findings(tables)
    return L.build_passages({**{k: tables[k] for k in ("evaluation", "importance", "clusters", "cleaning")}, "findings": findings})


def _pct(x):
    return f"format('{{:.1f}}%', ({x}) * 100)"


_PASSAGES = f"""clu AS (SELECT 'run' || c_nationkey AS run_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS cluster, count(*) AS size, count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey) AS share FROM customer GROUP BY c_nationkey, c_mktsegment),
 texts AS (SELECT run_id, 1 AS s, '0' AS w, 'evaluation' AS source, 'Chosen model for balance' AS heading, format('Random forest predicts balance from {{}} rows; r2 is {{:.4f}}, spread {{:.4f}}.', n_rows, mean, std) AS content FROM ev
 UNION ALL SELECT run_id, 2, '0', 'explanation', 'Most influential columns', 'By influence: ' || string_agg(source || ' ' || {_pct('share')}, ', ' ORDER BY position) FROM imp WHERE position <= 12 GROUP BY run_id
 UNION ALL SELECT run_id, 3, lpad(CAST(position AS VARCHAR), 4, '0'), 'explanation', 'Influence of ' || source, source || ' is number ' || position || ' and carries ' || {_pct('share')} || ' of the total influence.' FROM imp WHERE position <= 12
 UNION ALL SELECT run_id, 4, lpad(CAST(cluster AS VARCHAR), 6, '0'), 'clustering', 'Group ' || cluster, 'Group ' || cluster || ' has ' || size || ' rows, ' || {_pct('share')} || ' of all.' FROM clu
 UNION ALL SELECT run_id, 5, severity || '/' || area || '/' || rule, 'review', severity || ' about ' || area, format('{{}} ({{:.4f}})', rule, CAST(detail AS DOUBLE)) FROM found
 UNION ALL SELECT run_id, 7, '0', 'cleaning', 'What cleaning removed', warnings || ' of ' || n_rows || ' rows were removed.' FROM ev)"""


@query("l1_build_passages", f"WITH {_RUNS}, {_FINDINGS}, {_PASSAGES} SELECT run_id, source, heading, content, row_number() OVER (PARTITION BY run_id ORDER BY s, w) - 1 AS ordinal FROM texts")
def _(spark, d):
    return _passages(spark, d)


_L2 = f"WITH {_RUNS}, {_FINDINGS}, {_PASSAGES} SELECT run_id, count(*) AS passages FROM texts WHERE run_id IN ('run1', 'run2') GROUP BY run_id"


@query("l2_index_run", _L2)
def _(spark, d):
    folder = scratch_path(spark, "index")
    passages = _passages(spark, d).persist()
    for run in ("run1", "run2", "run1"):
        L.index_run(passages, folder, run)
    passages.unpersist()
    return L.indexed_count(read_report(spark, folder, "passages"))


@query("l5_indexed_count", f"WITH {_RUNS}, {_FINDINGS}, {_PASSAGES} SELECT run_id, count(*) AS passages FROM texts GROUP BY run_id")
def _(spark, d):
    return L.indexed_count(_passages(spark, d))


_CENTROID = "SELECT list(m ORDER BY i) FROM (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY i)"


def _centroid(vectors):
    parts = vectors.select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return [row["m"] for row in parts.orderBy("i").collect()]


@query(
    "l3_search",
    f"""SELECT vec_id, {r(f'list_cosine_distance(CAST(embedding AS DOUBLE[]), ({_CENTROID}))')} AS distance FROM embeddings WHERE label = 3
    ORDER BY list_cosine_distance(CAST(embedding AS DOUBLE[]), ({_CENTROID})), vec_id LIMIT 6""",
)
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    found = L.search(vectors, _centroid(vectors), "vec_id", "embedding", max_distance=2.0, scope=F.col("label") == 3)
    return found.select("vec_id", rounded(F.col("distance")).alias("distance"))


@query(
    "l4_search_batch",
    f"""WITH q AS (SELECT label AS query, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i) GROUP BY label),
    k AS (SELECT CAST(query AS BIGINT) AS query, vec_id AS key, list_cosine_distance(CAST(embedding AS DOUBLE[]), v) AS distance, row_number() OVER (PARTITION BY query ORDER BY list_cosine_distance(CAST(embedding AS DOUBLE[]), v), vec_id) AS position FROM embeddings, q)
    SELECT query, key, {r('distance')} AS distance, position FROM k WHERE position <= 6 AND distance <= 0.85""",
)
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    # one centroid per label, as long as the vectors are wide
    queries = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("q"))
    return numbers(L.search_batch(vectors, queries, "vec_id", "embedding", "label", "q"), 6)


_RATE = {"user": ("2.718281", "7.389056"), "assistant": ("3.141592", "9.869604")}
_WORDS = "CASE WHEN trim(text, ' \t\n\r\f\v') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) END"
_COST = "round_even(CAST(coalesce((i * ir + o * orr) / 1000000, 0) AS DOUBLE), 6)"


@query(
    "l6_usage_totals",
    f"""WITH u AS (SELECT role, CAST({_WORDS} AS BIGINT) AS i, CAST(turn AS BIGINT) AS o FROM conversations), p AS (SELECT *, CASE role WHEN 'user' THEN 2.718281 WHEN 'assistant' THEN 3.141592 END AS ir, CASE role WHEN 'user' THEN 7.389056 WHEN 'assistant' THEN 9.869604 END AS orr FROM u)
    SELECT role, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, {r(f'sum({_COST})')} AS cost, count(*) AS requests FROM p GROUP BY ROLLUP (role)""",
)
def _(spark, d):
    talk = table(spark, d, "conversations")
    usage = talk.select("role", F.col("role").alias("tier"), word_count(F.col("text")).cast("long").alias("input_tokens"), F.col("turn").alias("output_tokens"))
    rates = spark.createDataFrame([(t, i, o) for t, (i, o) in _RATE.items()], "tier string, input_rate string, output_rate string")
    rates = rates.select("tier", F.col("input_rate").cast("decimal(12,6)").alias("input_rate"), F.col("output_rate").cast("decimal(12,6)").alias("output_rate"))
    out = U.usage_totals(usage, rates, ["role"], grand_total=True)
    return out.withColumn("cost", rounded(F.col("cost")))


_NODES = """n AS (SELECT 'u' || user_id AS run_id, event_id AS sequence, event_type AS node, CASE WHEN value > 80 THEN 'failed' WHEN value < 2 THEN 'skipped' ELSE 'done' END AS status, CAST(round(value * 1000000) AS BIGINT) AS us FROM events)"""


def _nodes(spark, d):
    value = F.col("value")
    micros = F.round(value * 1000000).cast("long")
    return table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("event_id").alias("sequence"),
        F.col("event_type").alias("node"),
        F.when(value > 80, "failed").when(value < 2, "skipped").otherwise("done").alias("status"),
        F.col("ts").cast("timestamp").alias("started_at"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + micros).alias("finished_at"),
    )


@query(
    "l7_run_rollup",
    f"WITH {_NODES} SELECT run_id, {r('sum(us) / 1000000', 4)} AS seconds, list_sort(coalesce(list(DISTINCT node) FILTER (status = 'skipped'), [])) AS skipped, arg_min(node, sequence) FILTER (status = 'failed') AS failed_node FROM n GROUP BY run_id",
)
def _(spark, d):
    return U.run_rollup(_nodes(spark, d)).withColumn("seconds", rounded(F.col("seconds"), 4))


@query("l7_node_durations", f"WITH {_NODES} SELECT run_id, node, {r('sum(us) / 1000000', 4)} AS seconds, count(*) AS times FROM n GROUP BY ALL")
def _(spark, d):
    return numbers(U.node_durations(_nodes(spark, d)), 4)


@query(
    "l8_sweep_summary",
    f"""WITH {_RUNS}, best AS (SELECT run_id, arg_min(model, rank) AS best_model, arg_min(score, rank) AS best_score FROM board WHERE error = '' GROUP BY run_id)
    SELECT 'run' || n_nationkey AS run_id, n_name AS dataset, best_model, CASE WHEN best_score IS NOT NULL THEN {r('best_score')} END AS best_score, 'kmeans k=' || cl.k AS clustering, CASE WHEN ev.run_id IS NOT NULL THEN 3 END AS columns_dropped
    FROM nation LEFT JOIN best ON best.run_id = 'run' || n_nationkey LEFT JOIN cl ON cl.run_id = 'run' || n_nationkey LEFT JOIN ev ON ev.run_id = 'run' || n_nationkey""",
)
def _(spark, d):
    runs = table(spark, d, "nation").select(F.concat(F.lit("run"), F.col("n_nationkey").cast("string")).alias("run_id"), F.col("n_name").alias("dataset"))
    tables = run_tables(spark, d)
    out = U.sweep_summary(runs, {k: tables[k] for k in ("leaderboard", "clustering", "cleaning")})
    return numbers(out, 6)


