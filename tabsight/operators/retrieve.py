"""Passages of all runs and exact cosine search over their vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabsight.session import is_small
from tabsight.sources.tables import write_report

# Limits.
TOP_K = 6
MAX_DISTANCE = 0.85
TOP_FEATURES = 12
TOP_CORRELATIONS = 6
_BLOCK = 4096


# ---- passages ------------------------------------------------------------------------------------


def _share(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def build_passages(tables: dict[str, DataFrame]) -> DataFrame:
    """(run_id, ordinal, source, heading, content): one passage per feature, group and finding.

    Tables, each keyed by ``run_id``: evaluation(target, model, metric, mean, std, n_rows), importance(source, share,
    position), clusters(cluster, size, share), findings(severity, area, rule, detail), correlations(left, right, correlation, position),
    cleaning(rows_before, rows_after). Blank passages are dropped before numbering.
    """
    parts = []

    def add(df: DataFrame, section: int, within: Column, source: str, heading: Column, content: Column) -> None:
        parts.append(
            df.select("run_id", F.lit(section).alias("_s"), within.cast("string").alias("_w"), F.lit(source).alias("source"), heading.alias("heading"), F.trim(content).alias("content"))
        )

    zero = F.lit("0")
    if "evaluation" in tables:
        e = tables["evaluation"]
        add(
            e, 1, zero, "evaluation",
            F.format_string("Chosen model for %s", "target"),
            F.format_string("%s predicts %s from %d rows; %s is %.4f, spread %.4f.", "model", "target", "n_rows", "metric", "mean", "std"),
        )
    if "importance" in tables:
        i = tables["importance"].where(F.col("position") <= TOP_FEATURES)
        ranked = i.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("position", "source", "share"))).alias("_l"))  # at most twelve
        named_ = F.array_join(F.transform("_l", lambda s: F.concat(s["source"], F.lit(" "), _share(s["share"]))), ", ")
        add(ranked, 2, zero, "explanation", F.lit("Most influential columns"), F.concat(F.lit("By influence: "), named_))
        add(
            i, 3, F.lpad(F.col("position").cast("string"), 4, "0"), "explanation",
            F.format_string("Influence of %s", "source"),
            F.format_string("%s is number %d and carries %s of the total influence.", F.col("source"), F.col("position"), _share(F.col("share"))),
        )
    if "clusters" in tables:
        add(
            tables["clusters"], 4, F.lpad(F.col("cluster").cast("string"), 6, "0"), "clustering",
            F.format_string("Group %d", "cluster"),
            F.format_string("Group %d has %d rows, %s of all.", F.col("cluster"), F.col("size"), _share(F.col("share"))),
        )
    if "findings" in tables:
        add(
            tables["findings"], 5, F.concat_ws("/", "severity", "area", "rule"), "review",
            F.format_string("%s about %s", "severity", "area"),
            F.format_string("%s (%.4f)", "rule", "detail"),
        )
    if "correlations" in tables:
        c = tables["correlations"].where(F.col("position") <= TOP_CORRELATIONS)
        pairs = c.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("position", "left", "right", "correlation"))).alias("_l"))  # at most six
        text = F.array_join(F.transform("_l", lambda s: F.format_string("%s and %s %.2f", s["left"], s["right"], s["correlation"])), "; ")
        add(pairs, 6, zero, "eda", F.lit("Columns that move together"), text)
    if "cleaning" in tables:
        k = tables["cleaning"]
        add(
            k, 7, zero, "cleaning", F.lit("What cleaning removed"),
            F.format_string("%d of %d rows were removed.", F.col("rows_before") - F.col("rows_after"), F.col("rows_before")),
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where(F.col("content").isNotNull() & (F.col("content") != ""))
    order = Window.partitionBy("run_id").orderBy("_s", "_w")  # a run has a few dozen passages
    return out.withColumn("ordinal", F.row_number().over(order).cast("long") - 1).drop("_s", "_w")


def index_run(passages: DataFrame, folder: str, run_id: str) -> str:
    """Store a run's passages, replacing whatever that run had before and touching no other run."""
    own = passages.where(F.col("run_id") == run_id).drop("run_id")
    return write_report(own, folder, "passages", run_id)


def indexed_count(index: DataFrame) -> DataFrame:
    return index.groupBy("run_id").agg(F.count(F.lit(1)).alias("passages"))


# ---- search --------------------------------------------------------------------------------------


def cosine_distance(vector: Column, query: Sequence[float]) -> Column:
    """1 - cosine against a literal vector, inside generated code."""
    q = np.asarray(query, dtype=float)
    unit = q / np.linalg.norm(q)
    literal = F.array(*[F.lit(float(v)) for v in unit])
    dot = F.aggregate(F.zip_with(vector, literal, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, v: a + v)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return 1 - F.try_divide(dot, norm)


def search(vectors: DataFrame, query: Sequence[float], key: str, vector: str, k: int = TOP_K, max_distance: float = MAX_DISTANCE, scope: Column | None = None) -> DataFrame:
    """The k nearest rows of one scope: a top-k, so each task sends on at most k rows. The cut applies after the top-k."""
    if scope is not None:
        vectors = vectors.where(scope)
    near = vectors.withColumn("distance", cosine_distance(F.col(vector), query)).orderBy("distance", key).limit(k)
    return near.where(F.col("distance") <= max_distance)


def search_batch(
    vectors: DataFrame,
    queries: DataFrame,
    key: str = "key",
    vector: str = "x",
    query_key: str = "query",
    query_vector: str = "q",
    k: int = TOP_K,
    max_distance: float = MAX_DISTANCE,
    small: bool | None = None,
) -> DataFrame:
    """(query, key, distance, position): the k nearest rows of every query.

    A query set under the checked size is broadcast and every task keeps its own k best per query. Beyond it,
    queries and vectors are cut into blocks and each pair of blocks emits k rows per query, never all pairs.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
    q = queries.select(F.col(query_key).alias("query"), F.transform(query_vector, lambda x: x.cast("double")).alias("q"))
    out = f"query {q.schema['query'].dataType.simpleString()}, key {v.schema['key'].dataType.simpleString()}, distance double"

    if is_small(q) if small is None else small:
        rows = q.collect()
        names = pd.Series([r["query"] for r in rows]).to_numpy()
        shared = spark.sparkContext.broadcast((names, _unit(np.array([r["q"] for r in rows], dtype=float))))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, unit = shared.value
            kept = None
            for b in batches:
                if not len(b):
                    continue
                part = _nearest(names, unit, b["key"].to_numpy(), _unit(np.vstack(b["x"].to_numpy())), k)
                kept = part if kept is None else pd.concat([kept, part])
                kept = kept.sort_values(["query", "distance", "key"]).groupby("query").head(k)
            if kept is not None:
                yield kept

        found = v.mapInPandas(scan, out)
    else:
        nq, nv = (max(1, -(-n // _BLOCK)) for n in (q.count(), v.count()))
        qs = q.withColumn("a", F.pmod(F.xxhash64("query"), F.lit(nq))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nv - 1).cast("long"))))
        vs = v.withColumn("b", F.pmod(F.xxhash64("key"), F.lit(nv))).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))))

        def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query": [], "key": [], "distance": []})
            return _nearest(left["query"].to_numpy(), _unit(np.vstack(left["q"].to_numpy())), right["key"].to_numpy(), _unit(np.vstack(right["x"].to_numpy())), k)

        found = qs.groupBy("a", "b").cogroup(vs.groupBy("a", "b")).applyInPandas(pair, out)
    order = Window.partitionBy("query").orderBy("distance", "key")
    best = found.withColumn("position", F.row_number().over(order).cast("long"))
    return best.where((F.col("position") <= k) & (F.col("distance") <= max_distance))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _nearest(names: np.ndarray, queries: np.ndarray, keys: np.ndarray, unit: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of one block per query, ties by key: only distances up to the k-th smallest are sorted."""
    parts = []
    for start in range(0, len(queries), 256):
        d = 1 - queries[start : start + 256] @ unit.T
        last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        who, at = np.nonzero(d <= last[:, None])
        rank = np.unique(keys[at], return_inverse=True)[1]
        order = np.lexsort((rank, d[who, at], who))
        who, at = who[order], at[order]
        best = np.arange(len(who)) - np.searchsorted(who, who) < k
        who, at = who[best], at[best]
        parts.append((names[start + who], keys[at], d[who, at]))
    return pd.DataFrame({n: np.concatenate([p[j] for p in parts]) for j, n in enumerate(("query", "key", "distance"))})
