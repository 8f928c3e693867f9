"""Findings a threshold can decide, over the report tables of all runs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Thresholds.
UNSTABLE_RATIO = 0.15
SMALL_RUN = 200
WEAK_SILHOUETTE = 0.5
ADDITIVITY = 1e-3
DOMINANT_SHARE = 0.6
SEVERITY = {"blocker": 0, "concern": 1, "note": 2}


def _rows(df: DataFrame, area: str, severity: str, rule: str, detail) -> DataFrame:
    return df.select("run_id", F.lit(area).alias("area"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), detail.cast("double").alias("detail"))


def measured_findings(tables: dict[str, DataFrame]) -> DataFrame:
    """(run_id, area, severity, rule, detail) from whichever report tables exist, all keyed by ``run_id``.

    leaderboard(model, score, std, error, rank, is_baseline), evaluation(metric, mean, std, n_rows, warnings, is_primary),
    clustering(k, silhouette), explanation(additivity_error, top_share), features(rejected, overridden).
    """
    parts = []
    if "leaderboard" in tables:
        board = tables["leaderboard"]
        failed = board.groupBy("run_id").agg(F.count_if(F.col("error") != "").alias("n")).where("n > 0")
        parts.append(_rows(failed, "modelling", "note", "failed models", F.col("n")))
        # the two best real models of each run: the baseline is not a rival
        real = board.where((F.col("error") == "") & ~F.col("is_baseline"))
        order = Window.partitionBy("run_id").orderBy("rank")
        two = real.withColumn("_p", F.row_number().over(order)).where("_p <= 2")
        lead = two.groupBy("run_id").agg(
            F.max(F.when(F.col("_p") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("_p") == 2, F.col("score"))).alias("b"), F.max("std").alias("spread")
        )
        close = lead.where((F.col("spread") > 0) & (F.col("a") - F.col("b") < F.col("spread")))
        parts.append(_rows(close, "modelling", "concern", "lead inside the fold spread", F.col("a") - F.col("b")))
    if "evaluation" in tables:
        e = tables["evaluation"].where("is_primary")
        unstable = e.withColumn("r", F.abs(F.try_divide(F.col("std"), F.nullif(F.col("mean"), F.lit(0.0))))).where(F.col("r") > UNSTABLE_RATIO)
        parts.append(_rows(unstable, "evaluation", "concern", "score varies across folds", F.col("r")))
        parts.append(_rows(e.where((F.col("n_rows") > 0) & (F.col("n_rows") < SMALL_RUN)), "evaluation", "concern", "few rows", F.col("n_rows")))
        parts.append(_rows(e.where(F.col("warnings") > 0), "evaluation", "note", "recorded caveats", F.col("warnings")))
    if "clustering" in tables:
        weak = tables["clustering"].where((F.col("k") > 0) & (F.col("silhouette") < WEAK_SILHOUETTE))
        parts.append(_rows(weak, "data_quality", "note", "weakly separated groups", F.col("silhouette")))
    if "explanation" in tables:
        x = tables["explanation"]
        parts.append(_rows(x.where(F.col("additivity_error") > ADDITIVITY), "explainability", "blocker", "contributions do not add up", F.col("additivity_error")))
        parts.append(_rows(x.where(F.col("top_share") > DOMINANT_SHARE), "explainability", "concern", "one column dominates", F.col("top_share")))
    if "features" in tables:
        f = tables["features"]
        parts.append(_rows(f.where("rejected > 0"), "features", "note", "unknown columns rejected", F.col("rejected")))
        parts.append(_rows(f.where("overridden > 0"), "features", "note", "choices overruled", F.col("overridden")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_severity(findings: DataFrame) -> DataFrame:
    rank = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    return findings.orderBy("run_id", rank[F.col("severity")], "area", "rule")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("run_id", "severity").agg(F.count(F.lit(1)).alias("n"))
