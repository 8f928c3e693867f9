"""Usage and run ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

MILLION = 1_000_000


def request_cost(input_tokens: Column, output_tokens: Column, input_rate: Column, output_rate: Column) -> Column:
    """Exact decimal cost of one request at six decimals, half to even."""
    total = input_tokens.cast("decimal(18,0)") * input_rate.cast("decimal(12,6)") + output_tokens.cast("decimal(18,0)") * output_rate.cast("decimal(12,6)")
    return F.bround(total / F.lit(MILLION).cast("decimal(10,0)"), 6).cast("decimal(18,6)")


def usage_totals(usage: DataFrame, rates: DataFrame, by: Sequence[str], grand_total: bool = False) -> DataFrame:
    """(by..., input_tokens, output_tokens, cost, requests). ``rates`` has one row per tier, so it is broadcast."""
    priced = usage.join(F.broadcast(rates), "tier", "left").withColumn(
        "_cost",
        F.coalesce(
            request_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_rate"), F.col("output_rate")), F.lit(0).cast("decimal(18,6)")
        ),
    )
    grouped = priced.rollup(*by) if grand_total else priced.groupBy(*by)
    return grouped.agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("_cost"), F.lit(0).cast("decimal(28,6)")).alias("cost"),
        F.count(F.lit(1)).alias("requests"),
    )


def run_rollup(nodes: DataFrame) -> DataFrame:
    """(run_id, seconds, skipped, failed_node) from (run_id, sequence, node, status, started_at, finished_at).

    The skipped list holds node names once each, so it is as long as the list of nodes, not of rows.
    """
    seconds = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    failed = F.min_by("node", F.when(F.col("status") == "failed", F.col("sequence")))
    return nodes.groupBy("run_id").agg(
        F.coalesce(F.sum(seconds), F.lit(0.0)).alias("seconds"),
        F.array_sort(F.collect_set(F.when(F.col("status") == "skipped", F.col("node")))).alias("skipped"),
        failed.alias("failed_node"),
    )


def node_durations(nodes: DataFrame) -> DataFrame:
    seconds = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return nodes.groupBy("run_id", "node").agg(F.sum(seconds).alias("seconds"), F.count(F.lit(1)).alias("times"))


def sweep_summary(runs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per run, left-joined to whichever report tables exist; a run that stopped early keeps its row."""
    out = runs
    if "leaderboard" in tables:
        best = (
            tables["leaderboard"]
            .where(F.col("error") == "")
            .groupBy("run_id")
            .agg(F.min_by("model", "rank").alias("best_model"), F.min_by("score", "rank").alias("best_score"))
        )
        out = out.join(best, "run_id", "left")
    if "clustering" in tables:
        c = tables["clustering"].select("run_id", F.format_string("%s k=%d", "method", "k").alias("clustering"))
        out = out.join(c, "run_id", "left")
    if "cleaning" in tables:
        c = tables["cleaning"].select("run_id", (F.col("columns_before") - F.col("columns_after")).alias("columns_dropped"))
        out = out.join(c, "run_id", "left")
    if "usage" in tables:
        out = out.join(tables["usage"].select("run_id", "requests", "cost"), "run_id", "left").na.fill({"requests": 0})
    return out
