"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and print one JSON line.

Each query is planned and fully executed (all columns, no rows collected) after one short warm-up of the session.
"""

from __future__ import annotations

import json
import os
import re
import time

from tabsight import get_session
from tabsight.plans import catalog

HEADLINE = [
    "a1_csv_scan",
    "b1_column_profile",
    "b2_semantic_type",
    "c6_drop_duplicate_rows",
    "c13_cleaning_report",
    "d1_numeric_summary",
    "d3_category_summary",
    "d4_describe_columns",
    "d6_correlation_matrix",
    "d8_histogram",
    "e4_kmeans",
    "e5_kprototypes",
    "e7_silhouette",
    "f15_frequency_encode",
    "f17_tfidf_weights",
    "f22_recipe",
    "g2_stratified_sample",
    "g5_time_series_split",
    "g7_smote",
    "g8_ordinal",
    "h3_linear_regression",
    "h7_cross_validate",
    "i4_macro_f1",
    "i5_roc_auc",
    "i10_median_ae",
    "j2_tree_shap",
    "j5_global_importance",
    "k3_predict",
    "l1_build_passages",
    "l4_search_batch",
    "m27_agg",
    "m30_describe",
    "m35_rank",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = get_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{folder}/region.parquet").count()
    only = os.environ.get("BENCH_QUERIES")
    timings = {}
    for name in only.split(",") if only else HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale.group(1)) if scale else None,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
