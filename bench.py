"""Time the headline queries; prints one JSON line.

Each query runs once without being timed and then three times; the median counts. Gold
tables and fitted members that later queries read are built and timed apart, as
`build_members`.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ordina.catalog import QUERIES, model_queries  # noqa: E402

HEADLINE = (
    "build_features",
    "series_summary",
    "series_summary_bracketed",
    "row_features",
    "stratified_folds",
    "robust_stats",
    "robust_stats_bracketed",
    "robust_smooth_clip",
    "qwk_threshold",
    "qwk_round",
    "threshold_search",
    "ensemble_oof",
    "ensemble_predict",
    "blend_score",
    "pseudo_label",
    "permutation_importance",
    "leak_check",
    "cv_fit",
    "pseudo_rounds",
    "staged_metric_stated",
    "contributions_stated",
    "permutation_importance_stated",
)
# Each takes long enough to be timed once, after the others have warmed the session up.
LONG = ("prepare_training", "staged_metric", "contributions", "permutation_importance_trees")
REPEATS = 3


def timed(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        timed(spark, name, sf_dir)
        seconds[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(REPEATS)), 3)
    start = time.perf_counter()
    for member in ("boosted", "forest"):
        model_queries.fitted(spark, sf_dir, member)
    seconds["build_members"] = round(time.perf_counter() - start, 3)
    for name in LONG:
        seconds[name] = round(timed(spark, name, sf_dir), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, median of three after a warm-up, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
