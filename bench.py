"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) set data and cores. Every
query runs twice after a warm-up of the session; the faster run counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from logtide.operators.isolation_forest import iforest_fit
from logtide.plans.catalog import KEYS, QUERIES, vectors
from logtide.session import materialize

HEADLINE = (
    "parse_nginx_combined", "parse_stats", "window_features", "normalize_features",
    "alerts_every_window", "write_logs", "scan_logs", "dashboard_metrics", "iforest_fit",
    "score_batch", "ae_fit", "historical_failure_patterns", "failure_similarity", "knn_topk",
    "stream_change_rates",
)
RUNS = 2


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def best_of_runs(call) -> float:
    best = float("inf")
    for _ in range(RUNS):
        start = time.perf_counter()
        call()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("logtide-bench")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["window_features"](spark, sf_dir))
    times = {}
    for name in HEADLINE:
        times[name] = best_of_runs(lambda name=name: run(QUERIES[name](spark, sf_dir)))
    # The forest alone, as the published training time has it; not part of the sum.
    rows = materialize(vectors(spark, sf_dir), "bench-vectors")[0]
    fit = best_of_runs(lambda: iforest_fit(rows, KEYS, stored=True))
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "log_lines": lines, "iforest_fit_on_stored_features": fit,
        "parse_lines_per_sec": round(lines / times["parse_nginx_combined"]),
        "feature_lines_per_sec": round(lines / times["window_features"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
