"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of cores.
Each query runs once to warm up; the median of up to three further runs counts. No
further run starts once a query has taken two seconds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from linkpulse.plans.queries import all_queries  # noqa: E402
from linkpulse.session import configure  # noqa: E402

HEADLINE = (
    "router_states", "latest_n", "recent_window", "router_history", "history_per_router",
    "summary", "metric_stats", "status_distribution", "fault_distribution", "stats_document",
    "router_stats_rollup", "registry_view", "ingest_valid",
    "dedup_first_arrival", "insert_or_ignore", "fault_asof", "fault_overlay", "fault_episodes",
    "classify_fault", "alerts", "kpis", "risk", "link_status", "perf_series_hourly",
    "perf_series_sliding", "stored_latest_n", "stored_recent_window", "stored_router_history", "stored_stats_week",
)
RUNS = 3
ENOUGH_SECONDS = 2.0


def run(df: DataFrame) -> float:
    """Seconds to compute all rows of a result."""
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("linkpulse-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    for name in HEADLINE:
        run(queries[name](spark, sf_dir))
        runs = [run(queries[name](spark, sf_dir))]
        while len(runs) < RUNS and sum(runs) < ENOUGH_SECONDS:
            runs.append(run(queries[name](spark, sf_dir)))
        seconds[name] = round(statistics.median(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
