"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Every result is
computed in full and written to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugeworks.catalog import QUERIES
from gaugeworks.session import local_session

HEADLINE = (
    "window_sample_counts",
    "window_field_stats",
    "window_communication",
    "aligned_window_counts",
    "cross_device_stats",
    "feature_rows",
    "run_level_means",
    "sampling_gap_stats",
    "coverage_records",
    "calibration_decision",
    "stratified_split",
    "metrics_by_slice",
    "rank_metrics",
    "bootstrap_interval",
    "ingest_outcomes",
    "node_window_means",
    "efficiency_proxies",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, "gaugeworks-bench", **{"spark.sql.shuffle.partitions": cpus})
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
