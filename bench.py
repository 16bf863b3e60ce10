"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every time is the median of warm runs, planning and sizing passes included.  Queries that
start from stored tables (features, predictions) do not pay for building them: building is
measured by ``features_clean`` and ``baseline_predictions``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from headroom.plans import catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "usage_scan_7d",
    "events_for_seen_collections",
    "lag_features",
    "rolling_features",
    "events_context",
    "context_join",
    "features_clean",
    "time_split",
    "expanding_folds",
    "baseline_predictions",
    "regression_metrics",
    "sla_policy_grid",
    "reactive_global",
    "reactive_per_series",
    "policy_with_baseline",
    "accuracy_vs_violation",
    "scatter_sample",
    "series_trace",
]
#: Run once; forests that an earlier query has grown are found again, so the first one pays.
ONCE = ["regression_tree", "forest_given"]
#: No new query begins after so many seconds.
LIMIT = float(os.environ.get("BENCH_LIMIT", "240"))


def session(shared: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("headroom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        # call-site capture for error messages costs a round trip per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(spark: SparkSession, name: str) -> float:
    """Build and fully evaluate a query without moving its rows to the driver."""
    began = time.perf_counter()
    catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    shared = tempfile.TemporaryDirectory(prefix="headroom-bench-")
    spark = session(shared.name)
    began = time.perf_counter()
    catalog.stored_predictions(spark, SF_DIR)
    preparing = time.perf_counter() - began
    times: dict[str, float] = {}
    skipped = []
    for name in HEADLINE + ONCE:
        if time.perf_counter() - began > LIMIT:
            skipped.append(name)
            continue
        runs = [seconds(spark, name) for _ in range(WARM_RUNS + 1 if name in HEADLINE else 1)]
        times[name] = round(statistics.median(runs[1:] or runs), 3)
        # as it comes: a run that is ended has shown its figures
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "sum of median warm query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
                "cold_store_sec": round(preparing, 3),
                "skipped": skipped,
            }
        )
    )
    spark.stop()
    shared.cleanup()


if __name__ == "__main__":
    main()
