"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: data folder (default /root/testdata/sf0.1). BENCH_CPUS: threads (default 8).
Each query runs to a sink that discards rows: once to warm up, then twice; the better of
the two counts.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from rowtide.plans.queries import QUERIES
from rowtide.plans.scenario import customer_changes, order_changes

HEADLINE = [
    "latest_change_per_key",
    "apply_latest_orders",
    "apply_latest_orders_one_pass",
    "apply_latest_customers",
    "apply_delete_wins_orders",
    "history_orders",
    "history_orders_one_pass",
    "history_customers",
    "history_phases",
    "history_hot_keys",
    "change_stats_orders",
    "partition_estimates",
    "read_json_batch",
    "load_changes_from_files",
    "export_snapshot_orders",
    "compact_table_lineitem",
    "stream_latest",
]


def seconds(run) -> float:
    started = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rowtide-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rowtide-bench-"))  # one machine here
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run = lambda: QUERIES[name].run(spark, sf_dir)
        seconds(run)
        times[name] = round(min(seconds(run), seconds(run)), 3)
    rows = {"orders": order_changes(spark, sf_dir).count(), "customers": customer_changes(spark, sf_dir, 0.0).count()}
    print(
        json.dumps(
            {
                "metric": "sum of headline query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "feed_rows": rows,
                "feed_rows_per_sec": {
                    "apply_latest_orders": round(rows["orders"] / times["apply_latest_orders"]),
                    "apply_delete_wins_orders": round(rows["orders"] / times["apply_delete_wins_orders"]),
                    "history_orders": round(rows["orders"] / times["history_orders"]),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
