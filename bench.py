"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query runs in full into a no-op sink."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

#: Bulk reads: points, timelines, intervals, adjacency, snapshots, ordered scans, statistics, vectors.
HEADLINE = [
    "node_at_tx",
    "nodes_as_of",
    "effective_timeline",
    "count_timeline",
    "nodes_during_tx",
    "nodes_relating_inside",
    "by_property_values",
    "range_topk_desc",
    "degree_stats",
    "two_hop",
    "snapshot_counts",
    "tuple_timelines",
    "property_value_stats",
    "property_ndv",
    "knn_l2",
    "verify_chain",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from strataspan.queries import QUERIES

    names = sys.argv[1:] or HEADLINE
    QUERIES[names[0]](spark, sf_dir).count()  # starts the JVM's compiler; not counted
    took = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir}))


if __name__ == "__main__":
    main()
