"""Time the headline queries and print one line of JSON.

BENCH_SF_DIR: the tables' folder (default /root/testdata/sf0.1). BENCH_CPUS: cores of the local session.
Each query runs once to warm up and once for the clock, its rows written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

#: One query at least of each family; all are of catalog.queries().
HEADLINE = (
    "q1_pricing_summary",
    "join_using_five_way",
    "join_semi_exists",
    "rollup",
    "window_running",
    "lateral_top_k",
    "facet_counts",
    "percentile_cont",
    "merge_three_way",
    "upsert",
    "time_bucket",
    "ts_rate",
    "asof_join_keyed",
    "gap_fill_locf",
    "knn_l2",
    "bm25_search",
    "phrase_search",
    "hybrid_rrf",
    "spatial_distance_join",
    "array_agg_by_dim",
    "graph_wcc",
    "graph_triangles",
    "streaming_mv",
)


def main() -> None:
    from polymera.plans import catalog

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
