"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list or ``all``).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from workbook import QUERIES

HEADLINE = [
    "q_commission_metrics",
    "q_removal_funnel",
    "q_funnel_by_year",
    "q_quantiles",
    "q_winsorized_ratios",
    "q_retention",
    "q_coverage",
    "q_trip_labels",
    "q_join_od",
    "q_join_calendar",
    "q_join_weather",
    "q_station_to_day",
    "q_hourly_ci",
    "q_band_profile",
    "q_uplift_by_band",
    "q_circular_mean",
    "q_flag_profiles",
    "q_correlation_pairs",
    "q_ecdf",
    "q_points_in_polygons",
    "q_write_read_partitioned",
    "q_month_mart",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed pass over a scan and an aggregate starts the JVM's code paths.
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().write.format("noop").mode(
        "overwrite"
    ).save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
