"""Time the headline queries: python bench.py prints one line of JSON.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from helixframe.plans import registry

HEADLINE = [
    "j01_overlap_join", "j02_excluded_bins", "j03_sites_in_intervals", "a13_gc_median", "f08_outlier_bins", "w01_running_median",
    "w08_breakpoint_union", "w06_segment_ids", "a24_segment_summary", "w09_equal_calls", "e01_confusion_cube", "m14_hmm_segments",
    "m07_cbs_segments", "j22_nearest_states", "p10_trio_calls", "c22_canonical_kmers",
]


def main() -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    os.environ["PYTHONPATH"] = root + os.pathsep + os.environ.get("PYTHONPATH", "")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["s01_bins"](spark, sf_dir).count()  # starts the session
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
