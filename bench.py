"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the input folder and ``BENCH_CPUS`` the number of local cores.
One query runs on the smallest inputs to warm up; then every query runs once, whole,
on the named inputs; its rows are produced in full but not kept.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "review_top_findings",
    "review_with_feedback",
    "rule_hardcoded_secret",
    "rule_circular_dependency",
    "rule_missing_tests",
    "related_prs_by_files",
    "similar_prs_vector",
    "bug_patterns_closed_prs",
    "hot_files",
    "feedback_stats",
    "feedback_patterns",
    "feedback_sessions_36h",
    "commit_rollup",
    "event_routing",
    "category_distribution",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    if not os.path.isdir(warm):
        warm = SF_DIR
    QUERIES["review_top_findings"](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
