"""Times the headline queries and prints one JSON line.

Each query runs over the whole tables of ``BENCH_SF_DIR`` and writes all of its
columns to a null sink, so nothing is pruned that a user would get.  One query
on the same tables warms the JVM up first and is not counted.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sigsift.plans.queries import QUERIES

HEADLINE = (
    "corpus_files", "file_inventory", "line_index", "rule_hits", "match_positions", "context_lines", "file_entropy", "group_entropy",
    "heuristic_scores", "all_findings", "scan_grades", "scan_totals", "top_findings", "rule_rollup", "duplicate_content", "distinct_scan",
    "finding_order", "review_prompts", "json_report", "markdown_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sigsift-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["severity_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
