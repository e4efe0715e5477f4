"""Time the headline queries and print one JSON line.

Every query is planned and executed in full into Spark's no-op sink: once to warm up, then three times, of which
the median counts.
BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated names, or `all`) select what runs.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

import catalogue

REPEATS = 3
HEADLINE = (
    "filter_gt filter_contains date_range_dnf rename_chain append_bundles replace_targets broadcast_scalar "
    "join_inner join_full join_hot_key join_dup_names join_transformed pivot_sum pivot_count pivot_multi pivot_dates "
    "cast_number cast_date castability nullified_keys key_check ingest_append_conflict ingest_upsert ingest_skip "
    "ingest_duplicates key_profile table_summaries row_function series_function sql_template validate_bundles "
    "failing_rows cross_table_validation flagship run_all results_report"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablewright-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    names = list(queries) if chosen == "all" else chosen.split(",") if chosen else HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(median(run(name) for _ in range(REPEATS)), 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
