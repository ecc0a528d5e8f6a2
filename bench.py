"""Time the headline queries on one machine and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the threads. Every query is
planned and run in full, with all its columns, into a sink that discards the rows.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from editlore.queries import registered

HEADLINE = [
    "change_log", "small_table", "entity_prop_overall_activity", "entity_prop_distinct_val_change",
    "entity_prop_avg_activity_of_values", "entity_property_stats", "property_features", "updates_as_creates", "routed_features",
    "rank_intervals", "qualifier_intervals", "reference_intervals", "annotated_changes", "violates_range", "comment_keywords",
    "user_model", "full_user_model", "running_history", "reference_counts_asof", "feature_table", "predictor_features",
    "target_distribution", "update_frequency_by_type", "sampled_references", "knn4", "property_metadata", "id_properties",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("small_table")  # start the executor threads before the clock
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
