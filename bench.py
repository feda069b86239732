"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from lodestone import queries

KEYS = ["active_listing", "filter_conjunction", "search_substring", "facet_fit_counts", "refresh_status", "recheck_queue", "upsert_merge", "pagination_take_while", "coverage_summary", "dedup_cluster_sources", "application_state_fold", "alias_overlap_join", "score_case", "html_main_text"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for key in KEYS:
        began = time.time()
        queries.QUERIES[key](spark, sf).write.format("noop").mode("overwrite").save()
        took[key] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total query time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf).removeprefix("sf")}))


if __name__ == "__main__":
    main()
