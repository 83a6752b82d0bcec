"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from epistle import registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = ["list_threads_count", "timeline_month", "mention_timeline_month", "contact_profile", "tag_filter_or_group", "keyset_page_desc", "thread_expansion", "postings_stats", "bm25_and", "bm25_phrase",
           "bm25_minmax", "knn_cosine", "knn_scalar_equal", "knn_prefilter", "knn_similar_to", "hybrid_rrf", "content_hash_dups", "category_rules", "project_tags", "quality_checks"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.adaptive.enabled", "true").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    first, warm = {}, {}
    for name in QUERIES:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        first[name], warm[name] = round(runs[0], 3), round(min(runs[1:]), 3)
    print(json.dumps({"metric": "warm seconds over all queries", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "first": first, "sf": SF_DIR.rsplit("sf", 1)[-1], "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
