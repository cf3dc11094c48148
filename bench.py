"""Times the engine's queries at $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from weirflow.queries import QUERIES

HEADLINE = ("view_resolve", "view_at_commit", "list_files", "repo_size", "file_history", "split_upload", "glob_dirs", "join_datums", "group_multi_member", "union_merge", "chunk_by_number", "chunk_by_bytes", "datum_hash", "dedup_skip", "merge_outputs", "job_progress", "datum_page", "pair_heads", "provenance_closure", "size_trigger_fires")


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.time()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total of headline queries, median of 3", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d}))


if __name__ == "__main__":
    main()
