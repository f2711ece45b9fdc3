"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR   folder of parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default: all)
BENCH_QUERIES  comma-separated names, or "all" (default: the headline list)
"""

from __future__ import annotations

import json
import os
import re
import time

from themescope.catalog import QUERIES
from themescope.session import build_session

HEADLINE = [
    # raw rows to a working set
    "raw_csv_scan", "landed_months", "extraction_pool", "extraction_funnel", "clean_text",
    "usable_complaints", "category_shares", "category_profile", "balanced_sample", "working_set",
    # responses and topics
    "response_validation", "attempt_resolution", "key_phrases", "vocabulary", "topic_samples",
    "distinctive_labels", "token_batches",
    # reports
    "theme_frequency", "theme_by_product", "sentiment_shares", "monthly_trend", "length_percentiles",
    # evaluation and vectors
    "evaluation_summary", "junk_drawers", "source_match", "nearest_centres", "inertia_by_label",
    "point_silhouettes", "hashed_vectors", "kmeans_clusters",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["category_shares"](spark, folder).collect()  # start the JVM's compilers
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{folder}/documents.parquet").count()
    found = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(found.group(1)) if found else None, "cpus": int(cpus),
        "documents_per_second_cleaned": round(rows / times["clean_text"]) if times.get("clean_text") else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
