"""Headline queries, timed.  Prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_RUNS (timed runs).
Each query gets one warm-up; the figure is the median of the timed runs.  The time covers
building the DataFrame, which may run measuring jobs, and writing it to a null sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from jobweave import catalog
from jobweave.session import build_session

HEADLINE = [
    "newest_per_key", "dup_count_attached", "tag_reposts", "dimension_counts", "dimension_counts_grouped", "salary_by_category_grouped",
    "page_by_salary_grouped", "skill_counts", "category_match_scores", "matched_postings", "terms_in_documents", "detected_skills",
    "search_keyword", "search_vectors", "search_hybrid", "parsed_feed", "parsed_pages", "insert_new_postings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, _ = catalog.load()
    names = sys.argv[1:] or HEADLINE
    took: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
