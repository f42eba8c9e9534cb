"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of tables and ``BENCH_CPUS`` the number of cores.
Further arguments name other registered queries to time instead.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from checks.queries import QUERIES
from pagemill.session import build_session

HEADLINE = [
    "page_text", "page_main_text", "page_links_valid", "link_edges", "pagerank_parts", "bfs_frontier",
    "composite_score", "readability", "language_id", "page_upsert", "index_documents", "term_postings",
    "search_postings", "search_typo", "search_ranked", "search_snippets", "robots_filter", "fetch_schedule",
    "domain_stats", "stream_window_counts", "stream_ingest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/pages.parquet").count()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
