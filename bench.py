"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is written to the ``noop`` sink, so all of its rows are made and none are collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright.plans import QUERIES  # noqa: E402
from tablewright.session import local_session  # noqa: E402

HEADLINE = [
    "sql_monthly_revenue_by_region", "sql_join", "sql_window_rank", "sql_window_frame", "sql_cube",
    "profile_lineitem", "profile_rated_documents",
    "classify_statements", "questions_from_titles", "slugify_documents", "stable_ids", "format_scalars",
    "index_upsert", "index_stats", "topk_join", "topk_single",
    "keyword_match", "glossary_match", "unified_search", "embed_documents",
    "usage_filter", "lakeview_extract", "first_seen_dedupe", "superset_coalesce", "dashboard_load",
    "multi_series", "pie_share", "histogram", "heatmap2d", "box_stats",
    "slot_scalars", "snapshot_restore", "job_latest_state", "query_log_stats",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # One untimed query starts the executor threads and the Python workers.
    QUERIES["slugify_documents"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.monotonic()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    line = {"metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
