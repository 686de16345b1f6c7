"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores,
``BENCH_QUERIES`` (comma-separated) a choice of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weekloom.checks.queries import all_queries  # noqa: E402
from weekloom.session import local_session  # noqa: E402

HEADLINE = [
    "topic_trend",
    "week_table",
    "week_metrics",
    "storyline_cards",
    "keyword_string",
    "keyword_chips",
    "entity_match",
    "entity_counts",
    "entity_assign",
    "training_extract",
    "topic_backlog",
    "cluster_backlog_weeks",
    "label_merge",
    "upsert_articles",
    "page_text",
    "feed_filter",
    "audit_constraints",
    "keyword_ctfidf",
    "people_keywords",
    "keyword_dedup",
    "kmeans_sweep",
    "weekly_clusters",
    "topic_model_eval",
    "stratified_split",
    "stream_week_counts",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus, "weekloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    queries["week_bucket"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    for name in chosen.split(",") if chosen else HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
