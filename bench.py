"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "agg_by_type", "event_trend", "agg_by_participant_top5", "events_after_window", "lookahead_pairs", "ngram_sequences", "user_sessions",
    "asof_last_purchase", "hash_dedup", "upsert_replace", "set_jaccard_pairs", "chunk_windows", "tfidf_cohesion", "keyword_retrieval",
    "knn_cosine", "dbscan_cosine", "triangles_clustering", "page_rank", "hypergraph_bfs", "quality_rules", "relation_validation",
]


def main() -> None:
    from fabula.plans.catalog import QUERIES
    from fabula.session import build

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "12g"})
    QUERIES["status_histogram"](spark, sf_dir).collect()  # starts the session's threads and code generation
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - began)
        took[f"{name}"] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
