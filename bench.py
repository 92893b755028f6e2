"""Times the headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line.

Every query runs in full into a discarding sink. One query warms the session up; each query is then timed
``$BENCH_RUNS`` times (default 1) and the best run counts.

A large table comes in many files. The test tables are one file with one row group each, which a scan cannot split; so
that the plans timed here are those of a large table, they are first copied, untimed, to as many files as there are cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import all_queries  # noqa: E402

HEADLINE = [
    "a7_search_by_community", "a8_search_by_keywords", "b1_clean_text", "b3_raw_to_post", "b7_english_test",
    "b9_complaint_phrases", "c4_include_any", "t1_tokens", "t7_english_keywords", "t9_search_strategies",
    "l1_heuristic_plans", "l7_vet_communities", "e4_terms_of_many_lists", "g1_first_per_id", "g2_painful_posts",
    "g3_newest_per_community", "select_posts", "f2_discover", "f3_group_sizes", "f6_gap_examples",
    "f8_coverage_status", "k1_lexicon_sentiment", "k2_rule_sentiment", "j2_vocabulary", "j3_tfidf", "j7_top_terms",
    "j5_silhouette", "j4_kmeans_clusters", "c9_evidence_match", "e9_evidence_rows", "f9_cluster_report",
]


TABLES = ["documents", "conversations", "benchmark", "embeddings", "labels"]


def in_many_files(spark: SparkSession, folder: str, files: int) -> str:
    """A copy of the tables with the same rows, each table in ``files`` files."""
    copy = tempfile.mkdtemp(prefix="postlens-bench-")
    for name in TABLES:
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(files).write.parquet(f"{copy}/{name}.parquet")
    return copy


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("postlens-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries.queries()

    def once(name: str) -> float:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    scale = re.search(r"sf([0-9.]+)", folder)
    folder = in_many_files(spark, folder, int(cpus))
    once("g2_painful_posts")
    seconds = {name: round(min(once(name) for _ in range(runs)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
