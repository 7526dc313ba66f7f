"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (local cores),
``BENCH_QUERIES`` (comma-separated names, or ``all``), ``BENCH_REPEAT``
(timed runs after one warm-up run, default 2; the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from millrace.plans.catalog import QUERIES

HEADLINES = [
    "paged_scan", "page_limit_guard", "first_error_cutoff", "resume_scan", "response_outcome",
    "extract_records", "malformed_pages", "source_config_audit", "path_lookup", "map_permissive",
    "map_strict", "payload_checksum", "put_if_absent", "raw_record_upsert", "verified_read",
    "migration_summary", "apply_migration", "migration_progress", "append_load",
    "duplicate_exposure", "dedupe_keep_first", "load_request_audit", "run_execution",
    "run_loaded_rows", "run_counters", "run_progress", "claim_outcomes", "attempt_history",
    "trigger_dedupe", "continuation_lineage", "recent_runs", "run_detail", "job_action_rules",
    "can_continue", "redact_text", "host_verdict", "stream_run_counters", "stream_dedupe",
    "stream_load",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("millrace-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    """Building and running the query, every result row computed and dropped."""
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    named = os.environ.get("BENCH_QUERIES", "")
    chosen = list(QUERIES) if named == "all" else [n for n in named.split(",") if n] or HEADLINES
    spark = session(cpus)
    times = {}
    for name in chosen:
        seconds(spark, name, sf_dir)
        times[name] = round(
            statistics.median(seconds(spark, name, sf_dir) for _ in range(repeat)), 3
        )
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
