"""All registered queries."""

from millrace.plans import (  # noqa: F401
    ingestion_queries,
    job_queries,
    migration_queries,
    raw_queries,
    record_queries,
    run_queries,
    scan_queries,
    store_queries,
    text_queries,
)
from millrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
