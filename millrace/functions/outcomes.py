"""Outcome classes as column expressions: responses, loads, retries, limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schemas import (
    BACKOFF_BASE_SECONDS,
    BACKOFF_CAP_SECONDS,
    BACKOFF_JITTER,
    MAX_ATTEMPTS,
)


def clamp(requested: Column, ceiling: int) -> Column:
    """A requested limit may lower the ceiling, never raise it."""
    return F.least(F.coalesce(requested, F.lit(ceiling)), F.lit(ceiling))


def over_size(size: Column, requested: Column, ceiling: int) -> Column:
    return size > clamp(requested, ceiling)


def response_category(status: Column) -> Column:
    """Error class of a response; NULL status is a timeout or transport error."""
    return F.when(status.isNull(), "FetchFailed").when(
        status.between(300, 399), "OutboundRequestBlockedError"
    ).when(status >= 400, "FetchFailed")


def response_retryable(status: Column) -> Column:
    """Whether a failed response may be tried again; NULL for a good one."""
    return (
        F.when(status.isNull(), True)
        .when((status == 429) | status.between(500, 599), True)
        .when(status >= 300, False)
    )


def load_category(failure: Column) -> Column:
    return F.when(failure.isNotNull(), "LoadFailed")


def load_retryable(failure: Column) -> Column:
    """Lost connections, lock waits and deadlocks are worth a retry; the rest is not."""
    return F.when(failure.isNotNull(), failure == "operational")


def is_final(attempt: Column, retryable: Column) -> Column:
    """Whether a failed attempt settles the run."""
    return (attempt >= MAX_ATTEMPTS) | ~retryable


def backoff_seconds(retry_number: Column) -> Column:
    """Wait before jitter: doubling from the base up to the cap."""
    return F.least(
        F.lit(BACKOFF_BASE_SECONDS) * F.pow(F.lit(2.0), retry_number),
        F.lit(float(BACKOFF_CAP_SECONDS)),
    )


def jittered_backoff_seconds(retry_number: Column, *identity: Column) -> Column:
    """Wait with up to a quarter extra, spread by a hash of ``identity``.

    A hash instead of a random draw gives a recomputed task the same answer.
    """
    unit = F.pmod(F.xxhash64(*identity, retry_number), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return backoff_seconds(retry_number) * (1 + unit * BACKOFF_JITTER)
