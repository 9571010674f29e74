"""Column expressions over a fetch log; nothing here fetches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a fetch is judged.
RETRYABLE_STATUSES = (429, 503, 504)
MAX_RETRIES = 2
NOT_MODIFIED = 304
KILO, MEGA = 1024, 1024 * 1024


def format_size(size: Column) -> Column:
    """Bytes as ``B``, ``KB`` or ``MB``; one decimal, halves go to the even digit."""
    return (
        F.when(size < KILO, F.concat(size.cast("string"), F.lit("B")))
        .when(size < MEGA, F.format_string("%.1fKB", F.bround(size / KILO, 1)))
        .otherwise(F.format_string("%.1fMB", F.bround(size / MEGA, 1)))
    )


def fetch_outcome(status: Column, size: Column, attempt: Column) -> Column:
    """``success``, ``empty``, ``not modified``, ``retry`` or ``failed``."""
    return (
        F.when(status.isin(*RETRYABLE_STATUSES) & (attempt < MAX_RETRIES), "retry")
        .when(status == NOT_MODIFIED, "not modified")
        .when(~status.between(200, 299), "failed")
        .when(size == 0, "empty")
        .otherwise("success")
    )


def is_fetched(outcome: Column) -> Column:
    return outcome.isin("success", "not modified")


def backoff_seconds(kind: Column, attempt: Column) -> Column:
    """Wait before a retry: twice as long after a connection error as after a retryable status.

    Null when there is no retry left.
    """
    first = F.when(kind == "connection", 2).when(kind == "status", 1)
    power = F.pow(F.lit(2), attempt)
    return F.when(attempt < MAX_RETRIES, (first * power).cast("bigint"))
