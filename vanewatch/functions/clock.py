"""Timestamps: parsing, UTC conversion and differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_utc(column: str, source_tz: str = "UTC") -> Column:
    """Parse local text (or take a timestamp) and move it from ``source_tz`` to UTC.

    Unreadable text becomes NULL instead of failing the job.
    """
    return F.to_utc_timestamp(F.col(column).try_cast("timestamp"), source_tz)


def epoch_seconds(column) -> Column:
    return F.unix_seconds(F.col(column) if isinstance(column, str) else column)


def hours_between(earlier, later) -> Column:
    return (epoch_seconds(later) - epoch_seconds(earlier)) / F.lit(3600.0)


def days_between(earlier, later) -> Column:
    """Signed days, to the microsecond."""
    a = F.col(earlier) if isinstance(earlier, str) else earlier
    b = F.col(later) if isinstance(later, str) else later
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(86400.0 * 1e6)


def iso_utc(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_of(column: str) -> Column:
    return F.date_trunc("day", F.col(column))


def time_bucket(column, seconds: int) -> Column:
    """Number of the fixed-length time bucket a timestamp falls in."""
    return F.floor(epoch_seconds(column) / F.lit(seconds)).cast("bigint")
