"""Event windows onto rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanewatch.functions.clock import to_utc
from vanewatch.operators.joins import (
    BROADCAST_BYTES,
    DAY,
    attach,
    first_started_segments,
    fits_in_buckets,
    interval_lookup,
)


def parsed_events(event_info: DataFrame, source_tz: str = "UTC") -> DataFrame:
    return event_info.withColumn("event_start", to_utc("event_start", source_tz)).withColumn(
        "event_end", to_utc("event_end", source_tz)
    )


def tag_events(
    rows: DataFrame,
    events: DataFrame,
    by: Sequence[str] = ("farm", "asset_id"),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left-tag rows with the labelled window they fall in, both window ends included.

    A row inside several windows gets the one that started first, then the lowest id. Event
    tables without an asset column are matched by farm, or by farm and file number.
    """
    keys = list(by)
    windows = events.select(
        *keys, "event_id", "event_label", "event_description", "event_start", "event_end"
    )
    small = fits_in_buckets(windows, DAY, broadcast_bytes, "event_start", "event_end")
    segments = first_started_segments(windows, keys, "event_id", "event_start", "event_end").drop(
        "event_start", "event_end"
    )
    return interval_lookup(rows, segments, keys, "time_stamp", small)


def event_file_rows(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of each event's own file, with signed days from the event start."""
    return attach(rows, events, ["farm", "file_event_id"], ["id"], "inner").withColumn(
        "rel_days",
        (F.unix_micros("time_stamp") - F.unix_micros("event_start")) / F.lit(86400.0 * 1e6),
    )
