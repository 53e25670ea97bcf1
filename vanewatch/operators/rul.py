"""Remaining-useful-life labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanewatch.domain import RUL_HORIZON_HOURS
from vanewatch.functions.clock import hours_between
from vanewatch.operators.joins import (
    BROADCAST_BYTES,
    DAY,
    fits_in_buckets,
    interval_lookup,
    next_start_segments,
)


def next_failure(
    rows: DataFrame,
    faults: DataFrame,
    horizon_hours: int = RUL_HORIZON_HOURS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The nearest later fault of the same asset within the horizon, and the hours to it.

    Rows at or after an event's start are not before it. Each instant has one nearest event,
    so events become disjoint segments and a row meets exactly one instead of every later one.
    """
    events = faults.where(F.col("asset_id").isNotNull()).select(
        "farm", "asset_id", F.col("event_id").alias("next_event_id"),
        F.col("event_start").alias("next_start"),
    )
    horizon = horizon_hours * 3600
    reach = events.withColumn("_lo", F.timestamp_seconds(F.unix_seconds("next_start") - horizon))
    small = fits_in_buckets(reach, DAY, broadcast_bytes, "_lo", "next_start")
    segments = next_start_segments(
        events, ["farm", "asset_id"], "next_event_id", "next_start", horizon
    )
    return (
        interval_lookup(rows, segments, ["farm", "asset_id"], "time_stamp", small, "inner")
        .withColumn("hours_to_failure", hours_between("time_stamp", "next_start"))
        .drop("next_start")
    )


def rul_labels(
    tagged: DataFrame,
    faults: DataFrame,
    horizon_hours: int = RUL_HORIZON_HOURS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Labels for the rows outside any event window."""
    quiet = tagged.where(F.col("event_id").isNull()).select("farm", "asset_id", "time_stamp")
    return next_failure(quiet, faults, horizon_hours, broadcast_bytes).withColumnRenamed(
        "next_event_id", "event_id"
    )


def labelled_for_rul(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of labelled rows.

    The event id is left out of the key: rows before an event carry none, their label does.
    """
    target = labels.select("farm", "asset_id", "time_stamp", "hours_to_failure")
    return features.join(target, ["farm", "asset_id", "time_stamp"])



def labelled_features(
    features: DataFrame,
    faults: DataFrame,
    horizon_hours: int = RUL_HORIZON_HOURS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Feature rows outside any event window with the hours to the next failure.

    The label depends on a row's asset and time only, so it is looked up where the features
    are: while the faults are small nothing is shuffled, and labels need not be kept.
    """
    quiet = features.where(F.col("event_id").isNull())
    return next_failure(quiet, faults, horizon_hours, broadcast_bytes).drop("next_event_id")
