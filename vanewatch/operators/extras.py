"""Checks on readings that the documentation of the domain asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vanewatch.functions.clock import days_between, time_bucket
from vanewatch.operators.joins import DAY, attach
from vanewatch.operators.ranking import numbered


def in_sequence(readings: DataFrame) -> DataFrame:
    """Number each turbine's readings per sensor by time and attach the value they start from."""
    keys = ["turbine_id", "sensor"]
    ordered = numbered(readings, keys, time_bucket("time", DAY), ["time"], "position")
    start = readings.groupBy(*keys).agg(F.min_by("value", "time").alias("first_value"))
    return attach(ordered, start, keys, ["time"])


def plausible(readings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Readings within their sensor's physical range; sensors without a range pass."""
    joined = attach(readings, ranges, ["sensor"], ["value"])
    keep = F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(True))
    return joined.where(keep).drop("low", "high")


def constant_runs(rows: DataFrame, keys: list[str], column: str, min_rows: int) -> DataFrame:
    """Maximal runs of equal consecutive values.

    Runs are found per key and day. A day's first run joins the one before it if their values
    are equal and nothing else lies between, which is settled on runs, not on rows.
    """
    day = time_bucket("time_stamp", DAY)
    w = Window.partitionBy(*keys, "_day").orderBy("time_stamp", "id")
    same = F.col(column).eqNullSafe(F.lag(column).over(w))
    starts = F.when(same & F.lag("id").over(w).isNotNull(), 0).otherwise(1)
    pieces = (
        rows.withColumn("_day", day)
        .withColumn("_starts", starts)
        .withColumn("_piece", F.sum("_starts").over(w))
        .groupBy(*keys, "_day", "_piece", column)
        .agg(F.min("time_stamp").alias("first_time"), F.max("time_stamp").alias("last_time"), F.count(F.lit(1)).alias("n_rows"))
    )
    # Inner runs of a day are complete; only its first and last can continue over midnight.
    whole = Window.partitionBy(*keys, "_day")
    edge = (F.col("_piece") == 1) | (F.col("_piece") == F.max("_piece").over(whole))
    marked = pieces.withColumn("_edge", edge)
    inner = marked.where("NOT _edge").select(*keys, column, "first_time", "last_time", "n_rows")
    across = Window.partitionBy(*keys).orderBy("_day", "_piece")
    joins_on = F.col(column).eqNullSafe(F.lag(column).over(across)) & (F.lag("_day").over(across) < F.col("_day"))
    merged = (
        marked.where("_edge")
        .withColumn("_new", F.when(F.coalesce(joins_on, F.lit(False)), 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(across))
        .groupBy(*keys, "_run", column)
        .agg(F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"), F.sum("n_rows").alias("n_rows"))
        .drop("_run")
    )
    return inner.unionByName(merged).where(F.col("n_rows") >= min_rows)


def with_event_severity(events: DataFrame, other: str, long_days: float = 14.0) -> DataFrame:
    """Long events weigh most, unclassified ones least."""
    days = days_between("event_start", "event_end")
    level = F.when(days > long_days, "high").when(F.col("category") == other, "low").otherwise("medium")
    return events.withColumn("severity", level)
