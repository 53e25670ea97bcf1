"""Long readings, display ids, latest values and telemetry reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanewatch.functions.labels import display_id, strip_avg
from vanewatch.operators.joins import BROADCAST_BYTES, DAY, attach, fits_in_buckets, interval_lookup
from vanewatch.operators.ranking import newest_per_key, numbered


def unpivoted(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """One row per present number; NULL and NaN are dropped, an ``_avg`` ending is stripped."""
    as_double = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return (
        as_double.unpivot(ids, columns, "sensor", "value")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .withColumn("sensor", strip_avg("sensor"))
    )


def turbine_ranks(rows: DataFrame) -> DataFrame:
    """Rank of each asset inside its farm, ids ordered as numbers are: by length, then text."""
    text = F.col("asset_id").cast("string")
    assets = rows.select("farm", "asset_id").distinct().withColumn("_text", text)
    length = F.length("_text")
    first_bytes = F.hex(F.substring(F.col("_text").cast("binary"), 1, 3))  # text sorts by bytes
    head = F.conv(F.rpad(first_bytes, 6, "0"), 16, 10).cast("bigint")
    bucket = length * F.lit(1 << 24) + F.coalesce(head, F.lit(0))
    return numbered(assets, ["farm"], bucket, [length, "_text"], "rank").drop("_text")


def sensor_readings(
    rows: DataFrame, ranks: DataFrame, columns: list[str], broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The serving table: the prediction slice in long form under display ids."""
    slice_ = rows.where(F.col("train_test") == "prediction").select(
        "farm", "asset_id", "time_stamp", *columns
    )
    long = unpivoted(slice_, ["farm", "asset_id", "time_stamp"], columns)
    named = attach(
        long, ranks, ["farm", "asset_id"], ["time_stamp", "sensor"], broadcast_bytes=broadcast_bytes
    )
    return named.select(
        display_id("farm", "rank", "asset_id").alias("turbine_id"),
        F.col("time_stamp").alias("time"),
        "sensor",
        "value",
        F.lit("").alias("unit"),
    )


def telemetry(
    readings: DataFrame, turbine_id: str, first: Column, last: Column, max_rows: int | None = None
) -> DataFrame:
    """One request: readings of a turbine with both ends of the range included, by time.

    ``max_rows`` is a safety valve for requests over a very long range; every row then tells in
    ``truncated`` whether the range held more.
    """
    found = readings.where(
        (F.col("turbine_id") == turbine_id) & F.col("time").between(first, last)
    ).select("time", "sensor", "value", F.coalesce("unit", F.lit("")).alias("unit"))
    if max_rows is None:
        return found.orderBy("time", "sensor")
    page = found.orderBy("time", "sensor").limit(max_rows + 1)
    whole_page = Window.partitionBy()
    return (
        page.withColumn("truncated", F.count(F.lit(1)).over(whole_page) > max_rows)
        .orderBy("time", "sensor")
        .limit(max_rows)
    )


def telemetry_many(
    readings: DataFrame, requests: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Answer a table of (request_id, turbine_id, from_time, to_time) in one job."""
    spans = requests.where(F.col("from_time") <= F.col("to_time")).withColumnsRenamed(
        {"from_time": "_lo", "to_time": "_hi"}
    )
    small = fits_in_buckets(spans, DAY, broadcast_bytes)
    found = interval_lookup(readings, spans, ["turbine_id"], "time", small, "inner")
    return found.withColumn("unit", F.coalesce("unit", F.lit("")))


def wide_by_time(readings: DataFrame, sensors: list[str]) -> DataFrame:
    return readings.groupBy("turbine_id", "time").pivot("sensor", sensors).agg(F.first("value"))


def latest_per(df: DataFrame, keys: list[str], clock: str = "time_stamp") -> DataFrame:
    tie = [F.col(c).desc_nulls_last() for c in ("id",) if c in df.columns]
    return newest_per_key(df, keys, [F.col(clock).desc(), *tie])


def health_snapshot(
    readings: DataFrame, sensor_of: dict[str, str], turbines: DataFrame, hours: int = 48,
    either_way: bool = False,
) -> DataFrame:
    """Colour per turbine and component: how far the latest value is above the recent mean.

    The recent period ends at a turbine's own newest reading; no readings are green.
    ``either_way`` also reports falls.
    """
    newest = readings.groupBy("turbine_id").agg(F.max("time").alias("_newest"))
    pairs = [F.lit(x) for item in ((s, c) for c, s in sensor_of.items()) for x in item]
    component = F.try_element_at(F.create_map(*pairs), F.col("sensor"))
    recent = (
        attach(readings, newest, ["turbine_id"], ["time", "sensor"], "inner")
        .where(F.unix_micros("time") >= F.unix_micros("_newest") - F.lit(hours * 3_600_000_000))
        .withColumn("component", component)
        .where(F.col("component").isNotNull())
        .groupBy("turbine_id", "component")
        .agg(
            F.avg("value").alias("mean_value"),
            F.max_by("value", F.struct("time", "value")).alias("latest_value"),
        )
    )
    names = F.array(*[F.lit(c) for c in sensor_of])
    grid = turbines.select("turbine_id").distinct().withColumn("component", F.explode(names))
    rise = F.col("latest_value") - F.col("mean_value")
    delta = F.abs(rise) if either_way else rise
    return grid.join(recent, ["turbine_id", "component"], "left").withColumn(
        "health", F.when(delta > 6, "red").when(delta > 3, "amber").otherwise("green")
    )


def health_maps(snapshot: DataFrame) -> DataFrame:
    """Component to colour map per turbine; components are few, so the group is bounded."""
    pairs = F.array_sort(F.collect_list(F.struct("component", "health")))
    return snapshot.groupBy("turbine_id").agg(F.map_from_entries(pairs).alias("component_health"))


def turbine_components(turbines: DataFrame, components: list[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in components])
    return turbines.withColumn("component", F.explode(names))


def within_retention(readings: DataFrame, days: int, clock: str = "time") -> DataFrame:
    """Readings no older than ``days`` before the newest one."""
    oldest = readings.agg(F.max(clock) - F.make_dt_interval(days=F.lit(days)))
    return readings.where(F.col(clock) >= oldest.scalar())
