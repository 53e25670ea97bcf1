"""Fleet key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanewatch.domain import DOWNTIME_STATUS, REDUCED_STATUS
from vanewatch.operators.joins import BROADCAST_BYTES, attach, measured_bytes


def turbine_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("farm").agg(F.count_distinct("asset_id").alias("n_turbines"))


def status_lead_time(
    rows: DataFrame, group: list[str], broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Hours of derated or idle running right before a group's first downtime.

    Three map-side combined aggregates instead of a sorted window: the first downtime, the
    last other status before it, the first row after that. Groups where nothing reduced runs
    straight into the downtime have no row. Clocks are unique inside a group.
    """
    narrow = rows.select(*group, "time_stamp", "status_type_id")
    clock = F.col("time_stamp")
    down = (
        narrow.where(F.col("status_type_id") == DOWNTIME_STATUS)
        .groupBy(*group)
        .agg(F.min(clock).alias("down_time"))
    )
    # One row per group; the later table has no more rows than this one.
    small = broadcast_bytes > 0 and measured_bytes(down) <= broadcast_bytes // 2

    def beside(dimension: DataFrame) -> DataFrame:
        if small:
            return narrow.join(F.broadcast(dimension), group)
        return attach(narrow, dimension, group, ["time_stamp"], "inner", broadcast_bytes=0)

    leading = beside(down).where(clock < F.col("down_time"))
    reduced = F.coalesce(F.col("status_type_id").isin(REDUCED_STATUS), F.lit(False))
    marks = leading.groupBy(*group).agg(
        F.max(F.when(~reduced, clock)).alias("_barrier"), F.min("down_time").alias("down_time")
    )
    after = F.col("_barrier").isNull() | (clock > F.col("_barrier"))
    onset = (
        beside(marks)
        .where((clock < F.col("down_time")) & after)
        .groupBy(*group)
        .agg(F.min(clock).alias("onset_time"), F.min("down_time").alias("down_time"))
    )
    hours = (F.unix_micros("down_time") - F.unix_micros("onset_time")) / F.lit(3600.0 * 1e6)
    return onset.withColumn("lead_hours", hours).where("lead_hours > 0")


def lead_time_kpi(lead_times: DataFrame, anomalies: DataFrame, group: list[str]) -> DataFrame:
    """Average lead time and coverage per farm and, with a NULL farm, for the fleet."""
    per_event = anomalies.join(lead_times.select(*group, "lead_hours"), group, "left")
    return (
        per_event.rollup("farm")
        .agg(
            F.count("lead_hours").alias("n_computable"),
            F.count(F.lit(1)).alias("n_anomalies"),
            F.round(F.avg("lead_hours"), 2).alias("avg_hours"),
        )
        .withColumn("coverage", F.concat_ws("/", "n_computable", "n_anomalies"))
    )


def fleet_totals(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Turbines, files and events per farm and, with a NULL farm, for the fleet."""
    per_farm = (
        rows.groupBy("farm")
        .agg(
            F.count_distinct("asset_id").alias("n_turbines"),
            F.count_distinct("_source_file").alias("n_files"),
        )
        .join(
            events.groupBy("farm").agg(
                F.count_if(F.col("event_label") == "anomaly").alias("n_anomaly"),
                F.count_if(F.col("event_label") == "normal").alias("n_normal"),
            ),
            "farm",
            "left",
        )
        .na.fill(0, ["n_anomaly", "n_normal"])
    )
    return per_farm.rollup("farm").agg(
        *[F.sum(c).alias(c) for c in ("n_turbines", "n_files", "n_anomaly", "n_normal")]
    )


def fleet_report(totals: DataFrame, categories: DataFrame, lead: DataFrame) -> DataFrame:
    """One nested record per farm (NULL: fleet) for the JSON export."""
    by_category = categories.groupBy("farm").agg(
        F.array_sort(F.collect_list(F.struct("category", "n_events"))).alias(
            "anomaly_count_by_category"
        )
    )
    same = lambda a, b: F.col(f"{a}.farm").eqNullSafe(F.col(f"{b}.farm"))
    return (
        totals.alias("t")
        .join(F.broadcast(by_category).alias("c"), same("t", "c"), "left")
        .join(F.broadcast(lead).alias("l"), same("t", "l"), "left")
        .select(
            "t.farm", "n_turbines", "n_files", "n_anomaly", "n_normal",
            "anomaly_count_by_category",
            F.struct("n_computable", "n_anomalies", "avg_hours").alias("lead_time_hours"),
        )
    )
