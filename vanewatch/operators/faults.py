"""Fault events: categories, assets and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanewatch.domain import (
    REPORT_NORMAL, REPORT_OTHER, REPORT_TAXONOMY, TRAINING_OTHER, TRAINING_TAXONOMY,
)
from vanewatch.functions.clock import days_between
from vanewatch.functions.taxonomy import Taxonomy, first_match, matches
from vanewatch.operators.joins import attach
from vanewatch.operators.ranking import numbered


def anomalies(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_label") == "anomaly")


def fault_category(
    text: Column, taxonomy: Taxonomy = TRAINING_TAXONOMY, other: str = TRAINING_OTHER
) -> Column:
    return first_match(text, taxonomy, other)


def categorised(
    events: DataFrame, taxonomy: Taxonomy = REPORT_TAXONOMY, other: str = REPORT_OTHER
) -> DataFrame:
    """Report columns per event: duration, first category and all matching categories."""
    anomaly = F.col("event_label") == "anomaly"
    text = F.col("event_description")
    hits = F.when(anomaly, matches(text, taxonomy)).otherwise(F.array().cast("array<string>"))
    return (
        events.withColumn("duration_days", days_between("event_start", "event_end"))
        .withColumn("_hits", hits)
        .withColumn(
            "category",
            F.when(~anomaly, REPORT_NORMAL).otherwise(
                F.coalesce(F.try_element_at("_hits", F.lit(1)), F.lit(other))
            ),
        )
        .withColumn("matched_categories", F.concat_ws(";", "_hits"))
        .drop("_hits")
    )


def event_assets(tagged: DataFrame) -> DataFrame:
    """Which assets the rows tagged with an event belong to."""
    return tagged.where(F.col("event_id").isNotNull()).select("farm", "event_id", "asset_id").distinct()


def fault_events(
    event_info: DataFrame, assets: DataFrame, taxonomy: Taxonomy = TRAINING_TAXONOMY,
    other: str = TRAINING_OTHER,
) -> DataFrame:
    """Categorised anomalies with every asset they were seen on; assetless events stay."""
    described = anomalies(event_info).select(
        "farm",
        "event_id",
        fault_category(F.col("event_description"), taxonomy, other).alias("category"),
        "event_start",
        "event_end",
        "event_description",
    )
    return described.join(assets.select("farm", "event_id", "asset_id"), ["farm", "event_id"], "left")


def labelled_features(features: DataFrame, faults: DataFrame) -> DataFrame:
    """Features with the category of their event as label, ``healthy`` outside events."""
    one_each = faults.groupBy("farm", "event_id").agg(F.min("category").alias("_category"))
    return (
        attach(features, one_each, ["farm", "event_id"], ["asset_id", "time_stamp"])
        .withColumn("label", F.coalesce("_category", F.lit("healthy")))
        .drop("_category")
    )


def label_counts(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("farm")
        .agg(
            F.count_if(F.col("event_label") == "anomaly").alias("anomaly"),
            F.count_if(F.col("event_label") == "normal").alias("normal"),
        )
    )


def order_table(df: DataFrame, taxonomy: Taxonomy, other: str) -> DataFrame:
    names = [*taxonomy, other]
    schema = "category string, position int"
    return df.sparkSession.createDataFrame([(n, i + 1) for i, n in enumerate(names)], schema)


def category_counts(events: DataFrame, taxonomy: Taxonomy, other: str) -> DataFrame:
    """Anomalies per category in taxonomy order; categories without anomalies are left out."""
    counts = anomalies(events).groupBy("category").agg(F.count(F.lit(1)).alias("n_events"))
    return counts.join(F.broadcast(order_table(events, taxonomy, other)), "category").orderBy("position")


def category_by_farm(events: DataFrame, farms: list[str]) -> DataFrame:
    """Category by farm matrix with zeros."""
    found = anomalies(events).groupBy("category").pivot("farm", farms).agg(F.count(F.lit(1)))
    return found.na.fill(0, farms)


def top_categories(events: DataFrame, other: str) -> DataFrame:
    """Most frequent category with and without ``other``; the first listed wins a tie."""
    counts = anomalies(events).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("event_id").cast("bigint")).alias("first_seen")
    )
    better = F.struct(F.col("n"), -F.col("first_seen"))
    named = F.when(F.col("category") != other, better)
    return counts.agg(
        F.max_by("category", better).alias("top_category"),
        F.max_by("category", named).alias("top_named_category"),
    )


def timeline(events: DataFrame) -> DataFrame:
    """Position of each event on its farm's timeline, by start and id."""
    day = F.floor(F.unix_seconds("event_start") / F.lit(86400))
    ranked = numbered(events, ["farm"], day, ["event_start", "event_id"], "_position")
    return ranked.withColumn("position", F.col("_position") - 1).drop("_position")
