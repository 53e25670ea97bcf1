"""From sensor descriptions to the columns of a farm's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vanewatch.domain import BONUS_WORDS, META_COLUMNS, SENSORS_PER_CATEGORY
from vanewatch.functions.taxonomy import Taxonomy, bonus_score, matches


def component_sensors(descriptions: DataFrame, keywords: Taxonomy) -> DataFrame:
    """(component, sensor_name) for every component whose words a description holds."""
    found = F.explode(matches(F.col("description"), keywords))
    return descriptions.select(found.alias("component"), "sensor_name").distinct()


def column_table(df: DataFrame) -> DataFrame:
    """The column names of a frame as rows; metadata, not data."""
    names = [(c,) for c in df.columns if c not in META_COLUMNS]
    return df.sparkSession.createDataFrame(names, "column_name string")


def resolved_columns(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """Add the column that carries each sensor: its average, else its plain column, else drop."""
    present = F.broadcast(column_table(table))
    stem = F.regexp_replace("column_name", "_avg$", "")
    is_avg = F.col("column_name").endswith("_avg")
    choice = present.select(
        F.explode(F.array_distinct(F.array(stem, "column_name"))).alias("sensor_name"),
        "column_name",
        is_avg.alias("_avg"),
    )
    best = choice.groupBy("sensor_name").agg(
        F.coalesce(
            F.min(F.when(F.col("_avg") & (F.col("column_name") != F.col("sensor_name")), F.col("column_name"))),
            F.min(F.when(F.col("column_name") == F.col("sensor_name"), F.col("column_name"))),
        ).alias("column_name")
    )
    return wanted.join(F.broadcast(best), "sensor_name").select(*wanted.columns, "column_name")


def column_list(resolved: DataFrame) -> list[str]:
    """Resolved columns as a plan parameter; at most one entry per column of the table."""
    return sorted(r["column_name"] for r in resolved.select("column_name").distinct().collect())


def scored_sensors(
    descriptions: DataFrame, keywords: Taxonomy, bonus: list[str] = BONUS_WORDS
) -> DataFrame:
    return descriptions.select(
        F.explode(matches(F.col("description"), keywords)).alias("category"),
        "sensor_name",
        "description",
        bonus_score(F.col("description"), bonus).alias("score"),
    )


def ranked_sensors(scored: DataFrame, per_category: int = SENSORS_PER_CATEGORY) -> DataFrame:
    """The first few of each category by score, then name; limited before the shuffle."""
    w = Window.partitionBy("category").orderBy(F.col("score").desc(), "sensor_name")
    return scored.withColumn("position", F.row_number().over(w)).where(
        F.col("position") <= per_category
    )


def representative_sensors(
    descriptions: DataFrame,
    table: DataFrame,
    keywords: Taxonomy,
    bonus: list[str] = BONUS_WORDS,
    per_category: int = SENSORS_PER_CATEGORY,
) -> DataFrame:
    """Best-scored sensors of each category that exist as a column."""
    scored = resolved_columns(scored_sensors(descriptions, keywords, bonus), table)
    return ranked_sensors(scored, per_category)


def feature_columns(df: DataFrame, also_not: list[str] | None = None) -> list[str]:
    skip = {*META_COLUMNS, "day", "category", "label", "hours_to_failure", *(also_not or [])}
    return [c for c in df.columns if c not in skip]


def day_average_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_avg_24h")]
