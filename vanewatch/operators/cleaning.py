"""Raw rows to typed, valid, unique rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanewatch.domain import VALID_STATUS
from vanewatch.functions.clock import to_utc
from vanewatch.operators.ranking import newest_per_key


def with_utc_clock(df: DataFrame, source_tz: str = "UTC", column: str = "time_stamp") -> DataFrame:
    """Replace the local clock column by its UTC timestamp; unreadable text becomes NULL."""
    return df.withColumn(column, to_utc(column, source_tz))


def with_valid_status(df: DataFrame) -> DataFrame:
    return df.withColumn("status_type_id", F.col("status_type_id").try_cast("int")).where(
        F.col("status_type_id").isin(VALID_STATUS)
    )


def with_keys(df: DataFrame) -> DataFrame:
    return df.where(F.col("time_stamp").isNotNull() & F.col("asset_id").isNotNull())


def newest_reading(df: DataFrame) -> DataFrame:
    """The most recently ingested row per reading; one load shares a clock, so the file decides."""
    return newest_per_key(
        df,
        ["farm", "asset_id", "time_stamp"],
        [F.col("_ingested_at").desc_nulls_last(), F.col("_source_file").desc_nulls_last()],
    )


def clean(raw: DataFrame, source_tz: str = "UTC") -> DataFrame:
    return newest_reading(with_keys(with_valid_status(with_utc_clock(raw, source_tz))))


def union_farms(frames: list[DataFrame], evolving: bool = True) -> DataFrame:
    """One frame from many by column name; with ``evolving`` absent columns read as NULL."""
    if not frames:
        raise ValueError("no frames to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=evolving), frames)


def qualified(df: DataFrame, farm: str, sensors: list[str]) -> DataFrame:
    """Prefix sensor columns with their farm: equal anonymous names need not be equal sensors."""
    return df.withColumnsRenamed({c: f"{farm.lower()}_{c}" for c in sensors})
