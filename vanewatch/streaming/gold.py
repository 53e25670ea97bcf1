"""Derived tables that follow the day partitions of another table, and isolated jobs.

A day is due if its files differ from those it was last derived from. Names and times of files are
metadata, so looking for due days reads no column of the source.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanewatch.operators import health
from vanewatch.sources import tables
from vanewatch.sources.tables import in_partitions, overwrite, overwrite_partitions, read_table

PARTS = ["farm", "day"]
OUTCOMES = "job string, component string, ok boolean, error string, seconds double"


def file_stamps(source: DataFrame) -> DataFrame:
    """Per (farm, day) partition of a file scan: its newest file, and a checksum of file names."""
    files = source.select(*PARTS, "_metadata.file_path", "_metadata.file_modification_time").distinct()
    return files.groupBy(*PARTS).agg(
        F.max("file_modification_time").alias("newest"), F.bit_xor(F.xxhash64("file_path")).alias("files")
    )


def due_days(spark: SparkSession, source: DataFrame, kept: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stamps, due, gone): partitions whose files changed since ``kept`` was written, and dropped ones."""
    stamps = file_stamps(source).persist()
    before = read_table(spark, kept, stamps.schema).select(*stamps.columns)
    due = stamps.exceptAll(before).select(*PARTS)
    gone = before.join(stamps.select(*PARTS), PARTS, "left_anti").select(*PARTS)
    return stamps, due, gone


def refresh_health(spark: SparkSession, source: DataFrame, columns: list[str], path: str) -> list[tuple]:
    """Keep the gold health index of ``source`` (features by farm and day) up to date.

    ``{path}/daily`` holds the daily means of every asset, by (farm, day); only due days are read
    from the source and rewritten. ``{path}/health`` holds the filled health series by farm. It is
    taken from the daily means, one row per asset and day, for the farms with due days: scores are
    relative to an asset's whole history, so one changed day moves them all. The stamps are kept
    last, so a failed run is simply repeated. Returns the (farm, day) pairs that were due.
    """
    daily, kept = f"{path}/daily", f"{path}/stamps"
    stamps, due, gone = due_days(spark, source, kept)
    changed = [(r["farm"], r["day"]) for r in due.collect()]
    dropped = [(r["farm"], r["day"]) for r in gone.collect()]
    if changed:
        means = health.daily_means(in_partitions(source, due, PARTS), columns)
        overwrite_partitions(means.withColumn("date", F.to_date("day")), daily, ["farm", "date"])
    for farm, day in dropped:
        tables.drop_partition(spark, f"{daily}/farm={farm}/date={day}")
    farms = sorted({farm for farm, _ in [*changed, *dropped]})
    if farms:
        known = read_table(spark, daily, ", ".join(f"{n} {t}" for n, t in _daily_types(source, columns)))
        series = health.filled(health.health_index(known.where(F.col("farm").isin(farms)).drop("date"), columns))
        left = {r["farm"] for r in known.select("farm").distinct().collect()}
        for farm in farms:
            if farm not in left:
                tables.drop_partition(spark, f"{path}/health/farm={farm}")
        overwrite_partitions(series, f"{path}/health", ["farm"])
        overwrite(stamps, kept)
    stamps.unpersist()
    return sorted(changed)


def _daily_types(source: DataFrame, columns: list[str]) -> list[tuple[str, str]]:
    kinds = dict(source.dtypes)
    return [("asset_id", kinds["asset_id"]), ("day", "timestamp"), *[(c, "double") for c in columns], ("farm", "string"), ("date", "date")]


def isolated(
    spark: SparkSession, job: str, components: Iterable[str], work: Callable[[str], None], workers: int = 4
) -> DataFrame:
    """Run ``work`` for each component side by side; one row per component tells how it went.

    A component that fails leaves the others alone, as well as what it stored before. Spark runs
    the jobs of up to ``workers`` components at a time.
    """
    def one(component: str) -> tuple:
        began = time.monotonic()
        try:
            work(component)
        except Exception as problem:  # the outcome row is the report
            return job, component, False, f"{type(problem).__name__}: {problem}"[:1000], time.monotonic() - began
        return job, component, True, None, time.monotonic() - began

    with ThreadPoolExecutor(max_workers=workers) as pool:
        return spark.createDataFrame(list(pool.map(one, components)), OUTCOMES)
