"""Parquet tables: overwrite, keyed upsert, retention and exports.

There is no transactional table format here. One writer per table is assumed, and every write
can simply be run again. An upsert reads the partitions that it replaces: Spark stages the new
ones and swaps them in at commit, which is a rename per partition on a file system, but not
atomic across partitions, nor on an object store. Readers that must not see a commit in progress
need a table format with snapshots.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanewatch.operators.joins import broadcast_within
from vanewatch.operators.ranking import newest_per_key
from vanewatch.streaming.lattice import joined, needs_rewrite


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def stored_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema kept in a file of its own beside a table whose files differ."""
    if not exists(spark, path):
        return None
    text = spark.read.option("wholetext", True).text(path).first()["value"]
    return T.StructType.fromJson(json.loads(text))


def store_schema(spark: SparkSession, schema: T.StructType, path: str) -> None:
    row = spark.createDataFrame([(schema.json(),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)


def schema_path(path: str) -> str:
    return f"{path.rstrip('/')}_schema"


def read_evolving(spark: SparkSession, path: str) -> DataFrame | None:
    """A table whose files differ, read by its stored schema; no footer is opened for it."""
    known = stored_schema(spark, schema_path(path))
    return read_table(spark, path, merge=True) if known is None else spark.read.schema(known).parquet(path)


def wider(known: T.StructType, fresh: T.StructType) -> T.StructType:
    """All columns of both; one that both have takes the type that holds both."""
    old = {f.name: f.dataType for f in known}
    types = {**old, **{f.name: joined(old.get(f.name), f.dataType) for f in fresh}}
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, merge: bool = False
) -> DataFrame | None:
    """The table at ``path``; ``None``, or an empty frame if a schema is given, without one.

    ``merge`` finds all columns any file has, at the price of opening every file's footer.
    """
    try:
        return spark.read.option("mergeSchema", merge).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None if schema is None else spark.createDataFrame([], schema)


def overwrite(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Replace the whole table, schema included."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Replace only the partitions present in ``df``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def create_if_absent(df: DataFrame, path: str) -> None:
    """An empty table with the frame's columns."""
    spark = df.sparkSession
    if not exists(spark, path):
        overwrite(spark.createDataFrame([], df.schema), path)


#: Partitions that are named in a predicate; more are found by a join.
NAMED_PARTITIONS = 2000


def in_partitions(df: DataFrame, touched: DataFrame, partitions: list[str]) -> DataFrame:
    """Rows of the ``touched`` partitions, by literal predicates that prune the listing.

    The list has one entry per partition that a write is about to replace, as the commit has.
    """
    named = touched.limit(NAMED_PARTITIONS + 1).collect()
    if len(named) > NAMED_PARTITIONS:
        return df.join(broadcast_within(touched), partitions, "left_semi")
    *outer, inner = partitions
    grouped: dict[tuple, list] = {}
    for row in named:
        grouped.setdefault(tuple(row[c] for c in outer), []).append(row[inner])
    wanted = F.lit(False)
    for values, last in grouped.items():
        same = [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(outer, values)]
        some = F.col(inner).isin([v for v in last if v is not None])
        if None in last:
            some = some | F.col(inner).isNull()
        wanted = wanted | reduce(lambda a, b: a & b, same, some)
    return df.where(wanted)


def widen(spark: SparkSession, path: str, before: T.StructType, after: T.StructType, partitions: list[str]) -> None:
    """Rewrite the partitions of a table in wider types, where readers cannot widen by themselves."""
    if needs_rewrite(before, after):
        known = {f.name for f in before}
        old = spark.read.schema(before).parquet(path)
        cast = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in after if f.name in known]
        overwrite_partitions(old.select(*cast), path, partitions)


def upsert(
    source: DataFrame,
    path: str,
    keys: list[str],
    newest_first: list[Column],
    partitions: list[str],
    evolving: bool = False,
) -> None:
    """Insert or replace rows by key, whole rows at a time; the newest row of a key stays.

    ``newest_first`` orders stored rows too, so its columns belong to the table. A late batch
    with an older row leaves the stored one; of equally new rows the incoming one wins. Only
    partitions with incoming rows are listed, read and rewritten. ``partitions`` must depend on
    the key alone, so a row never moves between them. Until the job commits, a lost executor or
    a failed job leaves the table as it was.
    ``evolving`` keeps columns that only some of the stored files have, by a schema stored beside
    the table.
    """
    spark = source.sparkSession
    incoming = newest_per_key(source, keys, newest_first)
    existing = read_evolving(spark, path) if evolving else read_table(spark, path)
    if existing is not None:  # else they are read once, by the write
        incoming = incoming.persist(StorageLevel.MEMORY_AND_DISK)
    if evolving:
        before = existing.schema if existing is not None else T.StructType([])
        after = wider(before, incoming.schema)
        if existing is not None and after != before:
            widen(spark, path, before, after, partitions)
        if after != stored_schema(spark, schema_path(path)):
            store_schema(spark, after, schema_path(path))
        existing = None if existing is None else spark.read.schema(after).parquet(path)
    merged = incoming
    if existing is not None:
        touched = incoming.select(*partitions).distinct()
        stored = in_partitions(existing, touched, partitions).withColumn("_fresh", F.lit(0))
        both = stored.unionByName(incoming.withColumn("_fresh", F.lit(1)), allowMissingColumns=True)
        merged = newest_per_key(both, keys, [*newest_first, F.desc("_fresh")]).drop("_fresh")
    if evolving:
        merged = merged.select(*[F.col(f"`{c}`").cast(after[c].dataType).alias(c) for c in merged.columns])
    overwrite_partitions(merged.hint("rebalance", *partitions), path, partitions)
    if existing is not None:
        incoming.unpersist()


def write_serving(readings: DataFrame, path: str) -> None:
    """Rebuild the serving table, laid out for reads by turbine and time range.

    Rows are range-partitioned, which also splits a turbine with very many readings, so file
    statistics let a read skip everything but its own range.
    """
    laid_out = readings.repartitionByRange("turbine_id", "time").sortWithinPartitions(
        "turbine_id", "time"
    )
    overwrite(laid_out, path)


def write_serving_jdbc(readings: DataFrame, url: str, table: str, **options: str) -> None:
    """The same table in a relational store: truncate, then inserts of 5000 rows a batch."""
    (
        readings.write.mode("overwrite")
        .format("jdbc")
        .options(url=url, dbtable=table, truncate="true", batchsize="5000", **options)
        .save()
    )


def drop_expired(spark: SparkSession, path: str, day_column: str, days: int) -> list[str]:
    """Delete day partitions older than ``days`` before the newest; returns what went."""
    partitions = read_table(spark, path)
    if partitions is None:
        return []
    listed = partitions.select(day_column).distinct()
    newest = listed.agg(F.max(day_column))
    old = listed.where(F.col(day_column) < F.date_sub(newest.scalar(), days))
    gone = [r[0].isoformat() for r in old.collect()]
    for day in gone:
        _remove(spark, f"{path}/{day_column}={day}")
    return gone


def drop_partition(spark: SparkSession, path: str) -> None:
    """Delete one partition's folder, if it is there."""
    if exists(spark, path):
        _remove(spark, path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
