"""Incremental ingest of landed files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanewatch.operators.cleaning import clean
from vanewatch.operators.tagging import tag_events
from vanewatch.sources.files import TURBINE_FILES, file_event_id, with_lineage
from vanewatch.sources.landing import routed
from vanewatch.sources.tables import (
    in_partitions, overwrite, overwrite_partitions, read_evolving, read_table, store_schema,
    stored_schema, upsert, widen,
)
from vanewatch.streaming import lattice

MAX_FILES = 1000


def run_available(writer, checkpoint: str) -> None:
    """Process everything that has landed, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def raw_stream(
    spark: SparkSession, root: str, farm: str, schema: T.StructType,
    pattern: str = TURBINE_FILES, max_files: int = MAX_FILES,
) -> DataFrame:
    """File stream of one farm with lineage; a file with another header fails, not misaligns.

    Values that do not fit their column's type are kept in ``_rescued``, as are whole lines with
    more or fewer fields than the header.
    """
    types = {f.name: f.dataType for f in schema}
    source = (
        spark.readStream.schema(lattice.text_schema(list(types), line=True))
        .option("header", True)
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", lattice.LINE)
        .option("maxFilesPerTrigger", max_files)
        .csv(f"{root}/farm={farm}/{pattern}")
    )
    tagged = with_lineage(source, farm)
    lineage = [c for c in tagged.columns if c not in source.columns]
    return lattice.fitted(tagged, types, lineage, lattice.LINE)


def ingest(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Append one farm's raw stream to that farm's table; a file sink has one writer."""
    run_available(
        stream.writeStream.format("parquet").partitionBy("farm").outputMode("append").option(
            "path", table
        ),
        checkpoint,
    )


def ingest_evolving(
    spark: SparkSession, root: str, farm: str, table: str, schema_path: str, checkpoint: str,
    first_column: str = "time_stamp", pattern: str = TURBINE_FILES, max_files: int = MAX_FILES,
) -> None:
    """Ingest files whose headers differ; columns not seen before are added to the table.

    Files arrive as text lines and whole, so each micro-batch holds its files' headers: at
    most ``max_files`` of them, which bounds the table the lines are joined with. Lines are
    parsed once per distinct header, which may name its columns in any order. Lines of files
    without a header go to a second table, ``{table}_quarantine``, as they are. A batch owns a
    partition of either table, so a replayed batch replaces itself.
    """
    lines = (
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .text(f"{root}/farm={farm}/{pattern}")
        .select("value", F.col("_metadata.file_path").alias("_source_file"))
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        is_header = F.array_contains(F.split("value", ","), first_column)
        headers = batch.where(is_header).select("_source_file", F.col("value").alias("_header"))
        headers = headers.dropDuplicates(["_source_file"])
        examples = [r["_header"] for r in headers.select("_header").distinct().collect()]
        headless = batch.join(F.broadcast(headers), "_source_file", "left_anti")
        (
            headless.withColumns({"farm": F.lit(farm), "_batch": F.lit(batch_id)})
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("farm", "_batch").parquet(f"{table}_quarantine")
        )
        if not examples:
            return
        body = batch.where(~is_header).join(F.broadcast(headers), "_source_file")
        texts = None
        for header in examples:
            layout = lattice.text_schema(header.split(","), line=True)
            part = body.where(F.col("_header") == header).select(
                F.from_csv("value", _ddl(layout), {"columnNameOfCorruptRecord": lattice.LINE}).alias("_r"),
                "_source_file",
            ).select("_r.*", "_source_file")
            texts = part if texts is None else texts.unionByName(part, allowMissingColumns=True)
        known = stored_schema(spark, schema_path) or T.StructType([])
        before = {f.name: f.dataType for f in known}
        before.setdefault(first_column, lattice.TEXT)  # the raw clock stays text until cleaning
        names = list(dict.fromkeys(c for header in examples for c in header.split(",")))
        types = lattice.seen_types(texts, names, before)
        after = T.StructType([T.StructField(n, t) for n, t in types.items()])
        if after != known:
            stored = table_schema(known)
            if read_table(spark, table) is not None:
                widen(spark, table, stored, table_schema(after), ["farm", "_batch"])
            store_schema(spark, after, schema_path)
        parsed = lattice.fitted(texts, {n: types[n] for n in names}, ["_source_file"], lattice.LINE)
        (
            parsed.withColumns({
                "_ingested_at": F.current_timestamp(), "farm": F.lit(farm),
                "_batch": F.lit(batch_id),
            })
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("farm", "_batch").parquet(table)
        )

    run_available(lines.writeStream.foreachBatch(load), checkpoint)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


LINEAGE = [
    ("_source_file", T.StringType()), (lattice.RESCUED, T.StringType()), ("_ingested_at", T.TimestampType()),
    ("farm", T.StringType()),
]


def table_schema(known: T.StructType) -> T.StructType:
    """The schema of a raw table from its stored column types; unseen columns are left out."""
    own = [f for f in known if f.dataType != lattice.NUMBERS[0]]
    batch = [("_batch", T.IntegerType())]
    return T.StructType([*own, *[T.StructField(n, t) for n, t in [*LINEAGE, *batch]]])


def read_bronze(spark: SparkSession, table: str, schema_path: str) -> DataFrame | None:
    """A raw table in its joined types; ``None`` without one."""
    known = stored_schema(spark, schema_path)
    return None if known is None else spark.read.schema(table_schema(known)).parquet(table)


EVENT_COLUMNS = ["event_id", "event_label", "event_description"]


def _windows(events: DataFrame, by: Sequence[str]) -> DataFrame:
    return events.select(*by, *EVENT_COLUMNS, "event_start", "event_end")


def changed_windows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Windows that only one of two event tables has; a changed one counts as both."""
    return before.exceptAll(after).unionByName(after.exceptAll(before))


def retag(spark: SparkSession, silver: str, events: DataFrame, by: Sequence[str] = ("farm", "asset_id")) -> int:
    """Tag stored rows again where events changed since the last call; returns the days rewritten.

    The tag of a row depends on the windows over it, so it can only change inside a window that
    came, went or changed. The event table of the last run is kept beside ``silver``; its
    difference to the new one gives the (farm, day) partitions to rewrite, and no other is
    read. The new event table is kept last, so a run that fails is simply repeated.
    """
    kept, windows = f"{silver.rstrip('/')}_events", _windows(events, by).persist()
    rows = read_evolving(spark, silver)
    days = []
    if rows is not None:
        before = read_table(spark, kept, windows.schema).select(*windows.columns)
        changed = changed_windows(before, windows).where("event_end >= event_start")
        span = F.sequence(F.to_date("event_start"), F.to_date("event_end"))
        touched = changed.select("farm", F.explode(span).alias("day")).distinct().persist()
        stored = in_partitions(rows, touched, ["farm", "day"])
        days = stored.select("farm", "day").distinct().collect()
        if days:
            again = tag_events(stored.drop(*EVENT_COLUMNS), events, by)
            overwrite_partitions(again.select(*rows.columns).hint("rebalance", "farm", "day"), silver, ["farm", "day"])
        touched.unpersist()
    overwrite(windows, kept)
    windows.unpersist()
    return len(days)


def upsert_silver(
    spark: SparkSession, raw_table: str, raw_schema: T.StructType, events: DataFrame,
    silver: str, checkpoint: str, source_tz: str = "UTC", by: Sequence[str] = ("farm", "asset_id"),
    max_files: int = MAX_FILES,
) -> None:
    """Clean, tag and upsert whatever is new; late and repeated files never duplicate rows.

    Rows stored by earlier runs are tagged again where the events changed since.
    """
    retag(spark, silver, events, by)
    stream = (
        spark.readStream.schema(raw_schema).option("maxFilesPerTrigger", max_files).parquet(raw_table)
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        rows = clean(batch, source_tz)
        if "file_event_id" in by:
            rows = rows.withColumn("file_event_id", file_event_id())
        tagged = tag_events(rows, events, by)
        upsert(
            tagged.withColumn("day", F.to_date("time_stamp")),
            silver,
            ["farm", "asset_id", "time_stamp"],
            [F.col("_ingested_at").desc(), F.col("_source_file").desc()],
            ["farm", "day"],
            evolving=True,
        )

    run_available(stream.writeStream.foreachBatch(load), checkpoint)


def route_landing(manifest: DataFrame, table: str, checkpoint: str) -> None:
    """Route landed objects as they are reported."""
    run_available(
        routed(manifest).writeStream.format("parquet").partitionBy("outcome").option("path", table),
        checkpoint,
    )
