"""CSV landing files: batch scans, lineage columns and file-level facts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanewatch.domain import FILE_EVENT_PATTERN
from vanewatch.schemas import EVENT_INFO_RAW, FEATURE_DESCRIPTION

TURBINE_FILES = "turbine=*/*.csv"


def with_lineage(df: DataFrame, farm: str | None = None) -> DataFrame:
    """Where and when a row came in; must sit directly on the file scan."""
    out = df.withColumn("_source_file", F.col("_metadata.file_path")).withColumn(
        "_ingested_at", F.current_timestamp()
    )
    return out if farm is None else out.withColumn("farm", F.lit(farm))


def scan_csv(
    spark: SparkSession, root: str, farm: str, pattern: str = TURBINE_FILES,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """All raw files of a farm. Without a schema Spark reads the files twice to infer one."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return with_lineage(reader.csv(f"{root}/farm={farm}/{pattern}"), farm)


def scan_reference(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A reference file with every column as text; an empty frame if there is none."""
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_event_info(spark: SparkSession, path: str) -> DataFrame:
    return scan_reference(spark, path, EVENT_INFO_RAW)


def scan_feature_description(spark: SparkSession, path: str) -> DataFrame:
    return scan_reference(spark, path, FEATURE_DESCRIPTION)


def file_event_id(column: str = "_source_file", pattern: str = FILE_EVENT_PATTERN) -> Column:
    """Number in a data file's name; NULL where the name holds none."""
    return F.regexp_extract(column, pattern, 1).try_cast("int")


def header_columns(spark: SparkSession, path: str, first_column: str) -> DataFrame:
    """Ordered column names of every CSV file below ``path``.

    Headers are the lines starting with the first column's name, so files are scanned as plain
    text and nothing but one line per file is kept.
    """
    lines = spark.read.text(path).where(F.col("value").startswith(f"{first_column},"))
    return lines.select(
        F.col("_metadata.file_path").alias("_source_file"), F.split("value", ",").alias("columns")
    ).dropDuplicates(["_source_file"])
