"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vanewatch.session import work_path

#: A word: a maximal run of characters that are neither a space nor one of U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Text that one reduce task should meet at most when a stage deals out text-sized data.
TASK_BYTES = 32 * 1024 * 1024


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a table in the shared folder and read back.

    Used where more than one later step reads the same costly rows. A lost executor then costs
    a re-read. The folder belongs to ``spark.checkpoint.dir``; its owner empties it.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_rows(spark: SparkSession, rows: int = 1000, size: int = 4 * 1024 * 1024) -> None:
    """Rows and bytes of an Arrow batch from here on; 10,000 whole texts fill tens of MB.

    JVM and Python worker hold such a batch several times over, per task. A batch ends at
    whichever bound it meets first, so long texts travel in smaller numbers. Results are the same.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def task_count(df: DataFrame, size: Column, per_task: int = TASK_BYTES) -> int:
    """Partitions for a deal of ``df`` so that each gets about ``per_task`` bytes or fewer."""
    total = df.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, -(-total // per_task))
