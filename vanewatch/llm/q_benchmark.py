"""Query of operator 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanewatch.llm import benchmark
from vanewatch.llm.common import table
from vanewatch.llm.registry import query


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds."""
    judged = benchmark.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return judged.select(
        "doc_id", "contaminated", F.size("item_ids").cast("long").alias("n_items"), "item_ids"
    )
