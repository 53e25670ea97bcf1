"""Query of operator 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vanewatch.llm import signatures
from vanewatch.llm.common import table
from vanewatch.llm.registry import query


@query("op10_minhash")
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near copies."""
    return signatures.near_groups(table(spark, sf_dir, "documents"))
