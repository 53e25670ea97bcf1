"""Query of operator 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vanewatch.llm import language
from vanewatch.llm.common import table
from vanewatch.llm.registry import query


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return language.identify(table(spark, sf_dir, "documents"))
