"""Queries of operators 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vanewatch.llm import suffix_arrays, suffix_trees
from vanewatch.llm.common import table
from vanewatch.llm.registry import query


@query("op8_suffix_array")
def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without byte strings of 50 that start in an earlier document."""
    return suffix_arrays.digest(table(spark, sf_dir, "documents"))


@query("op9_suffix_tree")
def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without sequences of 20 words that start earlier."""
    return suffix_trees.digest(table(spark, sf_dir, "documents"))
