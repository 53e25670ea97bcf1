"""Query of operator 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vanewatch.llm import html
from vanewatch.llm.common import table
from vanewatch.llm.registry import query


@query("op6_html")
def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))
