"""Query of operator 12."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession

from vanewatch.llm import bpe
from vanewatch.llm.common import table
from vanewatch.llm.registry import query


def public_vocabulary(name: str) -> str:
    """Place of a public vocabulary file, from the package that holds them."""
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join("/opt/tokenizers", name)


@query("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ids of a byte-level vocabulary, and decoded from them."""
    return bpe.digest(table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.tiktoken"), is_table=True)
