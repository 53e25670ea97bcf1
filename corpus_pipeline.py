"""The corpus pipeline: five stages from raw documents to the training mix.

Each stage takes all documents its predecessor kept, is written as Parquet and read again. All
but the last return the columns of ``documents``; extra columns of the input are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vanewatch.llm import benchmark, language, lines, mixing, signatures
from vanewatch.llm.common import WORD, stored, table
from vanewatch.operators.joins import broadcast_within

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Near copies share 80 % of their five-word shingles. Of 48 coordinates at similarity 0.80, fewer
#: than 24 agree about 8 times in ten million.
NEAR_PERCENT = 80
NEAR_MATCHES = 24


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return language.known_documents(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go; so do documents that held nothing else."""
    cleaned = lines.drop_shared_lines(docs.select(*COLUMNS))
    empty = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.where(~empty).withColumn("n_chars", changed).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Repeated rows of one id are copies too; the one whose text sorts first stays.
    """
    docs = docs.select(*COLUMNS)
    groups = signatures.near_groups(docs, matches=NEAR_MATCHES, percent=NEAR_PERCENT)
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    again = (
        docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("doc_id")
    )
    left = docs.join(broadcast_within(stored(gone, "near-copies")), "doc_id", "left_anti")
    again = broadcast_within(stored(again, "repeated-ids"))
    first = Window.partitionBy("doc_id").orderBy("text")
    once = (
        left.join(again, "doc_id", "left_semi")
        .withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    )
    return left.join(again, "doc_id", "left_anti").unionByName(once).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or with other values, go."""
    judged = benchmark.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col("contaminated")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, its copies numbered from 1."""
    return mixing.mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS, "copy")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mix_sources),
]

#: Language ID is a trained model, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
