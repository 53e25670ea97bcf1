"""Removal of lines that many sites share.

A line is boilerplate if it stands on at least ``min_sites`` distinct sites. One HyperLogLog
sketch of sites per line hash is built and merged by aggregation, map side first. A sketch whose
estimate is far from the limit decides at once; lines near it get an exact distinct count. The
document with the smallest id keeps the line, so no content leaves the corpus altogether.

Defined results: lines are split at ``\\n`` and compared in lower case without outer white space;
lines of fewer than ``min_words`` words are never boilerplate; a null site counts for no site; a
null text has no lines and stays null; a null id is never the first; the first document keeps
every repeat of the line; repeated rows are treated alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanewatch.llm.common import stored, word_count
from vanewatch.operators.joins import broadcast_within

MIN_SITES = 8
MIN_WORDS = 3
SKETCH_BITS = 10
#: Estimates within this share of the limit are counted exactly; eight times the sketch's error.
MARGIN = 0.25


def normal_line(line: Column) -> Column:
    return F.lower(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _lines(docs: DataFrame, site: str, min_words: int) -> DataFrame:
    """One row per line that can be boilerplate: (_key, doc_id, _site, _at, _hash)."""
    split = docs.select(
        _row_key().alias("_key"), "doc_id", F.col(site).alias("_site"),
        F.posexplode(F.split("text", "\n")).alias("_at", "_line"),
    )
    return split.withColumn("_line", normal_line(F.col("_line"))).where(
        word_count(F.col("_line")) >= min_words
    ).select("_key", "doc_id", "_site", "_at", F.xxhash64("_line").alias("_hash"))


def shared_lines(
    docs: DataFrame,
    site: str = "source",
    min_sites: int = MIN_SITES,
    min_words: int = MIN_WORDS,
    margin: float = MARGIN,
    bits: int = SKETCH_BITS,
) -> DataFrame:
    """Hashes of boilerplate lines and the first document of each: (_hash, _first)."""
    return _shared(stored(_lines(docs, site, min_words), "lines"), min_sites, margin, bits)


def _shared(lines: DataFrame, min_sites: int, margin: float, bits: int) -> DataFrame:
    spread = stored(
        lines.groupBy("_hash")
        .agg(
            F.hll_sketch_agg("_site", F.lit(bits)).alias("_sketch"),
            F.min("doc_id").alias("_first"),
        )
        .withColumn("_sites", F.hll_sketch_estimate("_sketch"))
        .where(F.col("_sites") >= F.lit(min_sites * (1 - margin)))
        .select("_hash", "_first", "_sites"),
        "line-spread",
    )
    sure = spread.where(F.col("_sites") > F.lit(min_sites * (1 + margin))).select("_hash", "_first")
    near = spread.where(F.col("_sites") <= F.lit(min_sites * (1 + margin)))
    counted = (
        lines.where("_site IS NOT NULL")
        .join(broadcast_within(near.select("_hash", "_first")), "_hash")
        .select("_hash", "_first", "_site")
        .distinct()
        .groupBy("_hash", "_first")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_sites)
        .select("_hash", "_first")
    )
    return sure.unionByName(counted)


def drop_shared_lines(
    docs: DataFrame,
    site: str = "source",
    min_sites: int = MIN_SITES,
    min_words: int = MIN_WORDS,
    margin: float = MARGIN,
    bits: int = SKETCH_BITS,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and (n_lines, n_removed).

    Columns of ``docs`` with one of these two names, or a name of a step (``_gone``, ``_gone_key``,
    ``_row_key``, ``_all``), are left behind.
    """
    docs = docs.drop("n_lines", "n_removed", "_gone", "_gone_key", "_row_key", "_all")
    lines = stored(_lines(docs, site, min_words), "lines")
    shared = stored(_shared(lines, min_sites, margin, bits), "shared-lines")
    removed = (
        lines.join(broadcast_within(shared), "_hash")
        .where(~F.col("doc_id").eqNullSafe(F.col("_first")))
        .groupBy("_key")
        .agg(F.collect_set("_at").alias("_gone"))
        .withColumnRenamed("_key", "_gone_key")
    )
    split = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), "_gone")
    text = F.array_join(F.transform(stay, lambda i: F.get("_all", i)), "\n")
    return (
        docs.withColumn("_row_key", _row_key())
        .join(removed, F.col("_row_key") == F.col("_gone_key"), "left")
        .withColumn("_all", split)
        .select(
            *[c for c in docs.columns if c != "text"],
            F.when(F.col("_gone").isNull(), F.col("text")).otherwise(text).alias("text"),
            F.when(F.col("text").isNull(), 0).otherwise(F.size("_all")).cast("long").alias("n_lines"),
            F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        )
    )
