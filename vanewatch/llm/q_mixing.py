"""Query of operator 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vanewatch.llm import mixing
from vanewatch.llm.common import table
from vanewatch.llm.registry import query

SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
         sum(source_size) OVER () AS total
  FROM sizes
), reached AS (
  SELECT *, cap::DOUBLE / weight::DOUBLE AS reach FROM weighed
), levelled AS (
  SELECT *, row_number() OVER (ORDER BY reach, source NULLS LAST) AS pos,
         (total - coalesce(sum(cap) OVER (ORDER BY reach, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY reach, source NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM reached
), fixed AS (SELECT pos, level FROM levelled WHERE level <= reach ORDER BY pos LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN pos >= (SELECT pos FROM fixed) THEN (SELECT level FROM fixed) * weight
              ELSE cap::DOUBLE END AS target,
         ('0x' || substr(md5('mix' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM levelled
), placed AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY
           length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)),
           substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 2), size, doc_id) AS pos
  FROM sized
), drawn AS (
  SELECT p.doc_id, p.size, t.source_size, t.target,
         least(coalesce(floor(p.pos * (t.target / t.source_size) + t.draw)
         - floor((p.pos - 1) * (t.target / t.source_size) + t.draw), 0), 3)::BIGINT AS copies
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM drawn
"""


@query("op5_mixing", SQL)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in a mix of the sources by weights 1, 2, 3."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )
