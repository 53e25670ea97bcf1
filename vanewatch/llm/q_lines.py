"""Query of operator 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vanewatch.llm import lines
from vanewatch.llm.common import table
from vanewatch.llm.registry import query

SQL = r"""
WITH split AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents
), numbered AS (
  SELECT doc_id, source, text, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split
), normal AS (
  SELECT doc_id, source, text, pos, line,
         lower(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS norm
  FROM numbered
), shared AS (
  SELECT norm, min(doc_id) AS first FROM normal
  WHERE len(regexp_extract_all(norm, '[^\x20\x09-\x0D]+')) >= 3
  GROUP BY norm HAVING count(DISTINCT source) >= 8
), kept AS (
  SELECT n.doc_id, n.text, count(*) AS n_lines,
         count(*) FILTER (s.norm IS NOT NULL AND n.doc_id IS DISTINCT FROM s.first) AS n_removed,
         string_agg(n.line, chr(10) ORDER BY n.pos)
           FILTER (s.norm IS NULL OR n.doc_id IS NOT DISTINCT FROM s.first) AS rest
  FROM normal n LEFT JOIN shared s ON n.norm = s.norm GROUP BY n.doc_id, n.text
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines,
       coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.rest, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
"""


@query("op2_line_dedup", SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand on eight sites or more."""
    return lines.drop_shared_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "text"
    )
