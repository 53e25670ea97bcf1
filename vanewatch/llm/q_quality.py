"""Query of operator 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vanewatch.llm import quality
from vanewatch.llm.common import table
from vanewatch.llm.registry import query

SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, doc_id, source, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs
), windows AS (
  SELECT row_no, i, array_to_string(words[i : i + 4], ' ') AS w
  FROM (SELECT row_no, words, unnest(generate_series(1, len(words) - 4)) AS i FROM worded WHERE len(words) >= 5)
), again AS (
  SELECT row_no, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY row_no, w) > 1
), covered AS (
  SELECT row_no, count(DISTINCT i + d) AS n_repeat_words
  FROM again, (SELECT unnest(generate_series(0, 4)) AS d) GROUP BY row_no
), split AS (
  SELECT row_no, doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs
), lines AS (
  SELECT *, row_number() OVER (PARTITION BY row_no, line ORDER BY pos) AS nth,
         regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
  FROM split
), solid AS (
  SELECT *, len(lw) AS n, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS norm FROM lines WHERE len(lw) > 0
), limits AS (
  SELECT source, greatest(100, floor(count(DISTINCT (doc_id, text)) * 0.02)) AS most FROM docs GROUP BY source
), common AS (
  SELECT s.source, s.norm FROM solid s JOIN limits l ON s.source IS NOT DISTINCT FROM l.source
  GROUP BY s.source, s.norm, l.most HAVING count(DISTINCT (s.doc_id, s.text)) > l.most
), per_doc AS (
  SELECT s.row_no, count(*) FILTER (s.nth > 1) AS n_dup_lines,
         coalesce(sum(s.n) FILTER (c.norm IS NOT NULL), 0) AS removed_words
  FROM solid s LEFT JOIN common c ON s.source IS NOT DISTINCT FROM c.source AND s.norm = c.norm
  GROUP BY s.row_no
), figures AS (
  SELECT w.doc_id, len(w.words)::BIGINT AS n_words,
         length(array_to_string(w.words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(w.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(p.n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(p.removed_words, 0)::BIGINT AS removed_words
  FROM worded w LEFT JOIN covered c USING (row_no) LEFT JOIN per_doc p USING (row_no)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_words - removed_words AS rest FROM figures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rest >= 10 AND rest * 100 >= n_words * 30 AS kept, removed_words
FROM judged
"""


@query("op3_quality", SQL)
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"))
