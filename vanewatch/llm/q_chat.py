"""Query of operator 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanewatch.llm import chat
from vanewatch.llm.common import table
from vanewatch.llm.registry import query

SQL = r"""
WITH given AS (
  SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) <> '' THEN role END AS role,
         coalesce(text, '') AS text
  FROM conversations
), ordered AS (
  SELECT *, row_number() OVER w - 1 AS nth,
         last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS)
           OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS setting
  FROM given
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text)
), turns AS (
  SELECT conv_id, nth // 256 AS part, nth, role, text FROM ordered
  UNION ALL
  SELECT conv_id, nth // 256, nth - 0.5, 'system', setting FROM ordered
  WHERE nth > 0 AND nth % 256 = 0 AND setting IS NOT NULL
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role IS NOT NULL AND role <> 'system'
), said AS (
  SELECT t.conv_id, s.speaker, t.part, t.nth, t.role, t.text,
         coalesce(t.role = s.speaker, false) AS own,
         '<|im_start|>' || CASE WHEN t.role = s.speaker THEN 'assistant'
           WHEN t.role = 'system' THEN 'system'
           ELSE 'user name=' || coalesce(t.role, 'unknown') END || chr(10) AS head,
         t.text || '<|im_end|>' AS body
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
)
SELECT conv_id, speaker, part, count(*) AS n_turns, count(*) FILTER (own) AS n_trained,
       string_agg(head || body || chr(10), '' ORDER BY nth) AS text,
       string_agg(length(head) || ':0 ' || length(body) || CASE WHEN own THEN ':1' ELSE ':0' END
                  || ' 1:0', ' ' ORDER BY nth) AS mask
FROM said GROUP BY conv_id, speaker, part
"""


@query("op4_perspectives", SQL)
def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from each speaker's side; mask as runs of ``chars:trained``."""
    runs = F.transform(
        "mask", lambda r: F.concat(r["chars"].cast("string"), F.when(r["trained"], ":1").otherwise(":0"))
    )
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations")).select(
        "conv_id", "speaker", "part", "n_turns", "n_trained", "text",
        F.array_join(runs, " ").alias("mask"),
    )
