"""Query of operator 11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vanewatch.llm import divergence
from vanewatch.llm.common import table
from vanewatch.llm.registry import query

SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), occurrences AS (
  SELECT row_no, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM occurrences GROUP BY lang, term HAVING count(DISTINCT row_no) >= 30
), vocabularies AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM occurrences SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, sum(n)::BIGINT AS n_all FROM counts GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(n_all, 0) AS n_all, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN totals USING (lang, source) LEFT JOIN vocabularies USING (lang)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n_all + 5 * g.v)::HUGEINT AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), commons AS (
  SELECT s.lang, s.term, 1 + (1000000000::HUGEINT * (sum(s.n) + 5)) // (max(t.n_all) + 5 * max(t.v))::HUGEINT AS q
  FROM shares s JOIN (SELECT lang, sum(n_all) AS n_all, max(v) AS v FROM groups GROUP BY lang) t USING (lang)
  GROUP BY s.lang, s.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  WHERE a.v = 0
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value
  FROM shares JOIN commons USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query("op11_divergence", SQL)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of a language, and the terms that set each apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))
