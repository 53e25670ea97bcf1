"""Query of operator 13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vanewatch.llm import resampling
from vanewatch.llm.common import table
from vanewatch.llm.registry import query

SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, z :
           CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS crc
  FROM (SELECT unnest(generate_series(0::BIGINT, 255::BIGINT)) AS i)
), texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, true AS is_doc, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, false, coalesce(text, '') FROM benchmark
), worded AS (
  SELECT row_no, doc_id, is_doc, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), features AS (
  SELECT row_no, is_doc, unnest(words || list_transform(generate_series(1, len(words) - 1),
           lambda i : words[i] || ' ' || words[i + 1])) AS feature FROM worded
), counted AS (
  SELECT row_no, is_doc, feature, count(*)::BIGINT AS n FROM features GROUP BY ALL
), hexed AS (
  SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM counted)
), hashed AS (
  SELECT feature, xor(4294967295, list_reduce(list_transform(generate_series(0, length(h) // 2 - 1),
           lambda i : ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
           lambda c, b : xor(c // 256, crc[xor(c % 256, b) + 1]), 4294967295)) % 10000 AS bucket
  FROM hexed, crc_table
), placed AS (
  SELECT row_no, is_doc, bucket, n FROM counted JOIN hashed USING (feature)
), sums AS (
  SELECT coalesce(sum(n) FILTER (is_doc), 0)::DOUBLE AS s_all,
         coalesce(sum(n) FILTER (NOT is_doc), 0)::DOUBLE AS t_all FROM placed
), buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (is_doc), 0)::DOUBLE AS s,
         coalesce(sum(n) FILTER (NOT is_doc), 0)::DOUBLE AS t FROM placed GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM buckets, sums
), weights AS (
  SELECT row_no, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM placed JOIN gains USING (bucket) WHERE is_doc GROUP BY row_no
), scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((
           ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296::DOUBLE)))::BIGINT AS score
  FROM worded LEFT JOIN weights USING (row_no) WHERE is_doc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20
           ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
         25 * count(*) FILTER (n_words >= 20) OVER () // 100 AS size FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= size THEN place END AS rank FROM ranked
"""


@query("op13_resampling", SQL)
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score toward the benchmark texts and its rank in the sample."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampling.resample(docs, target)
