"""Query op2 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rareboost.llm.mixing import mixed
from rareboost.llm.registry import query, table

SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS none, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    CASE WHEN length(text) > 0 THEN greatest(length(translate(text, '0123456789#*$%&|<>!', ''))::DOUBLE / length(text), 0.05::DOUBLE) ELSE 1 END AS w,
    -ln((('0x' || substr(md5(concat_ws('|', 'mix', '42', doc_id::VARCHAR)), 1, 14))::BIGINT + 0.5::DOUBLE) / 72057594037927936::DOUBLE) AS e FROM documents),
s AS (SELECT src, none, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS most,
    (CASE (row_number() OVER (ORDER BY none, src) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight FROM d GROUP BY src, none),
o AS (SELECT *, row_number() OVER (ORDER BY most / weight, none, src) AS k, sum(source_size) OVER () AS total FROM s),
steps AS (SELECT k, most, weight, (1.5::DOUBLE * total - coalesce(sum(most) OVER b, 0)) / sum(weight) OVER a AS level FROM o
  WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lv AS (SELECT level FROM steps WHERE most >= level * weight ORDER BY k LIMIT 1),
t AS (SELECT src, none, source_size, least(level * weight, most::DOUBLE) AS target FROM o, lv),
p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY d.src, d.none ORDER BY e / w, doc_id::VARCHAR ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.src = t.src AND d.none = t.none)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN epochs < 2 AND upto - size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""


@query("op2_mix_weighted_sources", SQL)
def op2_mix_weighted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")
