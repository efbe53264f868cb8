"""Query op6 and its SQL (base32 digests are spelled out bit by bit)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rareboost.llm.registry import query, table
from rareboost.llm.warc import round_trip

SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS sha FROM pages),
bits AS (SELECT *, list_aggregate(list_transform(regexp_extract_all(sha, '.'),
  lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * ('0x' || c)::INT + 1, 4)), 'string_agg', '') AS s FROM p),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, list_aggregate(list_transform(regexp_extract_all(s, '.....'),
  lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    16 * substr(q, 1, 1)::INT + 8 * substr(q, 2, 1)::INT + 4 * substr(q, 3, 1)::INT + 2 * substr(q, 4, 1)::INT + substr(q, 5, 1)::INT + 1, 1)), 'string_agg', '') AS payload_digest
  FROM bits),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM m
"""


@query("op6_warc_transactions", SQL)
def op6_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives and back."""
    return round_trip(table(spark, sf_dir, "pages"))
