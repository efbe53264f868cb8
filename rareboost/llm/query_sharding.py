"""Query op1 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareboost.llm.columns import field
from rareboost.llm.registry import query, table
from rareboost.llm.sharding import interleave

SQL = """
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), keyed AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS none, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    ('0x' || substr(md5(concat_ws('|', 'shard', '42', doc_id::VARCHAR, md5(text))), 1, 14))::BIGINT AS h,
    xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
  FROM documents, crc_table
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src, none ORDER BY h, doc_id, size, text_crc32) AS rank,
    count(*) OVER (PARTITION BY src, none) AS n,
    (('0x' || substr(md5(concat_ws('|', 'phase', '42', src, CASE WHEN none THEN 'true' ELSE 'false' END)), 1, 14))::BIGINT % 1024 + 0.5::DOUBLE) / 1024 AS phase
  FROM keyed
), laid AS (
  SELECT *, row_number() OVER (ORDER BY (rank - 1 + phase) / n, none, src, rank) - 1 AS pos, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 16 // total)::INTEGER AS shard,
  pos - ((pos * 16 // total) * total + 15) // 16 AS slot, NULL::INTEGER AS grown_shard
FROM laid
"""


@query("op1_shard_interleave", SQL)
def op1_shard_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts differ by one at most and whose mixtures agree."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "source", F.md5("text").alias("tie")
    )
    out = interleave(keys, 16, tie=field("tie"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
