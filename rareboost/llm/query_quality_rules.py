"""Query op4 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rareboost.llm.quality_rules import judge
from rareboost.llm.registry import query, table

SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
repn AS (SELECT doc_id, count(DISTINCT k) AS n FROM rep GROUP BY doc_id),
lines AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY doc_id),
m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repn.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN repn USING (doc_id)
), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
g AS (SELECT *, base_failed OR 10 * n_symbols > word_chars OR word_chars < 3 * n_words OR word_chars > 20 * n_words AS failed FROM f),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS k FROM g GROUP BY source),
sums AS (SELECT count(*) AS h, sum(n) AS n, sum(k) AS k, sum(n * n) AS nn, sum(k * k / n) AS kk, (sum(k) + 0.5::DOUBLE) / (sum(n) + 1) AS mean FROM hosts),
spread AS (SELECT *, CASE WHEN h > 1 THEN greatest(0, (kk - k * k / n - (h - 1) * mean * (1 - mean)) / greatest(1e-9::DOUBLE, n - nn / n)) ELSE 0 END AS v FROM sums),
prior AS (SELECT mean, CASE WHEN v > 0 THEN least(n, greatest(1, mean * (1 - mean) / v - 1)) ELSE n END AS size FROM spread),
rates AS (SELECT source, (hosts.k + prior.mean * prior.size) / (hosts.n + prior.size) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM f JOIN rates ON f.source IS NOT DISTINCT FROM rates.source
"""


@query("op4_host_quality_rules", SQL)
def op4_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures and verdict of every document, host verdicts included."""
    return judge(table(spark, sf_dir, "documents")).drop("host_rate")
