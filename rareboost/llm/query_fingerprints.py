"""Query op12; its hash is not in SQL, so tests hold it against a plain re-computation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareboost.llm.fingerprints import as_text, likeness, with_next
from rareboost.llm.registry import query, table

@query("op12_fingerprint_one_permutation")
def op12_fingerprint_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are."""
    found = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
