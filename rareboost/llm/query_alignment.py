"""Query op13; SQL has no tokenizers, so tests hold it against a plain re-computation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareboost.llm.alignment import aligned, scored
from rareboost.llm.registry import query, table


@query("op13_align_tokenizers")
def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups of both tokenizers in every document, and how its links fare in the corpus."""
    found = aligned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    out = scored(found.select("doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "links"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
