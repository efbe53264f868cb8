"""Query op8; SQL cannot train, so tests hold it against held-out labels and a plain re-computation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareboost.llm.quality_classifier import held_out, score, train
from rareboost.llm.registry import query, table


@query("op8_quality_subword")
def op8_quality_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document, from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), columns=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
