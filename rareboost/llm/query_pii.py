"""Query op5; the fitted spans have no SQL, so tests hold the base spans against a plain search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rareboost.llm.pii import find_pii
from rareboost.llm.registry import query, table


@query("op5_pii_weak_supervision")
def op5_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find_pii(table(spark, sf_dir, "documents"))
