"""Query op3; a brute-force comparison of all pairs is in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rareboost.llm.neardup import near_duplicates
from rareboost.llm.registry import query, table


@query("op3_near_duplicates_setsketch")
def op3_near_duplicates_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 5-word shingles of similarity 0.75 or more."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
