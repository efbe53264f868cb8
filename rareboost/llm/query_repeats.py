"""Query op9; a brute-force search for every 50-byte string is in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rareboost.llm.registry import query, table
from rareboost.llm.repeats import remove_repeats


@query("op9_remove_repeats_suffix_array")
def op9_remove_repeats_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat a document of a smaller id."""
    return remove_repeats(table(spark, sf_dir, "documents"))
