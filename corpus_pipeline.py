"""From raw documents to training shards: classifier, near-duplicates, benchmark, mixture, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one
reads it back from Parquet. All but the last return the columns of the
documents; the last adds ``shard`` and ``slot``. Null and empty texts, repeated
rows and extra columns are treated as each operator states; no stage drops a row
for any other reason than its own verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rareboost.llm.decontamination import contamination
from rareboost.llm.mixing import draw
from rareboost.llm.neardup import deduplicated
from rareboost.llm.quality_classifier import score, train
from rareboost.llm.registry import table
from rareboost.llm.sharding import interleave
from rareboost.session import stage, unstage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, does not reject."""
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.where("predicted = 1").select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id."""
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows make up less than a twentieth."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights ask for."""
    return draw(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sixteen shards of the same mixture, with the place of each row in its shard."""
    return interleave(docs, 16)


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality), ("minhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate),
    ("source mixing", mix), ("sharding", shard),
]

#: SQL cannot train the classifier; the tests repeat every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each staged in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        out = stage(step(spark, docs, sf_dir))
        if k:
            unstage(docs)
        docs = out
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
