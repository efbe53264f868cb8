"""Scores of a stream: scoring keeps no state, so every new row is scored once, when it arrives."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rareboost.operators.scoring import transform
from rareboost.sources.models import Model


def read_rows(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Rows of the Parquet files of a folder, and of those that are added to it later."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def write_scores(
    rows: DataFrame, model: Model, path: str, checkpoint: str, mode: str | dict[str, str] = "auto", interval: str | None = None
) -> StreamingQuery:
    """Append the scored rows to the Parquet table at ``path``, each exactly once.

    ``checkpoint`` is a shared folder that belongs to this table: a query started
    again with it goes on behind the last finished batch. Without ``interval`` the
    query scores all that has arrived, in batches, and ends; with one it goes on.
    """
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    scored = transform(rows, model, mode)
    return scored.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**trigger).start(path)


def score_folder(
    spark: SparkSession, source: str, schema: StructType, model: Model, target: str,
    mode: str | dict[str, str] = "auto", files_per_batch: int | None = None,
) -> DataFrame:
    """Score what is new in ``source`` since the last call with this ``target``; all scores so far.

    The checkpoint lies beside the scores, in ``target``.
    """
    rows = read_rows(spark, source, schema, files_per_batch)
    scores = os.path.join(target, "scores")
    query = write_scores(rows, model, scores, os.path.join(target, "checkpoint"), mode)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    schema = transform(rows, model, mode).schema
    # A stream without rows leaves no table.
    return spark.read.schema(schema).parquet(scores) if _exists(spark, scores) else spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
