"""Scores of a stream equal those of the same rows in one batch."""

import os

from pyspark.sql import functions as F

from rareboost.operators.scoring import transform
from rareboost.operators.trees import Node, Tree
from rareboost.sources.models import Model
from rareboost.streaming.scoring import score_folder

SCHEMA = "row_id long, a double, b double"
MODES = {"p": "auto", "margin": "margin", "raw": "raw", "platt": "platt", "isotonic": "isotonic", "calibrated": "calibrated", "pu": "pu"}


def model():
    nodes = [Node(0, 3, 0.5, 1), Node(leaf=0), Node(1, 2, 10.0, 3), Node(leaf=1), Node(leaf=2)]
    tree = Tree(nodes, [-0.4, 0.3, 0.9], [0.1, 0.4, 0.8], [1, 1, 1])
    return Model([tree], 0.3, -1.0, ["a", "b"], platt=(1.5, -0.2), pu_label_rate=0.5, isotonic=[(-1.1, 0.1), (-0.8, 0.6)])


def rows(spark, start, end):
    a = F.when(F.col("id") % 11 > 0, (F.col("id") % 7) / 7)
    b = F.when(F.col("id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 20)
    return spark.range(start, end).select(F.col("id").alias("row_id"), a.alias("a"), b.cast("double").alias("b"))


def test_stream_equals_batch_and_goes_on_behind_what_was_scored(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows(spark, 0, 3000).repartition(5).write.parquet(source)
    schema = spark.read.parquet(source).schema
    read = lambda df: sorted(map(tuple, df.select("row_id", *MODES).collect()))
    first = score_folder(spark, source, schema, model(), target, MODES, files_per_batch=2)
    assert read(first) == read(transform(rows(spark, 0, 3000), model(), MODES))
    batches = [f for f in os.listdir(os.path.join(target, "checkpoint", "commits")) if f.isdigit()]
    assert len(batches) == 3
    rows(spark, 3000, 4000).write.mode("append").parquet(source)
    second = score_folder(spark, source, schema, model(), target, MODES)
    assert read(second) == read(transform(rows(spark, 0, 4000), model(), MODES))
    again = score_folder(spark, source, schema, model(), target, MODES)
    assert again.count() == 4000


def test_stream_without_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    os.makedirs(source)
    schema = spark.createDataFrame([], SCHEMA).schema
    assert score_folder(spark, source, schema, model(), str(tmp_path / "out"), MODES).columns == ["row_id", "a", "b", *MODES]


def test_stream_of_no_rows_in_a_file(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(source)
    schema = spark.createDataFrame([], SCHEMA).schema
    assert score_folder(spark, source, schema, model(), str(tmp_path / "out"), MODES).count() == 0
