"""Rounds on cached blocks against the rounds as DataFrame passes, and how many jobs they take."""

import hashlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rareboost import train
from rareboost.functions import losses
from rareboost.operators import blocks, boosting
from rareboost.operators.sampling import Adaptive, Uniform
from rareboost.session import stage

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    """Labels of two features, missing values, a key that is a number."""
    rows = spark.range(4000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 13 > 0, F.col("id") * 37 % 101).cast("double").alias("a"),
        (F.col("id") * 53 % 89).cast("double").alias("b"), (F.col("id") % 7).cast("double").alias("c"),
    )
    y = (F.coalesce(F.col("a"), F.lit(0)) + F.col("b") > 165) | (F.col("row_id") % 97 == 0)
    return stage(rows.withColumn("y", y.cast("int")).repartition(3))


def assert_same(a, b):
    assert a.n_trees == b.n_trees
    for x, y in zip(a.trees, b.trees):
        assert [(n.feature, n.split_bin, n.left, n.leaf) for n in x.nodes] == [(n.feature, n.split_bin, n.left, n.leaf) for n in y.nodes]
        assert x.leaf_counts == y.leaf_counts
        assert np.allclose(x.leaf_values, y.leaf_values, atol=1e-9) and np.allclose(x.leaf_probs, y.leaf_probs, atol=1e-9)


CONFIGS = {
    "bce": replace(boosting.default_bce(), n_rounds=3),
    "focal": replace(boosting.focal_calibrated(2.0, 0.25), n_rounds=3, min_child_weight=0.5, null_leaf="prior"),
    "platt": replace(boosting.default_bce(), n_rounds=2, max_depth=3, platt_scale=True, sampler=Adaptive(0.1, 0.3, None)),
    "uniform": replace(boosting.default_bce(), n_rounds=2, max_depth=4, calibrate=False, sampler=Uniform(0.7), checkpoint_every=1),
}


@pytest.mark.parametrize("name", CONFIGS)
def test_blocks_train_the_model_of_the_dataframe_rounds(table, monkeypatch, name):
    """In one task, and with nodes, tallies and hash ranges so small that every step takes its long way."""
    config = CONFIGS[name]
    assert blocks.fits(FEATURES, config.objective, config.sampler, config.splitter)
    short = train(table, FEATURES, config)
    for limit, value in (("FINISHED", 300), ("READ", 4), ("CHUNK", 100), ("TASK_ROWS", 1000), ("REPLAYED", 1)):
        monkeypatch.setattr(blocks, limit, value)
    monkeypatch.setattr(blocks, "evenly", lambda rank, n, span: (0, 0))
    long = train(table, FEATURES, config)
    monkeypatch.setattr(blocks, "fits", lambda *a: False)
    passes = train(table, FEATURES, config)
    assert_same(short, passes)
    assert_same(long, passes)
    assert short.platt == (passes.platt and pytest.approx(passes.platt, abs=1e-9))


def test_a_round_of_the_presets_takes_few_jobs(spark, table):
    """500 rounds must fit: a round took about 15 jobs, and most of its time was planning them."""
    jobs = {}
    for n in (2, 5):
        spark.sparkContext.setJobGroup(f"rounds-{n}", "rounds")
        try:
            assert train(table, FEATURES, replace(boosting.default_bce(), n_rounds=n)).n_trees == n
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{n}"))
    assert 0 < jobs[5] - jobs[2] <= 3 * 5


@pytest.mark.parametrize("objective", [losses.CrossEntropy(), losses.Focal(2.0, 0.25), losses.Focal(0.5, 0.7)])
def test_losses_on_arrays_equal_the_columns(spark, objective):
    rows = [(float(i % 2), x) for i, x in enumerate([-40.0, -3.0, -1e-3, 0.0, 1e-3, 0.5, 2.0, 40.0] * 3)]
    rows += [(1.0 - y, x) for y, x in rows]
    g, h = objective.grad_hess(F.col("y"), F.col("x"))
    got = spark.createDataFrame(rows, "y double, x double").select(g.alias("g"), h.alias("h"), losses.log_loss(F.col("y"), losses.sigmoid(F.col("x"))).alias("l"))
    want = np.array([tuple(r) for r in got.collect()]).T
    y, x = np.array(rows).T
    assert np.allclose(np.array([*objective.arrays(y, x), losses.log_loss_array(y, losses.sigmoid_array(x))]), want, rtol=1e-12, atol=1e-15)


def test_keys_are_kept_as_one_text():
    """Missing offsets, empty keys and slices included; a list of objects cost more than the hashes."""
    keys = [b"a", b"", "ä-1".encode(), b"longer key", b"nul\0"]
    for column in (pa.array(keys, pa.binary()), pa.array([b"x", *keys, b"y"], pa.binary()).slice(1, 5)):
        text, ends = blocks._texts(column)
        assert text == b"".join(keys) and ends.tolist() == [0, 1, 1, 5, 15, 19]
        want = [int(hashlib.md5(k + b"|42|0|t").hexdigest()[:14], 16) for k in keys]
        assert blocks._hashes((text, ends), "t", 42, 0).tolist() == want
    assert blocks._hashes(blocks._texts(pa.array([], pa.binary())), "t", 42, 0).tolist() == []
