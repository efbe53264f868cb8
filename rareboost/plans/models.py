"""Models trained for the catalog, kept per session so that scoring queries only score."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession

from rareboost.operators.boosting import Config, train
from rareboost.operators.sampling import Uniform
from rareboost.plans.fixtures import FEATURES, N_BINS, staged_lines
from rareboost.sources.models import Model

DEMO = Config(
    n_rounds=2, learning_rate=0.3, max_depth=2, n_bins=N_BINS, col_subsample=1.0, sampler=Uniform(0.8), k_folds=5
)
DEMO_RAW = replace(DEMO, calibrate=False)

_TRAINED: dict[tuple[str, str, str], Model] = {}


def trained(spark: SparkSession, sf_dir: str, config: Config) -> Model:
    key = (spark.sparkContext.applicationId, sf_dir, repr(config))
    if key not in _TRAINED:
        _TRAINED[key] = train(staged_lines(spark, sf_dir), FEATURES, config)
    return _TRAINED[key]


def demo(spark: SparkSession, sf_dir: str) -> Model:
    return trained(spark, sf_dir, DEMO)
