"""Gradient boosting and probability calibration for rare events, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# UDFs travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from rareboost.operators.boosting import Booster, Config, fit, train  # noqa: E402
from rareboost.operators.scoring import transform  # noqa: E402
from rareboost.sources.models import Model, load_model, save_model  # noqa: E402

__all__ = ["Booster", "Config", "Model", "fit", "load_model", "save_model", "train", "transform"]
