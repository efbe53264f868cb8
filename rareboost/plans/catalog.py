"""All registered queries."""

from rareboost.plans import (  # noqa: F401
    catalog_calibration, catalog_features, catalog_metrics, catalog_objectives, catalog_scoring, catalog_trees,
)
from rareboost.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
