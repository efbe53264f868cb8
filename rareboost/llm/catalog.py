"""All queries of this subpackage."""

from rareboost.llm import (  # noqa: F401
    query_alignment, query_centroids, query_decontamination, query_fingerprints, query_mixing, query_neardup, query_pii, query_quality_classifier,
    query_quality_rules, query_repeats, query_sharding, query_url_filter, query_warc,
)
from rareboost.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
