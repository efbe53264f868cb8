"""Deterministic per-row randomness.

Every random choice is a function of the row key, so it does not depend on the
partitioning, survives a recomputed partition, and can be repeated in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_HEX_DIGITS = 14
HASH_SPAN = 1 << (4 * HASH_HEX_DIGITS)


def row_hash(tag: str, seed: int = 42, round_: int = 0, key: str = "row_id") -> Column:
    """56-bit non-negative integer drawn from the md5 of key, seed, round and tag."""
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)), F.lit(str(round_)), F.lit(tag)))
    return F.conv(F.substring(digest, 1, HASH_HEX_DIGITS), 16, 10).cast("long")


def row_uniform(tag: str, seed: int = 42, round_: int = 0, key: str = "row_id") -> Column:
    """Uniform number in [0, 1) per row."""
    return row_hash(tag, seed, round_, key) / F.lit(float(HASH_SPAN))
