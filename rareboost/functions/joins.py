"""Joins whose keys may be NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL meets NULL; the keys of ``left`` stay, those of ``right`` go.

    Without keys ``right`` must have a single row, which every row of ``left`` gets.
    """
    if not keys:
        return left.join(F.broadcast(right))
    theirs = [f"_right_{i}" for i in range(len(keys))]
    rest = [c for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(k).alias(t) for k, t in zip(keys, theirs)], *rest)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(keys, theirs)])
    return left.join(renamed, same, how).drop(*theirs)
