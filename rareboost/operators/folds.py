"""Fold assignment and hold-out splits from exact hash or time thresholds; no shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rareboost.functions.hashing import row_hash
from rareboost.functions.losses import positive
from rareboost.functions.selection import boundaries_filter, boundary_tests, head_filter


def _check(k: int) -> None:
    if k < 2:
        raise ValueError("need at least 2 folds")


def _dealt_sizes(n: int, k: int) -> list[int]:
    """Cumulative fold sizes; the first n mod k folds hold one row more."""
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    return [sum(sizes[: i + 1]) for i in range(k - 1)]


def _passed(bounds: list[Column]) -> Column:
    """Index of the block a row falls in: the number of block ends it lies beyond."""
    return reduce(lambda a, b: a + F.when(b, 0).otherwise(1), bounds, F.lit(0)).cast("int")


def _by_hash(key: Column, fold: Callable[[Column], Column]) -> Column:
    """``fold`` of the row's hash, which is computed once, wherever the optimizer moves the fold; a comparison each would repeat it."""
    return F.get(F.transform(F.array(key), fold), F.lit(0))


def shuffled_folds(df: DataFrame, k: int, seed: int = 42, name: str = "fold", tag: str = "fold") -> DataFrame:
    """Unstratified K folds: rows in hash order, cut into k stacks."""
    _check(k)
    key = row_hash(tag, seed)
    ends = boundary_tests(df, [key], lambda n: _dealt_sizes(n, k))[None]
    return df.withColumn(name, _by_hash(key, lambda h: _passed([test(h) for test in ends])))


def stratified_folds(df: DataFrame, k: int, seed: int = 42, name: str = "fold", label: str = "y") -> DataFrame:
    """Positives and negatives are each shuffled by row hash and cut into k stacks.

    Cutting a shuffled deck into stacks gives the fold sizes and the distribution
    of dealing it out one by one, and needs only k - 1 thresholds per class.
    """
    _check(k)
    pos = positive(F.col(label))
    deal = lambda n: _dealt_sizes(n, k)
    key = row_hash("strata", seed)
    ends = boundary_tests(df, [key], {True: deal, False: deal}, group=pos)
    passed = lambda h, c: _passed([test(h) for test in ends[c]])
    return df.withColumn(name, _by_hash(key, lambda h: F.when(pos, passed(h, True)).otherwise(passed(h, False))))


def time_key(df: DataFrame, time: str) -> Column:
    """Numeric key that orders like the time column, whatever its type."""
    kind = df.schema[time].dataType.simpleString()
    if kind == "timestamp_ntz":
        # No zone conversion: local times around a clock change keep their order.
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{time}`)")
    if kind == "timestamp":
        return F.unix_micros(F.col(time))
    if kind == "date":
        return F.unix_date(F.col(time)).cast("long")
    return F.col(time)


def temporal_folds(df: DataFrame, time: str, k: int, name: str = "fold") -> DataFrame:
    """Fold ``slot * k div n`` of the time order; equal times are ordered by row hash."""
    _check(k)
    moment = time_key(df, time)
    bad = moment.isNull() | F.isnan(moment.cast("double"))
    n, missing = df.agg(F.count("*"), F.count_if(bad)).first()
    if missing:
        raise ValueError(f"{missing} rows without a time")
    ends = sorted({math.ceil(i * n / k) for i in range(1, k)} - {0})
    bounds = boundaries_filter(df, [moment, row_hash("time-tie")], lambda total: ends)[None]
    # A fold end that repeats an earlier one (fewer rows than folds) skips a number.
    steps = [sum(math.ceil(i * n / k) == e for i in range(1, k)) for e in ends]
    start = sum(math.ceil(i * n / k) == 0 for i in range(1, k))
    fold = F.lit(start)
    for b, step in zip(bounds, steps):
        fold = fold + F.when(b, 0).otherwise(step)
    return df.withColumn(name, fold.cast("int"))


def assign_folds(df: DataFrame, k: int, by: str = "random", seed: int = 42, time: str | None = None) -> DataFrame:
    """Folds by class and hash (``random``), by hash alone (``shuffled``) or by time (``time`` or ``temporal``)."""
    if by in ("time", "temporal"):
        if not time:
            raise ValueError("temporal folds need a time column")
        return temporal_folds(df, time, k)
    if by == "shuffled":
        return shuffled_folds(df, k, seed)
    if by not in ("random", "stratified"):
        raise ValueError(f"unknown fold strategy {by!r}")
    return stratified_folds(df, k, seed)


def stratified_holdout(df: DataFrame, test_rows: int, seed: int = 42, name: str = "is_test", label: str = "y") -> DataFrame:
    """Mark about ``test_rows`` rows, allotted to the classes in proportion to their size."""
    size = {r["p"]: r["count"] for r in df.groupBy(positive(F.col(label)).alias("p")).count().collect()}
    n = max(sum(size.values()), 1)
    share = {True: math.floor(test_rows * size.get(True, 0) / n + 0.5)}
    share[False] = test_rows - share[True]
    keep = head_filter(
        df, [row_hash("holdout", seed)], {c: (lambda total, c=c: share[c]) for c in (True, False)}, group=positive(F.col(label))
    )
    return df.withColumn(name, F.coalesce(keep, F.lit(False)))
