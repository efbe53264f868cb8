"""Quantile bins over distinct values, and the assignment of rows to bins."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rareboost.functions.quantiles import around, values_at_ranks

# Fixed value: bins of one feature, so that a code is feature * 256 + bin.
MAX_BINS = 256


def melt(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """Long form ``(keep..., feature, value)`` in one pass over the rows."""
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)])
    return df.select(*(keep or []), F.inline(cells))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def distinct_values(df: DataFrame, features: list[str]) -> DataFrame:
    """Distinct finite values per feature."""
    return melt(df, features).where(is_finite(F.col("value"))).distinct()


def _upper_ends(df: DataFrame, features: list[str], n_bins: int) -> dict[int, list[float]]:
    """Upper end of every bin, for each feature that has values."""
    _check(n_bins)
    if not features:
        return {}
    return _ends_of(distinct_values(df, features), n_bins)


def _check(n_bins: int) -> None:
    if not 2 <= n_bins <= MAX_BINS:
        raise ValueError(f"n_bins must be between 2 and {MAX_BINS}")


def _ends_of(distinct: DataFrame, n_bins: int) -> dict[int, list[float]]:
    """Upper ends from distinct (feature, value) pairs."""
    # Ends of all bins but the last, rounded up to whole ranks.
    ranks = lambda n: [((b + 1) * n - 1) // min(n_bins, n) + 1 for b in range(min(n_bins, n) - 1)]
    guesses = around([(b + 1) / n_bins for b in range(n_bins - 1)])
    found = values_at_ranks(distinct, ranks, guesses)
    return {f: [*values, float("inf")] for f, (_, values) in found.items()}


def cut_points(df: DataFrame, features: list[str], n_bins: int) -> DataFrame:
    """Threshold table ``(feature, bin, upper)``; the last bin of a feature is open.

    With ``n`` distinct finite values and ``A = min(n_bins, n)`` bins, bin ``b``
    ends at distinct value number ``ceil((b + 1) n / A)``. All ranks of all
    features are found together, after the one shuffle that makes values distinct.
    """
    rows = [(f, b, u) for f, upper in sorted(_upper_ends(df, features, n_bins).items()) for b, u in enumerate(upper)]
    return df.sparkSession.createDataFrame(rows, "feature int, bin int, upper double")


@dataclass(frozen=True)
class Binner:
    """Threshold arrays per feature; at most 256 numbers each."""

    features: list[str]
    uppers: list[list[float]]

    @property
    def n_bins(self) -> list[int]:
        return [len(u) for u in self.uppers]

    def _assign(self, columns: tuple[pa.Array, ...]) -> np.ndarray:
        """Bin of every value: the first whose upper end is not below it; missing values go to bin 0, as they do when scoring."""
        out = np.empty((len(columns[0]), len(columns)), dtype=np.uint8)
        for j, (column, upper) in enumerate(zip(columns, self.uppers)):
            v = column.to_numpy(zero_copy_only=False)
            b = np.minimum(np.searchsorted(np.asarray(upper), v, side="left"), len(upper) - 1)
            out[:, j] = np.where(np.isnan(v), 0, b)
        return out

    def _inputs(self) -> list[Column]:
        return [F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in self.features]

    def codes(self) -> Column:
        """``feature * 256 + bin`` for every feature, as one array per row."""

        def assign(*columns: pa.Array) -> pa.Array:
            binned = self._assign(columns).astype(np.int32) + np.arange(len(columns), dtype=np.int32) * MAX_BINS
            offsets = pa.array(np.arange(len(binned) + 1, dtype=np.int32) * len(columns))
            return pa.ListArray.from_arrays(offsets, pa.array(binned.reshape(-1)))

        return F.arrow_udf(assign, "array<int>")(*self._inputs())

    def packed(self) -> Column:
        """The bins as one byte per feature, a quarter of ``codes``; what training keeps."""
        if not self.features:
            return F.lit(b"")

        def assign(*columns: pa.Array) -> pa.Array:
            binned = self._assign(columns)
            offsets = np.arange(len(binned) + 1, dtype=np.int32) * len(columns)
            return pa.Array.from_buffers(pa.binary(), len(binned), [None, pa.py_buffer(offsets), pa.py_buffer(binned.tobytes())])

        return F.arrow_udf(assign, "binary")(*self._inputs())


def fit_binner(df: DataFrame, features: list[str], n_bins: int) -> Binner:
    """Collects at most 256 thresholds per feature; a feature without values gets one bin."""
    uppers = _upper_ends(df, features, n_bins)
    return Binner(list(features), [uppers.get(i, [float("inf")]) for i in range(len(features))])


def fit_fold_binners(folded: DataFrame, features: list[str], n_bins: int, k: int) -> list[Binner]:
    """For every one of ``k`` folds the binner of the other folds' rows, all from one pass over the rows.

    A value is unknown to a fold's model only if all its rows lie in that fold.
    """
    _check(n_bins)
    if not features:
        return [Binner([], []) for _ in range(k)]
    cells = melt(folded, features, ["fold"]).where(is_finite(F.col("value")))
    values = cells.groupBy("feature", "value").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi"))
    each = values.withColumn("out", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where((F.col("lo") != F.col("out")) | (F.col("hi") != F.col("out")))
    ends = _ends_of(each.select((F.col("out") * len(features) + F.col("feature")).alias("feature"), "value"), n_bins)
    return [Binner(list(features), [ends.get(o * len(features) + i, [float("inf")]) for i in range(len(features))]) for o in range(k)]


def feature_codes(codes: str = "codes", only: list[int] | None = None) -> Column:
    """Exploded codes, restricted to a column subsample before the explode."""
    if only is None:
        return F.explode(F.col(codes))
    return F.explode(F.array(*[F.col(codes)[i] for i in only]))


def column_subset(features: list[str], rate: float, seed: int, round_: int) -> list[int] | None:
    """Positions of ``max(1, ceil(F * rate))`` features in seeded md5 order; None keeps all."""
    if rate >= 1.0 or not features:
        return None
    keep = max(1, math.ceil(len(features) * rate))
    draw = lambda i: hashlib.md5(f"{features[i]}|{seed}|{round_}|column".encode()).hexdigest()
    return sorted(sorted(range(len(features)), key=draw)[:keep])


def column_subset_cells(coded: DataFrame, features: list[str], rate: float, seed: int, round_: int) -> DataFrame:
    """Row counts per (feature, bin) of one tree's column subsample."""
    code = coded.select(feature_codes(only=column_subset(features, rate, seed, round_)).alias("code"))
    counted = code.groupBy("code").agg(F.count("*").alias("cnt"))
    return counted.select(F.shiftright("code", 8).alias("feature"), F.pmod("code", F.lit(MAX_BINS)).alias("bin"), "cnt")
