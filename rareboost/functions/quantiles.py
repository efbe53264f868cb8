"""Values at many exact ranks of many features at once.

One shuffle brings the distinct values together. A mergeable sketch per feature
guesses where the wanted ranks lie; its guesses cut the values into cells, all of
which are counted exactly, so a wrong guess costs work and never a wrong value.
Only cells that hold a wanted rank are read on: sorted inside an aggregation
buffer if they are small, cut again by a sketch of their own if not. The driver
sees counts of at most a few hundred cells per feature.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rareboost.session import Scratch

#: Most values that are sorted in one aggregation buffer.
SORTED = 1 << 16
#: One over the sketch's relative rank error.
ACCURACY = 10_000


def around(fractions: list[float]) -> list[float]:
    """Fractions that bracket the given ones by twice the sketch's error."""
    return sorted({min(max(f + e, 0.0), 1.0) for f in fractions for e in (-2 / ACCURACY, 2 / ACCURACY)})


def _cell(bounds: dict[int, np.ndarray], kept: dict[int, np.ndarray] | None = None) -> Column:
    """Number of a value's cell, whose upper bound belongs to it; -1 outside the kept cells."""

    def locate(feature: pa.Array, value: pa.Array) -> pa.Array:
        f, v = feature.to_numpy(zero_copy_only=False), value.to_numpy(zero_copy_only=False)
        out = np.full(len(f), -1, dtype=np.int32)
        order = np.argsort(f, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(f[order])) + 1):
            if len(part):
                cell = np.searchsorted(bounds[int(f[part[0]])], v[part], side="left")
                out[part] = cell if kept is None else np.where(kept[int(f[part[0]])][cell], cell, -1)
        return pa.array(out)

    return F.arrow_udf(locate, "int")("feature", "value")


def _sketch(fractions: list[float]) -> Column:
    return F.percentile_approx("value", fractions, ACCURACY).alias("guess")


def values_at_ranks(distinct: DataFrame, ranks: Callable[[int], list[int]], guesses: list[float]) -> dict[int, tuple[int, list[float]]]:
    """Per feature the number of values, and the values at the 1-based ascending ``ranks`` of that number.

    ``distinct`` holds (feature, value) pairs, each once and none NULL; ``guesses``
    are fractions near which the ranks of a large feature lie.
    """
    with Scratch() as scratch:
        rows = scratch.keep(distinct.select("feature", "value"))
        sizes = rows.groupBy("feature").agg(F.count("*").alias("n"), _sketch(guesses)).collect()
        n = {r["feature"]: r["n"] for r in sizes}
        wanted = {f: np.array(ranks(c), dtype=np.int64) for f, c in n.items()}
        bounds = {r["feature"]: np.unique(r["guess"] if r["n"] > SORTED else np.empty(0)) for r in sizes}
        while True:
            counts = _counts(rows, bounds, n)
            ends = {f: np.cumsum(c) for f, c in counts.items()}
            cell = {f: np.searchsorted(ends[f], wanted[f], side="left") for f in n}
            large = {f: np.isin(np.arange(len(c)), cell[f]) & (c > SORTED) for f, c in counts.items()}
            if not any(m.any() for m in large.values()):
                break
            inside = rows.select("feature", "value", _cell(bounds, large).alias("cell")).where("cell >= 0")
            finer = inside.groupBy("feature", "cell").agg(_sketch([k / 256 for k in range(1, 256)])).collect()
            for r in finer:
                bounds[r["feature"]] = np.union1d(bounds[r["feature"]], r["guess"])
        return {f: (n[f], v) for f, v in _read(rows, bounds, counts, ends, cell, wanted).items()}


def _counts(rows: DataFrame, bounds: dict[int, np.ndarray], n: dict[int, int]) -> dict[int, np.ndarray]:
    out = {f: np.zeros(len(b) + 1, dtype=np.int64) for f, b in bounds.items()}
    cut = [f for f, b in bounds.items() if len(b)]
    for f in n.keys() - set(cut):
        out[f][0] = n[f]
    if cut:
        found = rows.where(F.col("feature").isin(cut)).groupBy("feature", _cell(bounds).alias("cell")).count().collect()
        for r in found:
            out[r["feature"]][r["cell"]] = r["count"]
    return out


def _read(rows: DataFrame, bounds: dict, counts: dict, ends: dict, cell: dict, wanted: dict) -> dict[int, list[float]]:
    """Sort the cells that hold ranks and pick the values at their places."""
    kept = {f: np.isin(np.arange(len(c)), cell[f]) for f, c in counts.items()}
    places: dict[tuple[int, int], list[int]] = {}
    for f, cells in cell.items():
        for c, rank in zip(cells.tolist(), wanted[f].tolist()):
            places.setdefault((f, c), []).append(int(rank - ends[f][c] + counts[f][c]))
    out: dict[int, list[float]] = {f: [] for f in counts}
    if not places:
        return out
    # At most one row per wanted rank.
    local = rows.sparkSession.createDataFrame([(f, c, p) for (f, c), p in places.items()], "feature int, cell int, places array<int>")
    inside = rows.select("feature", "value", _cell(bounds, kept).alias("cell")).where("cell >= 0")
    ordered = inside.groupBy("feature", "cell").agg(F.sort_array(F.collect_list("value")).alias("sorted"))
    picked = F.transform("places", lambda p: F.element_at("sorted", p)).alias("values")
    for r in sorted(ordered.join(F.broadcast(local), ["feature", "cell"]).select("feature", "cell", picked).collect()):
        out[r["feature"]] += r["values"]
    return out
