"""One level of tree growth: histograms of the smaller children, the larger ones by subtraction.

Tasks sum their rows with numpy and send one row per (node, feature), of non-empty
bins only. A group of the shuffle holds these parts of a parent's smaller child
and the parent's own cells from the level before; the larger child is the
difference, so its rows are never read. Both children's cells stay cached for the
next level, and one small record per (node, feature) returns to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rareboost.functions.losses import positive
from rareboost.operators.binning import MAX_BINS
from rareboost.operators.histogram import MEASURES

#: Parts, each at most 12 kB, that one task merges.
PARTS_A_TASK = 512
_CELLS = "node int, feature int, bins binary, sums binary"
_PARTS = "parent int, part boolean, feature int, bins binary, sums binary"
_RECORD = ["bin", "score", "gl", "hl", "nl", "gr", "hr", "nr", "g", "h", "n"]
_RECORDS = "bin int, score double, gl double, hl double, nl long, gr double, hr double, nr long, g double, h double, n long"
_COUNT, _POSITIVES = MEASURES.index("cnt"), MEASURES.index("cnt_pos")


@dataclass(frozen=True)
class Routing:
    """Nodes as arrays: the code at which a node splits (negative: it does not) and its left child."""

    cut: np.ndarray
    left: np.ndarray
    depth: int

    @classmethod
    def of(cls, nodes: list, depth: int) -> "Routing":
        cut = [n.feature * MAX_BINS + n.split_bin if n.feature >= 0 else -1 for n in nodes]
        return cls(np.array(cut, np.int32), np.array([n.left for n in nodes], np.int32), depth)

    def position(self, bins: np.ndarray) -> np.ndarray:
        """Node that every row of ``bins`` reaches."""
        at = np.zeros(len(bins), np.int32)
        row = np.arange(len(bins))
        for _ in range(self.depth if bins.size else 0):
            cut = self.cut[at]
            beyond = bins[row, cut >> 8] > (cut & (MAX_BINS - 1))
            at = np.where(cut >= 0, self.left[at] + beyond, at)
        return at


def bin_matrix(column: pa.Array) -> np.ndarray:
    """The bins of a batch, one row each, from packed bytes or from ``codes`` arrays."""
    n = len(column)
    if pa.types.is_binary(column.type):
        start, end = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4)[[0, -1]] if n else (0, 0)
        flat = np.frombuffer(column.buffers()[2], np.uint8, end - start, start) if end > start else np.empty(0, np.uint8)
    else:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
    return flat.reshape(n, len(flat) // max(n, 1))


@dataclass(frozen=True)
class Children:
    """The child of a parent whose rows are read, and the one that follows by subtraction (-1: none)."""

    parent: int
    read: int
    other: int


def _packed(cells: np.ndarray) -> tuple[bytes, bytes]:
    """Non-empty bins and their measures."""
    bins = np.flatnonzero(cells[:, _COUNT])
    return bins.astype(np.uint8).tobytes(), np.ascontiguousarray(cells[bins]).tobytes()


def _add(cells: np.ndarray, bins: bytes, sums: bytes) -> None:
    cells[np.frombuffer(bins, np.uint8)] += np.frombuffer(sums, np.float64).reshape(-1, len(MEASURES))


def task_sums(routing: Routing, plan: list[Children], features: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of a task's rows that lie in the children to be read."""
    slot_of = np.full(len(routing.cut), -1, np.int64)
    for slot, c in enumerate(plan):
        slot_of[c.read] = slot
    names = [f.split()[0] for f in _PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(plan) * MAX_BINS
        sums = np.zeros((len(features), len(MEASURES), size))
        for batch in batches:
            binned = bin_matrix(batch.column(0))
            slot = slot_of[routing.position(binned)]
            inside = np.flatnonzero(slot >= 0)
            g, h, pos = (batch.column(k).to_numpy(zero_copy_only=False)[inside] for k in (1, 2, 3))
            base, rare = slot[inside] * MAX_BINS, np.flatnonzero(pos)
            for k, f in enumerate(features):
                at = base + binned[inside, f]
                few = at[rare]
                weighted = [(at, g), (at, h), (at, None), (few, g[rare]), (few, h[rare]), (few, None)]
                for m, (where, weight) in enumerate(weighted):
                    sums[k, m] += np.bincount(where, weight, size)
        for slot, c in enumerate(plan):
            rows = []
            for k, f in enumerate(features):
                cells = sums[k, :, slot * MAX_BINS : (slot + 1) * MAX_BINS].T
                if cells[:, _COUNT].any():
                    rows.append((c.parent, True, f, *_packed(cells)))
            if rows:
                types = [pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    return run


def merge(plan: list[Children], choose: Callable[[np.ndarray], tuple | None] | None) -> Callable:
    """Cells, totals and best cut of both children of a parent, for one feature; the parts are added as they stream in."""
    by_parent = {c.parent: c for c in plan}
    names = [f.split()[0] for f in f"{_CELLS}, {_RECORDS}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, whole = np.zeros((MAX_BINS, len(MEASURES))), np.zeros((MAX_BINS, len(MEASURES)))
        for batch in batches:
            for parent, part, feature, bins, sums in zip(*(c.to_pylist() for c in batch.columns)):
                _add(read if part else whole, bins, sums)
        children = by_parent[parent]
        out = []
        for node, cells in ((children.read, read), (children.other, whole - read)):
            if node < 0 or not cells[:, _COUNT].any():
                continue
            # What subtraction leaves in an emptied bin is rounding, not rows.
            cells[cells[:, _COUNT] == 0] = 0.0
            total = cells.sum(axis=0)
            cut = choose(cells) if choose else None
            totals = (float(total[0]), float(total[1]), int(total[_COUNT]))
            out.append((node, feature, *_packed(cells), *(cut or (None,) * 8), *totals))
        columns = zip(*out) if out else [[]] * len(names)
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.float64()]
        types += [pa.float64(), pa.float64(), pa.int64()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def best_cut(
    cells: np.ndarray, lam: float, min_child_weight: float, purity_weight: float = 0.0, min_positives: int = 0
) -> tuple[int, float, float, float, int, float, float, int] | None:
    """``(bin, score, gl, hl, nl, gr, hr, nr)`` of the best cut of one histogram; of equal scores the lowest bin."""
    bin_, score, sides = best_cuts(cells[None][..., [0, 1, _COUNT, _POSITIVES]], lam, min_child_weight, purity_weight, min_positives)
    if bin_[0] < 0:
        return None
    gl, hl, nl, gr, hr, nr = (side[0] for side in sides)
    return int(bin_[0]), float(score[0]), float(gl), float(hl), int(nl), float(gr), float(hr), int(nr)


def best_cuts(
    cells: np.ndarray, lam: float, min_child_weight: float, purity_weight: float = 0.0, min_positives: int = 0
) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Bin (-1: no cut), score and ``(gl, hl, nl, gr, hr, nr)`` of the best cut of many histograms ``(bin, (g, h, n, positives))``."""
    upto = cells.cumsum(axis=1)
    left, right = upto[:, :-1], upto[:, -1:] - upto[:, :-1]
    (gl, hl, nl, pl), (gr, hr, nr, pr) = (np.moveaxis(side, 2, 0) for side in (left, right))
    ok = (hl >= min_child_weight) & (hr >= min_child_weight) & (nl > 0) & (nr > 0) & (pl >= min_positives) & (pr >= min_positives)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / (hl + lam) + gr * gr / (hr + lam) - (gl + gr) ** 2 / (hl + hr + lam)
        score = gain + purity_weight * np.abs(pl / np.maximum(nl, 1) - pr / np.maximum(nr, 1))
    score = np.where(ok & (score > 0), np.round(score, 9), -np.inf)
    best = score.argmax(axis=1)
    at = lambda m: np.take_along_axis(m, best[:, None], 1)[:, 0]
    top = at(score)
    return np.where(top > -np.inf, best, -1), top, tuple(at(m) for m in (gl, hl, nl, gr, hr, nr))


def level_cells(
    rows: DataFrame, before: DataFrame | None, routing: Routing, plan: list[Children], features: list[int],
    choose: Callable[[np.ndarray], tuple | None] | None, tasks: int | None = None,
) -> DataFrame:
    """Cells and records of a level from rows with ``codes, y, g, h, ipc_w`` and the level before.

    With the number of ``tasks`` that send parts known, the parts are dealt to as few
    merging tasks as get ``PARTS_A_TASK`` parts each.
    """
    weighted = rows.select(
        "codes", (F.col("g") * F.col("ipc_w")).alias("g"), (F.col("h") * F.col("ipc_w")).alias("h"),
        F.coalesce(positive(F.col("y")), F.lit(False)).alias("pos"),
    )
    parts = weighted.mapInArrow(task_sums(routing, plan, features), _PARTS)
    if before is not None:
        parents = [c.parent for c in plan]
        own = before.where(F.col("node").isin(parents)).select(F.col("node").alias("parent"), F.lit(False).alias("part"), "feature", "bins", "sums")
        parts = parts.unionByName(own)
    if tasks is not None:
        groups = len(plan) * len(features)
        parts = parts.repartition(min(groups, -(-groups * tasks // PARTS_A_TASK)), "parent", "feature")
    return parts.groupBy("parent", "feature").applyInArrow(merge(plan, choose), f"{_CELLS}, {_RECORDS}")


def records(level: DataFrame) -> list:
    """One record per (node, feature): at most 2^depth times the features."""
    return level.select("node", "feature", *_RECORD).collect()


def as_cells(level: DataFrame) -> DataFrame:
    """The histogram cells ``(node, feature, bin)`` with their measures, for splitters that work on tables."""
    schema = "node int, feature int, bin int, " + ", ".join(f"{m} {'long' if m.startswith('cnt') else 'double'}" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, feature, bins, sums in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.frombuffer(bins, np.uint8).astype(np.int32)
                m = np.frombuffer(sums, np.float64).reshape(-1, len(MEASURES))
                columns = [np.full(len(at), node, np.int32), np.full(len(at), feature, np.int32), at]
                columns += [m[:, i].astype(np.int64) if x.startswith("cnt") else m[:, i].copy() for i, x in enumerate(MEASURES)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "feature", "bin", *MEASURES])

    return level.select("node", "feature", "bins", "sums").mapInArrow(run, schema)
