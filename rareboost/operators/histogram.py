"""Gradient histograms and split search as aggregations and windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rareboost.functions.losses import positive
from rareboost.operators.binning import MAX_BINS, feature_codes

MEASURES = ["sum_g", "sum_h", "cnt", "sum_g_pos", "sum_h_pos", "cnt_pos"]


def build(rows: DataFrame, n_features: int, only: list[int] | None = None) -> DataFrame:
    """Histogram cells ``(node, feature, bin)`` of rows with ``node, codes, g, h, ipc_w, y``.

    Gradients are weighted, counts are not. Node, feature and bin share one long
    key, so the map-side hash aggregation stays primitive; the shuffle carries at
    most nodes x features x bins cells per task, however many rows there are.
    """
    width = n_features * MAX_BINS
    pos = positive(F.col("y"))
    cells = rows.select(
        F.col("node").cast("long").alias("node"),
        (F.col("g") * F.col("ipc_w")).alias("gw"),
        (F.col("h") * F.col("ipc_w")).alias("hw"),
        pos.alias("pos"),
        feature_codes(only=only).alias("code"),
    ).groupBy((F.col("node") * width + F.col("code")).alias("cell"))
    out = cells.agg(
        F.sum("gw").alias("sum_g"),
        F.sum("hw").alias("sum_h"),
        F.count("*").alias("cnt"),
        F.sum(F.when(F.col("pos"), F.col("gw")).otherwise(0.0)).alias("sum_g_pos"),
        F.sum(F.when(F.col("pos"), F.col("hw")).otherwise(0.0)).alias("sum_h_pos"),
        F.count_if("pos").alias("cnt_pos"),
    )
    code = F.pmod("cell", F.lit(width))
    return out.select(
        F.floor(F.col("cell") / width).cast("int").alias("node"),
        F.floor(code / MAX_BINS).cast("int").alias("feature"),
        F.pmod(code, F.lit(MAX_BINS)).cast("int").alias("bin"),
        *MEASURES,
    )


def totals(cells: DataFrame) -> DataFrame:
    """Per (node, feature) totals; identical for every feature of a node up to rounding."""
    return cells.groupBy("node", "feature").agg(*[F.sum(m).alias(m) for m in MEASURES])


def complement(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Cells of the other child: parent minus child, matched on (feature, bin)."""
    keys = ["feature", "bin"]
    c = child.select(*keys, *[F.col(m).alias(f"c_{m}") for m in MEASURES])
    return parent.join(c, keys, "left").select(
        *keys, *[(F.col(m) - F.coalesce(F.col(f"c_{m}"), F.lit(0))).alias(m) for m in MEASURES]
    )


class Splitter(Protocol):
    """Turns the histogram cells of a level into one best split per node.

    A splitter that also has ``chooser(lam, min_child_weight)`` is asked inside the
    tasks, one (node, feature) histogram at a time.
    """

    def best(self, cells: DataFrame, lam: float, min_child_weight: float) -> DataFrame: ...


def candidates(cells: DataFrame, lam: float, min_child_weight: float) -> DataFrame:
    """Every admissible cut of every (node, feature): both sides' sums, gain and purity.

    The window holds at most 256 bins, never rows of the table. Empty bins have
    no cell; they could only repeat the cut before them, which wins the tie.
    """
    # One SQL text is planned once per level; a chain of small projections is analysed step by step.
    # Partitioning by node serves the windows and the choice per node with one small shuffle.
    return cells.sparkSession.sql(
        """
        SELECT node, feature, bin, gl, hl, nl, pl, gr, hr, nr, pr,
          gl * gl / (hl + :lam) + gr * gr / (hr + :lam) - (gl + gr) * (gl + gr) / (hl + hr + :lam) AS gain,
          abs(CASE WHEN nl > 0 THEN pl / nl ELSE 0D END - CASE WHEN nr > 0 THEN pr / nr ELSE 0D END) AS purity
        FROM (
          SELECT *, gt - gl AS gr, ht - hl AS hr, nt - nl AS nr, pt - pl AS pr FROM (
            SELECT node, feature, bin,
              sum(sum_g) OVER upto AS gl, sum(sum_h) OVER upto AS hl, sum(cnt) OVER upto AS nl, sum(cnt_pos) OVER upto AS pl,
              sum(sum_g) OVER all_bins AS gt, sum(sum_h) OVER all_bins AS ht, sum(cnt) OVER all_bins AS nt, sum(cnt_pos) OVER all_bins AS pt
            FROM {cells}
            WINDOW all_bins AS (PARTITION BY node, feature),
              upto AS (PARTITION BY node, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
        WHERE hl >= :mcw AND hr >= :mcw AND nl > 0 AND nr > 0
        """,
        args={"lam": float(lam), "mcw": float(min_child_weight)},
        cells=cells.repartition("node"),
    )


@dataclass(frozen=True)
class GainSplitter:
    """Largest Newton gain plus ``purity_weight`` times the gap in positive rates.

    Scores are compared at nine decimals, then the lowest feature, then the
    lowest bin wins, so the choice does not hang on the order of summation.
    ``min_positives`` is stored without effect unless ``enforce_min_positives``.
    """

    purity_weight: float = 0.0
    min_positives: int = 0
    enforce_min_positives: bool = False

    def chooser(self, lam: float, min_child_weight: float) -> Callable[[np.ndarray], tuple | None]:
        """The same choice on one (node, feature) histogram as an array, for growth."""
        from rareboost.operators.levels import best_cut

        return partial(best_cut, **self._terms(lam, min_child_weight))

    def cutter(self, lam: float, min_child_weight: float) -> Callable[[np.ndarray], tuple]:
        """The same choice on many histograms at once."""
        from rareboost.operators.levels import best_cuts

        return partial(best_cuts, **self._terms(lam, min_child_weight))

    def _terms(self, lam: float, min_child_weight: float) -> dict:
        least = self.min_positives if self.enforce_min_positives else 0
        return {"lam": lam, "min_child_weight": min_child_weight, "purity_weight": self.purity_weight, "min_positives": least}

    def best(self, cells: DataFrame, lam: float, min_child_weight: float) -> DataFrame:
        cand = candidates(cells, lam, min_child_weight)
        if self.enforce_min_positives:
            cand = cand.where((F.col("pl") >= self.min_positives) & (F.col("pr") >= self.min_positives))
        return cand.sparkSession.sql(
            """
            SELECT node, r.* FROM (
              SELECT node, max_by(
                  struct(feature, bin, gain, purity, score, gl, hl, nl, pl, gr, hr, nr, pr),
                  struct(round(score, 9) AS s, -feature AS f, -bin AS b)) AS r
              FROM (SELECT *, gain + :weight * purity AS score FROM {cand})
              WHERE score > 0 GROUP BY node)
            """,
            args={"weight": float(self.purity_weight)},
            cand=cand,
        )


def weighted_sums(rows: DataFrame) -> DataFrame:
    """Root sums of weighted gradients and hessians, and the number of drawn rows."""
    return rows.agg(
        F.sum(F.col("g") * F.col("ipc_w")).alias("sum_g"),
        F.sum(F.col("h") * F.col("ipc_w")).alias("sum_h"),
        F.count("*").alias("cnt"),
    )


def leaf_value(g: Column, h: Column, lam: float) -> Column:
    return -g / (h + lam)
