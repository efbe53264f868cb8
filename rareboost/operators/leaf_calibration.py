"""Out-of-fold leaf values and probabilities of one tree.

Input rows carry ``leaf, fold, g, h, y`` for the whole table, not the sample.
After the first aggregation everything is leaves x folds in size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from rareboost.functions.losses import positive

# Pseudo-rows of the prior in a leaf's rate, and bounds of the prior.
PRIOR_ROWS = 10.0
PRIOR_FLOOR = 1e-4


def clamp_prior(prior: float) -> float:
    return min(max(prior, PRIOR_FLOOR), 1.0 - PRIOR_FLOOR)


def fold_statistics(rows: DataFrame) -> DataFrame:
    """Per (leaf, fold): gradient sums of the other folds, rows and positives of this one.

    The other folds are the leaf's total minus its own fold, so every row is
    aggregated once, not once per fold.
    """
    own = rows.groupBy("leaf", "fold").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"), F.count_if(positive(F.col("y"))).alias("n_pos")
    )
    leaf = Window.partitionBy("leaf")
    seen_elsewhere = F.sum("n").over(leaf) > F.col("n")
    others = {m: F.when(seen_elsewhere, F.sum(m).over(leaf) - F.col(m)).otherwise(F.lit(0.0)) for m in ("g", "h")}
    return own.select("leaf", "fold", others["g"].alias("sum_g"), others["h"].alias("sum_h"), "n", "n_pos")


def fold_values(stats: DataFrame, lam: float, prior: Column | float) -> DataFrame:
    """Add the Newton value learned without the fold and the fold's smoothed rate.

    A (leaf, fold) whose leaf occurs in no other fold has value 0 and is not ``usable``.
    """
    prior = prior if isinstance(prior, Column) else F.lit(prior)
    usable = F.col("sum_h") > 0
    return stats.select(
        "*",
        usable.alias("usable"),
        F.when(usable, -F.col("sum_g") / (F.col("sum_h") + lam)).otherwise(F.lit(0.0)).alias("value"),
        ((F.col("n_pos") + prior * PRIOR_ROWS) / (F.col("n") + PRIOR_ROWS)).alias("rate"),
    )


def calibrated_leaves(values: DataFrame) -> DataFrame:
    """Per leaf: mean out-of-fold value and calibrated probability.

    The at most K (value, rate) pairs of a leaf are made monotone by the max-min
    form of isotonic regression; the pair nearest the mean value gives the
    probability. Leaves with no usable fold are absent.
    """
    pair = F.struct(F.col("value").alias("v"), "fold", F.col("rate").alias("r"), F.col("n").cast("double").alias("w"))
    leaves = values.where("usable").groupBy("leaf").agg(
        F.sort_array(F.collect_list(pair)).alias("pairs"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"),
    )
    gaps = F.transform("pairs", lambda p: F.abs(p["v"] - F.col("value")))
    nearest = leaves.withColumn("i", F.array_position(gaps, F.array_min(gaps)).cast("int"))

    def mean_of(j: Column, k: Column) -> Column:
        part = F.slice(F.col("pairs"), j, k - j + 1)
        total = F.aggregate(part, F.lit(0.0), lambda a, p: a + p["r"] * p["w"])
        return total / F.aggregate(part, F.lit(0.0), lambda a, p: a + p["w"])

    lowest = lambda j: F.array_min(F.transform(F.sequence(F.col("i"), F.size("pairs")), lambda k: mean_of(j, k)))
    fitted = F.array_max(F.transform(F.sequence(F.lit(1), F.col("i")), lowest))
    return nearest.select("leaf", "value", F.least(F.greatest(fitted, F.lit(0.0)), F.lit(1.0)).alias("prob"))


def calibrate_arrays(tree, sums: np.ndarray, lam: float, prior: float) -> list[list[float]]:
    """The same from sums ``(g, h, n, n_pos)`` per leaf and fold, set on the tree; returns the value of every (leaf, fold)."""
    g, h, n, n_pos = sums
    elsewhere = n.sum(axis=1, keepdims=True) > n
    g, h = (np.where(elsewhere, m.sum(axis=1, keepdims=True) - m, 0.0) for m in (g, h))
    usable = (n > 0) & (h > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(usable, -g / (h + lam), 0.0)
    rate = (n_pos + prior * PRIOR_ROWS) / (n + PRIOR_ROWS)
    for leaf in np.flatnonzero(usable.any(axis=1)).tolist():
        folds = np.flatnonzero(usable[leaf])
        folds = folds[np.argsort(value[leaf, folds], kind="stable")]
        v, r, w = value[leaf, folds], rate[leaf, folds], n[leaf, folds]
        mean = float((v * w).sum() / w.sum())
        i = int(np.abs(v - mean).argmin())
        of = lambda j, k: (r[j : k + 1] * w[j : k + 1]).sum() / w[j : k + 1].sum()
        fitted = max(min(of(j, k) for k in range(i, len(v))) for j in range(i + 1))
        tree.leaf_values[leaf], tree.leaf_probs[leaf] = mean, float(min(max(fitted, 0.0), 1.0))
    return np.where(n > 0, value, np.array(tree.leaf_values)[:, None]).tolist()


def row_values(rows: DataFrame, values: DataFrame, leaves: DataFrame) -> DataFrame:
    """Add ``oof_value``: the leaf value learned without the row's own fold.

    A (fold, leaf) without rows falls back to the leaf's own value. Both tables
    have at most leaves x folds rows.
    """
    per_fold = F.broadcast(values.select("leaf", "fold", F.col("value").alias("_v")))
    per_leaf = F.broadcast(leaves.select("leaf", F.col("value").alias("_l")))
    return (
        rows.join(per_fold, ["leaf", "fold"], "left").join(per_leaf, "leaf", "left")
        .withColumn("oof_value", F.coalesce("_v", "_l")).drop("_v", "_l")
    )
