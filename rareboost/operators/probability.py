"""Isotonic, Platt and positive-unlabeled probability maps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from rareboost.functions.losses import positive, sigmoid
from rareboost.functions.ranking import global_rank
from rareboost.functions.selection import order_cuts
from rareboost.session import Scratch, is_staged, stage

# Scores this close are one point; interpolation guard; floor of the label rate.
SAME = 1e-9
GAP = 1e-9
RATE_FLOOR = 1e-3


def pool_scores(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """One row per distinct score: mean label and row count."""
    return df.groupBy(F.round(score, 9).alias("_k")).agg(
        F.min(score).alias("score"), F.avg(F.col(label).cast("double")).alias("y"), F.count("*").cast("double").alias("w")
    ).drop("_k")


def isotonic_blocks(points: DataFrame) -> list[tuple[float, float, float]]:
    """Non-decreasing fit of unique points ``(score, y, w)`` as ``(first, last, value)`` blocks.

    Spark pools violators inside range partitions before the blocks reach the
    driver; the answer, which the model stores, is those blocks.
    """
    if points.isEmpty():
        return []
    fitted = IsotonicRegression(featuresCol="score", labelCol="y", weightCol="w").fit(points)
    blocks: list[tuple[float, float, float]] = []
    for x, p in zip(np.asarray(fitted.boundaries.toArray()), np.asarray(fitted.predictions.toArray())):
        p = min(max(float(p), 0.0), 1.0)
        if blocks and abs(p - blocks[-1][2]) < SAME:
            blocks[-1] = (blocks[-1][0], float(x), blocks[-1][2])
        else:
            blocks.append((float(x), float(x), p))
    return blocks


def isotonic_fit(points: DataFrame) -> DataFrame:
    """Add the fitted value to every point; points of a block share its value."""
    points = points if is_staged(points) else stage(points)
    blocks = isotonic_blocks(points)
    return points.withColumn("fitted", _step([b[0] for b in blocks], [b[2] for b in blocks])(F.col("score")))


def _step(starts: list[float], values: list[float]):
    xs, ys = np.asarray(starts), np.asarray(values)

    def look_up(score: pa.Array) -> pa.Array:
        at = np.searchsorted(xs, score.to_numpy(zero_copy_only=False), side="right") - 1
        return pa.array(ys[np.maximum(at, 0)])

    return F.arrow_udf(look_up, "double")


def isotonic_breakpoints(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """Breakpoints ``(seq, score, prob)``: first, middle and last score of every block."""
    points = pool_scores(df, score, label)
    spark = df.sparkSession
    with Scratch() as scratch:
        points = scratch.keep(points)
        blocks = isotonic_blocks(points)
        schema = "block int, first double, last double, prob double"
        ends = spark.createDataFrame([(i, *b) for i, b in enumerate(blocks)], schema)
        ranked = global_rank(points.select("score"), [F.col("score")])
    at = lambda name: ranked.select(F.col("score").alias(name), F.col("rank").alias(f"r_{name}"))
    spans = ends.join(at("first"), "first").join(at("last"), "last")
    middle = F.floor((F.col("r_first") + F.col("r_last")) / 2)
    wanted = F.when(F.col("r_last") > F.col("r_first"), F.array("r_first", middle, "r_last")).otherwise(F.array("r_first"))
    places = spans.select("block", "prob", F.posexplode(wanted).alias("part", "rank"))
    return places.join(ranked, "rank").select((F.col("block") * 3 + F.col("part")).alias("seq"), "score", "prob")


def collect_breakpoints(breakpoints: DataFrame) -> list[tuple[float, float]]:
    return [(r["score"], r["prob"]) for r in breakpoints.orderBy("seq").collect()]


def isotonic_apply(raw: Column, breakpoints: list[tuple[float, float]]) -> Column:
    """Piecewise-linear map with constant ends; the sigmoid when there is no map."""
    if not breakpoints:
        return sigmoid(raw)
    xs = np.asarray([b[0] for b in breakpoints])
    ys = np.asarray([b[1] for b in breakpoints])

    def interpolate(score: pa.Array) -> pa.Array:
        v = score.to_numpy(zero_copy_only=False)
        hi = np.clip(np.searchsorted(xs, v, side="left"), 1 if len(xs) > 1 else 0, len(xs) - 1)
        lo = np.maximum(hi - 1, 0)
        t = (v - xs[lo]) / (xs[hi] - xs[lo] + GAP)
        p = np.clip(ys[lo] + t * (ys[hi] - ys[lo]), 0.0, 1.0)
        return pa.array(np.where(v <= xs[0], ys[0], np.where(v >= xs[-1], ys[-1], p)))

    return F.arrow_udf(interpolate, "double")(raw)


def platt_fit(
    df: DataFrame, score: str = "score", label: str = "y", max_iter: int = 50, smooth: bool = True
) -> tuple[float, float]:
    """Slope and offset minimising the log-loss of ``sigmoid(a * score + b)``.

    Newton steps on two parameters: each is one pass that returns five sums.
    ``smooth`` uses Platt's softened targets, otherwise the labels themselves.
    """
    pos = positive(F.col(label))
    with Scratch() as scratch:
        rows = scratch.keep(df.select(F.col(score).cast("double").alias("s"), pos.alias("pos")))
        size = rows.agg(F.count("*").alias("n"), F.count_if("pos").alias("p")).collect()[0]
        if size["n"] == 0:
            return 1.0, 0.0
        hi, lo = ((size["p"] + 1.0) / (size["p"] + 2.0), 1.0 / (size["n"] - size["p"] + 2.0)) if smooth else (1.0, 0.0)
        target = F.when(F.col("pos"), hi).otherwise(lo)
        a, b = 1.0, 0.0
        for _ in range(max_iter):
            p = sigmoid(F.lit(a) * F.col("s") + F.lit(b))
            err, pq, s = p - target, p * (1.0 - p), F.col("s")
            g_a, g_b, h_aa, h_ab, h_bb = rows.agg(
                F.sum(err * s), F.sum(err), F.sum(pq * s * s), F.sum(pq * s), F.sum(pq)
            ).collect()[0]
            hessian = np.array([[h_aa + 1e-9, h_ab], [h_ab, h_bb + 1e-9]])
            if abs(np.linalg.det(hessian)) < 1e-18:
                break
            da, db = -np.linalg.solve(hessian, [g_a, g_b])
            a, b = a + float(da), b + float(db)
            if abs(da) < 1e-7 and abs(db) < 1e-7:
                break
    return a, b


def platt_apply(raw: Column, a: float, b: float) -> Column:
    return sigmoid(F.lit(a) * raw + F.lit(b))


def pu_label_rate(df: DataFrame, estimator: str = "mean", score: str = "score", label: str = "y") -> float:
    """Share of true positives that carry a label, from scores of the labelled ones.

    ``mean``, ``max`` or ``median`` (upper median); 1 without labelled rows.
    """
    labelled = df.where(positive(F.col(label)))
    if estimator == "median":
        cuts = order_cuts(labelled, F.col(score).cast("double"), lambda n: [n // 2 + 1])[None]
        c = next(iter(cuts.values())).value if cuts else None
    elif estimator in ("mean", "max"):
        c = labelled.agg({"mean": F.avg, "max": F.max}[estimator](score)).collect()[0][0]
    else:
        raise ValueError("estimator must be mean, max or median")
    return min(max(float(c), RATE_FLOOR), 1.0) if c is not None else 1.0


def pu_correct(p: Column, c: Column | float) -> Column:
    c = c if isinstance(c, Column) else F.lit(c)
    return F.least(F.greatest(p / F.greatest(c, F.lit(RATE_FLOOR)), F.lit(0.0)), F.lit(1.0))
