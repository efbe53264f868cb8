"""Ranking and calibration metrics, and the reports built on them.

All metrics but precision at k depend only on how many positives and negatives
share a score, so one map-side-combined aggregation shrinks the predictions to
one row per (group, score); running sums over it replace the sorted table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rareboost.functions.hashing import row_hash
from rareboost.functions.losses import EPS, log_loss, positive
from rareboost.functions.joins import null_safe_join
from rareboost.functions.ranking import global_rank, running_sums
from rareboost.session import is_staged, stage

# Metric names, and whether a higher value is better.
HIGHER_IS_BETTER = {
    "auc": True, "prauc": True, "logloss": False, "brier": False, "ece": False, "r1pct": True, "p5pct": True,
}
METRICS = list(HIGHER_IS_BETTER)


def clipped(p: Column, eps: float = EPS) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def score_counts(df: DataFrame, group: list[str], p: str = "p", label: str = "y") -> DataFrame:
    """Positives and negatives per (group, score)."""
    pos = positive(F.col(label))
    return df.groupBy(*group, F.col(p).alias("p")).agg(F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg"))


def ranking_metrics(df: DataFrame, group: list[str], p: str = "p", label: str = "y", fpr: float = 0.01) -> DataFrame:
    """AUC (ties count half), average precision (step sum) and recall at a false-positive rate.

    A group without both classes has NULL metrics.
    """
    return _ranking(score_counts(df, group, p, label), group, fpr)


def _ranking(counts: DataFrame, group: list[str], fpr: float = 0.01) -> DataFrame:
    run = running_sums(counts, [F.col("p").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, group)
    # One row per group; without groups a single row.
    size = run.groupBy(*group).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    both = null_safe_join(run, size, group)
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    P, N = F.nullif(F.col("n_pos"), F.lit(0)), F.nullif(F.col("n_neg"), F.lit(0))
    within = F.when(fp / N <= fpr, tp / P)
    return both.groupBy(*group).agg(
        F.sum(pos * (N - fp + neg / 2) / (P * N)).alias("auc"),
        F.sum(pos / P * tp / (tp + fp)).alias("prauc"),
        F.when(F.max(P * N).isNotNull(), F.coalesce(F.max(within), F.lit(0.0))).alias("r1pct"),
    )


def mean_losses(df: DataFrame, group: list[str], p: str = "p", label: str = "y") -> DataFrame:
    """Log-loss, Brier score, row count and population deviation of the predictions."""
    y, q = F.col(label).cast("double"), F.col(p)
    return df.groupBy(*group).agg(
        F.avg(log_loss(y, q)).alias("logloss"), F.avg((q - y) * (q - y)).alias("brier"),
        F.stddev_pop(q).alias("resolution"), F.count("*").alias("n"),
    )


def equal_width_edges(n_bins: int) -> list[float]:
    return [i * (1.0 / n_bins) for i in range(n_bins + 1)]


def calibration_error(df: DataFrame, group: list[str], p: str = "p", label: str = "y", n_bins: int = 10) -> DataFrame:
    """Expected calibration error over ``[lo, hi)`` bins; a score of 1 lies in none but counts as a row."""
    return _calibration_gap(score_counts(df, group, p, label), group, n_bins)


def _calibration_gap(counts: DataFrame, group: list[str], n_bins: int = 10) -> DataFrame:
    inner = equal_width_edges(n_bins)[1:-1]
    bin_ = reduce(lambda a, b: a + b, [F.when(F.col("p") >= e, 1).otherwise(0) for e in inner], F.lit(0))
    n = F.col("pos") + F.col("neg")
    bins = counts.groupBy(*group, F.when((F.col("p") >= 0) & (F.col("p") < 1), bin_).alias("bin")).agg(
        F.sum(F.col("pos").cast("double")).alias("sy"), F.sum(F.col("p") * n).alias("sp"), F.sum(n).alias("n")
    )
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("sy") - F.col("sp")))
    return bins.groupBy(*group).agg((F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("n")).alias("ece"))


#: Low bits of a row hash that name no cell: tied rows are counted in 1,024 cells first.
CELL_BITS = 46


def precision_at_top(df: DataFrame, group: list[str], share: float = 0.05, p: str = "p", label: str = "y") -> DataFrame:
    """Share of positives among the ``floor(n * share)`` highest scores of every group.

    Ties are broken by row hash. The score at the cut comes from the running
    counts of a group's scores. Rows of that very score are counted by the high bits
    of their hash, and only those of the one cell in which the cut lies are
    numbered, over range blocks; so neither many groups nor a crowd of equal scores
    ends up in one place, and no other row is moved.
    """
    return _precision(df, score_counts(df, group, p, label), group, share, p, label)


def _precision(df: DataFrame, counts: DataFrame, group: list[str], share: float, p: str, label: str) -> DataFrame:
    run = stage(running_sums(counts.withColumn("n", F.col("pos") + F.col("neg")), [F.col("p").desc()], {"upto": F.col("n")}, group))
    size = run.groupBy(*group).agg(F.floor(F.sum("n") * F.lit(share)).alias("k"))
    placed = null_safe_join(run, size, group).where("k > 0")
    above = placed.where("upto <= k").select(*group, "k", F.col("pos").alias("hits"))
    # Staged, so that the planner knows its size: one row per group.
    edge = stage(placed.where("upto > k and upto - n < k").select(*group, "p", "k", (F.col("k") - F.col("upto") + F.col("n")).alias("need")))
    rows = df.select("row_id", *group, F.col(p).alias("p"), F.col(label).cast("double").alias("_y"))
    tied = null_safe_join(rows, edge, [*group, "p"]).withColumn("_h", row_hash("top-tie")).withColumn("_cell", F.shiftright("_h", CELL_BITS))
    cells = stage(tied.groupBy(*group, "_cell").agg(F.count("*").alias("n"), F.sum("_y").alias("hits")))
    met = null_safe_join(running_sums(cells, [F.col("_cell")], {"upto": F.col("n")}, group), edge.select(*group, "k", "need"), group)
    below = met.where("upto <= need").select(*group, "k", "hits")
    cut = stage(met.where("upto > need and upto - n < need").select(*group, "_cell", (F.col("need") - F.col("upto") + F.col("n")).alias("_take")))
    last = stage(null_safe_join(tied, cut, [*group, "_cell"]).select("row_id", *group, "k", "_y", "_h", "_take"))
    drawn = running_sums(last, [F.col("_h"), F.col("row_id")], {"_r": F.lit(1)}, group).where("_r <= _take")
    hits = above.unionByName(below).unionByName(drawn.select(*group, "k", F.col("_y").alias("hits")))
    return hits.groupBy(*group).agg((F.sum("hits") / F.max("k")).alias("p5pct"))


def evaluate(df: DataFrame, group: list[str], p: str = "p", label: str = "y") -> DataFrame:
    """Seven metrics per group of scores clipped to [1e-7, 1 - 1e-7]. A staged table is read where it lies."""
    df = df if is_staged(df) else stage(df.select("row_id", *group, p, label))
    raw = stage(score_counts(df, group, p, label))
    counts = raw.groupBy(*group, clipped(F.col("p")).alias("p")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    q, pos, neg = F.col("p"), F.col("pos"), F.col("neg")
    losses = counts.groupBy(*group).agg(
        (F.sum(-pos * F.ln(q) - neg * F.ln(1.0 - q)) / F.sum(pos + neg)).alias("logloss"),
        (F.sum(pos * (1.0 - q) * (1.0 - q) + neg * q * q) / F.sum(pos + neg)).alias("brier"),
    )
    # Every part has one row per group. Clipping does not change the order of scores.
    parts = [losses, _calibration_gap(counts, group), _precision(df, raw, group, 0.05, p, label)]
    return reduce(lambda a, b: null_safe_join(a, b, group, "left"), parts, _ranking(counts, group)).select(*group, *METRICS)


def over_seeds(records: DataFrame, model: str = "model") -> DataFrame:
    """Mean and population deviation of every metric over the seeds of a model."""
    aggs = [f(m).alias(f"{m}_{s}") for m in METRICS for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return records.groupBy(model).agg(*aggs)


def _long(records: DataFrame, *ids: str) -> DataFrame:
    higher = F.create_map(*[F.lit(x) for kv in HIGHER_IS_BETTER.items() for x in kv])
    return records.unpivot(list(ids), METRICS, "metric", "value").withColumn("higher", higher[F.col("metric")])


def win_counts(records: DataFrame, reference: str, model: str = "model", tolerance: float = 1e-5) -> DataFrame:
    """Metrics on which a model beats the reference model by more than ``tolerance``."""
    long = _long(records, model)
    ref = long.where(F.col(model) == reference).select("metric", F.col("value").alias("r"))
    beats = F.when(F.col("higher"), F.col("value") > F.col("r") + tolerance).otherwise(F.col("value") < F.col("r") - tolerance)
    return long.where(F.col(model) != reference).join(ref, "metric").groupBy(model).agg(F.count_if(beats).alias("wins"))


def family_lift(records: DataFrame, family: Column, base: str, model: str = "model") -> DataFrame:
    """Best model of each family by AUC, and its lift in percent over the best of ``base``.

    The lift is signed so that positive is better; it is 0 where the base is 0.
    """
    best = records.withColumn("family", family).groupBy("family").agg(
        F.max_by(F.struct(model, *METRICS), F.struct("auc", model)).alias("b")
    ).select("family", "b.*")
    long = _long(best, "family", model)
    ref = long.where(F.col("family") == base).select("metric", F.col("value").alias("base_value"))
    change = F.when(F.col("base_value") == 0, 0.0).otherwise(100.0 * (F.col("value") - F.col("base_value")) / F.nullif(F.col("base_value"), F.lit(0.0)))
    return long.where(F.col("family") != base).join(ref, "metric").select(
        "family", model, "metric", "value", "base_value", F.when(F.col("higher"), change).otherwise(-change).alias("lift_pct")
    )


def best_markers(records: DataFrame, model: str = "model") -> DataFrame:
    """Every (model, metric) with a flag for the best value of the metric."""
    long = _long(records, model)
    w = Window.partitionBy("metric")
    best = F.when(F.col("higher"), F.max("value").over(w)).otherwise(F.min("value").over(w))
    return long.select(model, "metric", "value", (F.abs(F.col("value") - best) < 1e-9).alias("is_best"))


def rank_normalised(ranking: DataFrame, values: DataFrame, name: str = "p") -> DataFrame:
    """Give the k-th lowest row of ``ranking`` the k-th lowest value of ``values``.

    Both have ``row_id`` and ``p``; equal scores are ordered by row hash. The two
    global ranks meet in an equi-join.
    """
    order = [F.col("p"), F.col("_h"), F.col("row_id")]
    hashed = lambda df: df.select("row_id", "p", row_hash("rank-tie").alias("_h"))
    a = global_rank(hashed(ranking), order).select("row_id", "rank")
    b = global_rank(hashed(values), order).select(F.col("p").alias(name), "rank")
    return a.join(b, "rank").select("row_id", name)
