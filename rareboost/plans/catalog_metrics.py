"""Evaluation metrics, reports and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareboost.operators import metrics, posthoc
from rareboost.operators.folds import shuffled_folds, stratified_holdout
from rareboost.plans.fixtures import (
    FEATURES, LINES_SQL, ONE_MODEL_SQL, PREDICTIONS_SQL, hash_sql, one_model, predictions, staged_lines, staged_predictions,
)
from rareboost.plans.models import DEMO_RAW
from rareboost.plans.oracles import isotonic_apply_sql, isotonic_sql, stack_sql
from rareboost.plans.registry import query
from rareboost.session import as_staged, stage

GROUP = ["model", "seed"]


def _digits(name: str) -> int:
    """Few enough that sums of two-decimal scores do not end on a rounding tie."""
    return 4 if name.startswith("ece") or name in ("value", "base_value", "lift_pct") else 5


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, _digits(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Curves of every (model, seed): scores in descending order with running counts.
_CURVE = f"""{PREDICTIONS_SQL},
clip AS MATERIALIZED (SELECT row_id, model, seed, y, least(greatest(p, 1e-7), 1 - 1e-7) AS p FROM preds),
curve AS MATERIALIZED (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER g AS np, sum(neg) OVER g AS nn FROM (
    SELECT model, seed, p, count(*) FILTER (y > 0.5) AS pos, count(*) FILTER (y <= 0.5) AS neg FROM clip GROUP BY model, seed, p)
  WINDOW g AS (PARTITION BY model, seed), w AS (PARTITION BY model, seed ORDER BY p DESC)),
ranked AS MATERIALIZED (
  SELECT model, seed, sum(pos * (nn - fp + neg / 2e0)) / (max(np) * CAST(max(nn) AS DOUBLE)) AS auc,
    sum(pos / CAST(np AS DOUBLE) * tp / CAST(tp + fp AS DOUBLE)) AS prauc,
    coalesce(max(CASE WHEN fp / CAST(nn AS DOUBLE) <= 0.01e0 THEN tp / CAST(np AS DOUBLE) END), 0) AS r1pct
  FROM curve GROUP BY model, seed),
losses AS MATERIALIZED (
  SELECT model, seed, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS logloss, avg((p - y) * (p - y)) AS brier, stddev_pop(p) AS resolution
  FROM clip GROUP BY model, seed),
ece AS MATERIALIZED (
  SELECT model, seed, sum(CASE WHEN bin IS NULL THEN 0 ELSE abs(sy - sp) END) / sum(n) AS ece FROM (
    SELECT model, seed, CASE WHEN p >= 0 AND p < 1 THEN {' + '.join(f'CAST(p >= {e!r}::DOUBLE AS INTEGER)' for e in metrics.equal_width_edges(10)[1:-1])} END AS bin,
      sum(y) AS sy, sum(p) AS sp, count(*) AS n FROM clip GROUP BY ALL) GROUP BY model, seed),
topk AS MATERIALIZED (
  SELECT model, seed, avg(y) AS p5pct FROM (
    SELECT *, row_number() OVER (PARTITION BY model, seed ORDER BY p DESC, {hash_sql('top-tie')}, row_id) AS rn,
      count(*) OVER (PARTITION BY model, seed) AS n FROM clip) WHERE rn <= floor(n * 0.05e0) GROUP BY model, seed),
records AS MATERIALIZED (
  SELECT * FROM ranked JOIN losses USING (model, seed) JOIN ece USING (model, seed) JOIN topk USING (model, seed))"""

_RAW_ECE = _CURVE.replace("least(greatest(p, 1e-7), 1 - 1e-7) AS p", "p")


@query("m1_auc", f"WITH {_CURVE} SELECT model, seed, round(auc, 5) AS auc FROM ranked")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.ranking_metrics(predictions(spark, sf_dir), GROUP).select(*GROUP, "auc"))


@query("m2_average_precision", f"WITH {_CURVE} SELECT model, seed, round(prauc, 5) AS prauc FROM ranked")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.ranking_metrics(predictions(spark, sf_dir), GROUP).select(*GROUP, "prauc"))


@query("m3_log_loss", f"WITH {_CURVE} SELECT model, seed, round(logloss, 5) AS logloss FROM losses")
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.mean_losses(predictions(spark, sf_dir), GROUP).select(*GROUP, "logloss"))


@query("m4_brier", f"WITH {_CURVE} SELECT model, seed, round(avg((p - y) * (p - y)), 5) AS brier FROM preds GROUP BY model, seed")
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.mean_losses(predictions(spark, sf_dir), GROUP).select(*GROUP, "brier"))


@query("m5_calibration_error", f"WITH {_RAW_ECE} SELECT model, seed, round(ece, 4) AS ece FROM ece")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.calibration_error(predictions(spark, sf_dir), GROUP))


@query("m6_recall_at_fpr", f"WITH {_CURVE} SELECT model, seed, round(r1pct, 5) AS r1pct FROM ranked")
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.ranking_metrics(predictions(spark, sf_dir), GROUP).select(*GROUP, "r1pct"))


@query("m7_precision_at_top", f"WITH {_CURVE} SELECT model, seed, round(p5pct, 5) AS p5pct FROM topk")
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.precision_at_top(predictions(spark, sf_dir), GROUP))


_SEVEN = ", ".join(f"round({m}, {_digits(m)}) AS {m}" for m in metrics.METRICS)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluate(staged_predictions(spark, sf_dir), GROUP)


@query("m8_metric_record", f"WITH {_CURVE} SELECT model, seed, {_SEVEN} FROM records")
def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(records(spark, sf_dir))


@query("m8_metric_record_null_group", f"WITH {_CURVE} SELECT nullif(model, 'quantity') AS model, seed, {_SEVEN} FROM records")
def m8_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    unnamed = staged_predictions(spark, sf_dir).withColumn("model", F.nullif("model", F.lit("quantity")))
    return _round(metrics.evaluate(as_staged(unnamed), GROUP))


@query("m9_resolution", f"WITH {_CURVE} SELECT model, seed, round(stddev_pop(p), 5) AS resolution FROM preds GROUP BY model, seed")
def m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.mean_losses(predictions(spark, sf_dir), GROUP).select(*GROUP, "resolution"))


_STATS = ", ".join(f"round(avg({m}), {_digits(m)}) AS {m}_mean, round(stddev_pop({m}), {_digits(m)}) AS {m}_std" for m in metrics.METRICS)


@query("m10_over_seeds", f"WITH {_CURVE} SELECT model, {_STATS} FROM records GROUP BY model")
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.over_seeds(records(spark, sf_dir)))


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each model, averaged over all seeds."""
    return stage(records(spark, sf_dir).groupBy("model").agg(*[F.avg(m).alias(m) for m in metrics.METRICS]))


_LONG = f"""{_CURVE},
means AS MATERIALIZED (SELECT model, {', '.join(f'avg({m}) AS {m}' for m in metrics.METRICS)} FROM records GROUP BY model),
long AS MATERIALIZED ({' UNION ALL '.join(
    f"SELECT model, '{m}' AS metric, {m} AS value, {str(h).lower()} AS higher FROM means" for m, h in metrics.HIGHER_IS_BETTER.items())})"""


@query("m11_win_counts", f"""WITH {_LONG}
SELECT l.model, CAST(count(*) FILTER (CASE WHEN l.higher THEN l.value > r.value + 1e-5 ELSE l.value < r.value - 1e-5 END) AS BIGINT) AS wins
FROM long l JOIN long r USING (metric) WHERE r.model = 'noisy' AND l.model <> 'noisy' GROUP BY l.model""")
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.win_counts(_means(spark, sf_dir), "noisy")


@query("m12_family_lift", f"""WITH {_LONG},
best AS (SELECT family, arg_max(model, (auc, model)) AS model FROM (
  SELECT *, CASE WHEN model = 'quantity' THEN 'baseline' ELSE 'price' END AS family FROM means) GROUP BY family),
b AS (SELECT family, l.* FROM best JOIN long l USING (model))
SELECT p.family, p.model, p.metric, round(p.value, 4) AS value, round(q.value, 4) AS base_value,
  round((CASE WHEN p.higher THEN 1 ELSE -1 END) * (CASE WHEN q.value = 0 THEN 0 ELSE 100e0 * (p.value - q.value) / q.value END), 4) AS lift_pct
FROM b p JOIN b q USING (metric) WHERE q.family = 'baseline' AND p.family <> 'baseline'""")
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.when(F.col("model") == "quantity", "baseline").otherwise("price")
    return _round(metrics.family_lift(_means(spark, sf_dir), family, "baseline"))


@query("m12_family_lift_named_pipe", f"""WITH {_LONG},
best AS (SELECT family, arg_max(model, (auc, model)) AS model FROM (
  SELECT *, CASE WHEN model = 'quantity' THEN 'base|line' ELSE 'price|' END AS family FROM means) GROUP BY family),
b AS (SELECT family, l.* FROM best JOIN long l USING (model))
SELECT p.family, 'm|' || p.model AS model, p.metric, round(p.value, 4) AS value, round(q.value, 4) AS base_value,
  round((CASE WHEN p.higher THEN 1 ELSE -1 END) * (CASE WHEN q.value = 0 THEN 0 ELSE 100e0 * (p.value - q.value) / q.value END), 4) AS lift_pct
FROM b p JOIN b q USING (metric) WHERE q.family = 'base|line' AND p.family <> 'base|line'""")
def m12_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _means(spark, sf_dir).withColumn("model", F.concat(F.lit("m|"), "model"))
    family = F.when(F.col("model") == "m|quantity", "base|line").otherwise("price|")
    return _round(metrics.family_lift(named, family, "base|line"))


@query("m13_best_markers", f"""WITH {_LONG}
SELECT model, metric, round(value, 4) AS value, abs(value - CASE WHEN higher THEN max(value) OVER (PARTITION BY metric)
  ELSE min(value) OVER (PARTITION BY metric) END) < 1e-9 AS is_best FROM long""")
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.best_markers(_means(spark, sf_dir)))


@query("m14_stratified_holdout", f"""WITH {LINES_SQL}
SELECT row_id, rn <= CASE WHEN pos THEN floor(6000e0 * np / n + 0.5e0) ELSE 6000 - floor(6000e0 * np / n + 0.5e0) END AS is_test FROM (
  SELECT row_id, y > 0.5 AS pos, row_number() OVER (PARTITION BY y > 0.5 ORDER BY {hash_sql('holdout')}, row_id) AS rn,
    count(*) OVER () AS n, (SELECT count(*) FILTER (y > 0.5) FROM lines) AS np FROM lines)""")
def m14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_holdout(staged_lines(spark, sf_dir), 6000).select("row_id", "is_test")


@query("m15_shuffled_folds", f"""WITH {LINES_SQL} SELECT row_id, {stack_sql('rn', 'n', 7)} AS fold FROM (
  SELECT row_id, row_number() OVER (ORDER BY {hash_sql('fold')}, row_id) - 1 AS rn, count(*) OVER () AS n FROM lines)""")
def m15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled_folds(staged_lines(spark, sf_dir), 7).select("row_id", "fold")


@query("m16_rank_normalised", f"""WITH {PREDICTIONS_SQL},
a AS (SELECT row_id, row_number() OVER (ORDER BY p, {hash_sql('rank-tie')}, row_id) AS k FROM preds WHERE model = 'noisy' AND seed = 42),
b AS (SELECT p, row_number() OVER (ORDER BY p, {hash_sql('rank-tie')}, row_id) AS k FROM preds WHERE model = 'linear' AND seed = 42)
SELECT row_id, p FROM a JOIN b USING (k)""")
def m16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rank_normalised(one_model(spark, sf_dir, "noisy"), one_model(spark, sf_dir, "linear"))


# j8: the equi-join on rank that rank normalisation consists of, on another pair of models.
@query("j8_rank_join", f"""WITH {PREDICTIONS_SQL},
a AS (SELECT row_id, row_number() OVER (ORDER BY p, {hash_sql('rank-tie')}, row_id) AS k FROM preds WHERE model = 'quantity' AND seed = 7),
b AS (SELECT p, row_number() OVER (ORDER BY p, {hash_sql('rank-tie')}, row_id) AS k FROM preds WHERE model = 'noisy' AND seed = 7)
SELECT row_id, p FROM a JOIN b USING (k)""")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rank_normalised(one_model(spark, sf_dir, "quantity", 7), one_model(spark, sf_dir, "noisy", 7))


# --- post-hoc calibration of held-out scores ------------------------------------------


# Newton iterations of an unregularised logistic fit of the label on the score.
_NEWTON = f"""{ONE_MODEL_SQL},
it AS (SELECT 0 AS i, 1e0 AS a, 0e0 AS b UNION ALL
  SELECT i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
    SELECT i, a, b, sum((q - y) * p) AS ga, sum(q - y) AS gb, sum(q * (1 - q) * p * p) AS haa, sum(q * (1 - q) * p) AS hab,
      sum(q * (1 - q)) AS hbb FROM (SELECT i, a, b, p, y, 1 / (1 + exp(-(a * p + b))) AS q FROM it, scored WHERE i < 25) GROUP BY i, a, b))"""


@query("m17_posthoc_platt", f"""WITH RECURSIVE {_NEWTON}
SELECT row_id, round(1 / (1 + exp(-(a * p + b))), 4) AS p_cal FROM scored, it WHERE i = 25""")
def m17(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = stage(one_model(spark, sf_dir))
    return posthoc.logistic(scored, scored, "p_cal").select("row_id", F.round("p_cal", 4).alias("p_cal"))


@query("m18_posthoc_isotonic", f"""WITH {ONE_MODEL_SQL}, {isotonic_sql('scored', 'p')},
{isotonic_apply_sql('scored', 'p', 'applied')} SELECT row_id, round(prob, 6) AS p_cal FROM applied""")
def m18(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = stage(one_model(spark, sf_dir))
    return posthoc.isotonic(scored, scored, "p_cal").select("row_id", F.round("p_cal", 6).alias("p_cal"))


@query("m19_dual_calibration", f"""WITH RECURSIVE {_NEWTON},
mapped AS MATERIALIZED (SELECT row_id, y, 1 / (1 + exp(-(a * p + b))) AS l FROM scored, it WHERE i = 25),
{isotonic_sql('mapped', 'l')}, {isotonic_apply_sql('mapped', 'l', 'applied')} SELECT row_id, round(prob, 6) AS p_cal FROM applied""")
def m19(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = stage(one_model(spark, sf_dir))
    return posthoc.dual(scored, scored, "p_cal").select("row_id", F.round("p_cal", 6).alias("p_cal"))


@query("m20_oof_and_full_scores")
def m20(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, rest = posthoc.halves(staged_lines(spark, sf_dir))
    oof, full = posthoc.oof_and_full(train, rest, FEATURES, DEMO_RAW)
    mark = lambda df, part: df.select("row_id", F.lit(part).alias("part"), F.round("p", 6).alias("p"))
    return mark(oof, "oof").unionAll(mark(full, "full"))


@query("m21_nested_isotonic")
def m21(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, rest = posthoc.halves(staged_lines(spark, sf_dir))
    oof, full = posthoc.oof_and_full(train, rest, FEATURES, DEMO_RAW, fold_seed=49)
    return posthoc.isotonic(oof, full, "p_cal").select("row_id", F.round("p_cal", 6).alias("p_cal"))
