"""Folds, leaf calibration, isotonic, Platt and positive-unlabeled maps."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareboost.functions.hashing import row_uniform
from rareboost.functions.losses import sigmoid
from rareboost.operators import leaf_calibration as calibration, probability
from rareboost.operators.boosting import held_out_scores, train
from rareboost.operators.folds import stratified_folds, temporal_folds
from rareboost.operators.scoring import resolve_mode, transform
from rareboost.operators.trees import route_codes
from rareboost.plans.catalog_trees import TREE_SQL, grown_tree
from rareboost.plans.fixtures import (
    FEATURES, GRADIENTS_SQL, LINES_SQL, ONE_MODEL_SQL, gradients, hash_sql, lines, one_model, sigmoid_sql, staged_lines,
    uniform_sql,
)
from rareboost.plans.models import DEMO, DEMO_RAW
from rareboost.plans.oracles import folds_sql, held_out_sql, isotonic_apply_sql, isotonic_sql, leaf_table_sql, route_sql
from rareboost.plans.registry import query
from rareboost.session import stage

K = 5


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("c1_stratified_folds", f"WITH {LINES_SQL}, {folds_sql('lines', K)} SELECT row_id, fold FROM folded")
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_folds(staged_lines(spark, sf_dir), K).select("row_id", "fold")


@query("c2_temporal_folds", f"""WITH {LINES_SQL} SELECT row_id, CAST((rn * 4) // n AS INTEGER) AS fold FROM (
  SELECT row_id, row_number() OVER (ORDER BY ts, {hash_sql('time-tie')}, row_id) - 1 AS rn, count(*) OVER () AS n FROM lines)""")
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal_folds(stage(lines(spark, sf_dir).select("row_id", "ts")), "ts", 4).select("row_id", "fold")


# --- leaf calibration of one tree -----------------------------------------------------

_CAL = f"""{TREE_SQL}, {route_sql('t', 'all_rows', 2, 'routed')}, {folds_sql('routed', K, out='t_rows')},
{leaf_table_sql('t', 't_rows', k=K)}, ids AS (SELECT node, CAST(leaf AS INTEGER) AS leaf, value AS newton FROM t_leaves)"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    binner, rows, tree = grown_tree(spark, sf_dir)
    return stratified_folds(route_codes(rows, tree), K)


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _routed(spark, sf_dir)
    prior = calibration.clamp_prior(rows.agg(F.avg((F.col("y") > 0.5).cast("int"))).collect()[0][0])
    return calibration.fold_values(calibration.fold_statistics(rows), 1.0, prior)


@query("c3_fold_statistics", f"""WITH {_CAL} SELECT leaf, fold, round(sum_g, 4) AS sum_g, round(sum_h, 4) AS sum_h, n, n_pos
FROM t_stats JOIN ids USING (node)""")
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(calibration.fold_statistics(_routed(spark, sf_dir)), 4)


@query("c4_oof_leaf_values", f"WITH {_CAL} SELECT leaf, round(value, 6) AS value FROM t_cal JOIN ids USING (node)")
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(calibration.calibrated_leaves(_values(spark, sf_dir)).select("leaf", "value"))


@query("c5_leaf_probabilities", f"WITH {_CAL} SELECT leaf, round(prob, 6) AS prob FROM t_cal JOIN ids USING (node)")
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(calibration.calibrated_leaves(_values(spark, sf_dir)).select("leaf", "prob"))


_ROW_VALUES = f"""WITH {_CAL} SELECT row_id, r.fold, round(coalesce(v.value, c.value), 6) AS oof_value FROM t_rows r
LEFT JOIN t_vals v ON v.node = r.node AND v.fold = r.fold LEFT JOIN t_cal c ON c.node = r.node"""


@query("c6_row_oof_values", _ROW_VALUES)
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = stage(_values(spark, sf_dir))
    out = calibration.row_values(_routed(spark, sf_dir), values, calibration.calibrated_leaves(values))
    return out.select("row_id", "fold", F.round("oof_value", 6).alias("oof_value"))


@query("j5_fold_leaf_lookup", f"""WITH {_CAL} SELECT row_id, round(coalesce(v.value, c.value), 6) AS oof_value FROM t_rows r
LEFT JOIN (SELECT * FROM t_vals WHERE (fold + node) % 3 > 0) v ON v.node = r.node AND v.fold = r.fold
LEFT JOIN t_cal c ON c.node = r.node""")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lookup with (fold, leaf) entries missing, so that rows fall back to their leaf."""
    binner, _, tree = grown_tree(spark, sf_dir)
    heap = _heap_ids(tree)
    values = stage(_values(spark, sf_dir))
    node = F.array(*[F.lit(h) for h in heap])[F.col("leaf")]
    partial = values.where((F.col("fold") + node) % 3 > 0)
    out = calibration.row_values(_routed(spark, sf_dir), partial, calibration.calibrated_leaves(values))
    return out.select("row_id", F.round("oof_value", 6).alias("oof_value"))


def _heap_ids(tree) -> list[int]:
    """Heap number of every leaf, as the SQL numbers nodes."""
    ids: dict[int, int] = {}

    def down(i: int, h: int) -> None:
        n = tree.nodes[i]
        if n.feature < 0:
            ids[n.leaf] = h
        else:
            down(n.left, 2 * h + 1)
            down(n.left + 1, 2 * h + 2)

    down(0, 0)
    return [ids[i] for i in range(tree.n_leaves)]


@query("c7_calibrate_leaves", f"""WITH {_CAL} SELECT leaf, round(newton, 6) AS newton, round(value, 6) AS value, round(prob, 6) AS prob
FROM t_cal JOIN ids USING (node)""")
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, tree = grown_tree(spark, sf_dir)
    newton = F.array(*[F.lit(v) for v in tree.leaf_values])[F.col("leaf")]
    return _round(calibration.calibrated_leaves(_values(spark, sf_dir)).select("leaf", newton.alias("newton"), "value", "prob"))


# --- isotonic -------------------------------------------------------------------------

_ISO = f"{ONE_MODEL_SQL}, {isotonic_sql('scored', 'p')}"


@query("c8_isotonic", f"WITH {_ISO} SELECT round(score, 6) AS score, round(y, 6) AS y, w, round(fitted, 6) AS fitted FROM iso")
def c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(probability.isotonic_fit(probability.pool_scores(one_model(spark, sf_dir), "p")))


@query("c9_isotonic_breakpoints", f"WITH {_ISO} SELECT seq, round(score, 6) AS score, round(prob, 6) AS prob FROM bps")
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(probability.isotonic_breakpoints(one_model(spark, sf_dir), "p"))




@query("c10_isotonic_apply", f"""WITH {_ISO}, probe AS (SELECT row_id, p * 1.3e0 - 0.013e0 AS v FROM scored),
{isotonic_apply_sql('probe', 'v', 'applied')} SELECT row_id, round(prob, 6) AS prob FROM applied""")
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interpolated(one_model(spark, sf_dir), F.col("p") * 1.3 - 0.013)


@query("j4_breakpoint_lookup", f"""WITH {_ISO}, probe AS (SELECT row_id, p * 0.7e0 + 0.0071e0 AS v FROM scored),
{isotonic_apply_sql('probe', 'v', 'applied')} SELECT row_id, round(prob, 6) AS prob FROM applied""")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interpolated(one_model(spark, sf_dir), F.col("p") * 0.7 + 0.0071)


def _interpolated(scored: DataFrame, value) -> DataFrame:
    scored = stage(scored)
    points = probability.collect_breakpoints(probability.isotonic_breakpoints(scored, "p"))
    return scored.select("row_id", F.round(probability.isotonic_apply(value, points), 6).alias("prob"))


@query("c11_held_out_scores", f"WITH {held_out_sql()} SELECT row_id, CAST(y AS DOUBLE) AS y, fold, round(score, 6) AS score FROM held_out")
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(held_out_scores(staged_lines(spark, sf_dir), FEATURES, DEMO_RAW))


# --- Platt ----------------------------------------------------------------------------

_PLATT = f"""{GRADIENTS_SQL},
aim AS MATERIALIZED (SELECT pred AS s, CASE WHEN y > 0.5 THEN (np + 1e0) / (np + 2e0) ELSE 1e0 / (n - np + 2e0) END AS t
  FROM gradients CROSS JOIN (SELECT count(*) AS n, count(*) FILTER (y > 0.5) AS np FROM gradients)),
it AS (SELECT 0 AS i, 1e0 AS a, 0e0 AS b UNION ALL
  SELECT i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
    SELECT i, a, b, sum((q - t) * s) AS ga, sum(q - t) AS gb, sum(q * (1 - q) * s * s) + 1e-9 AS haa, sum(q * (1 - q) * s) AS hab,
      sum(q * (1 - q)) + 1e-9 AS hbb FROM (SELECT i, a, b, s, t, 1 / (1 + exp(-(a * s + b))) AS q FROM it, aim WHERE i < 20) GROUP BY i, a, b))"""


@query("c12_platt_fit", f"WITH RECURSIVE {_PLATT} SELECT round(a, 6) AS a, round(b, 6) AS b FROM it WHERE i = 20")
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = probability.platt_fit(gradients(spark, sf_dir), "pred")
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "a double, b double")


@query("c13_platt_apply", f"""WITH RECURSIVE {_PLATT} SELECT row_id, round({sigmoid_sql('(a * pred + b)')}, 6) AS p
FROM gradients, it WHERE i = 20""")
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(gradients(spark, sf_dir).select("row_id", "y", "pred"))
    a, b = probability.platt_fit(rows, "pred")
    return rows.select("row_id", F.round(probability.platt_apply(F.col("pred"), a, b), 6).alias("p"))


# --- positive-unlabeled ---------------------------------------------------------------

_PU = f"""{GRADIENTS_SQL}, pu AS MATERIALIZED (
  SELECT row_id, pr AS score, CASE WHEN y > 0.5 AND {uniform_sql('labelled')} < 0.4e0 THEN 1 ELSE 0 END AS s FROM gradients),
lab AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM pu WHERE s > 0.5),
rates AS (SELECT least(greatest(avg(score), 1e-3), 1) AS c_mean, least(greatest(max(score), 1e-3), 1) AS c_max,
  least(greatest(max(CASE WHEN i = n // 2 THEN score END), 1e-3), 1) AS c_median FROM lab)"""


def _unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = (F.col("y") > 0.5) & (row_uniform("labelled") < 0.4)
    return gradients(spark, sf_dir).select("row_id", sigmoid(F.col("pred")).alias("score"), F.when(labelled, 1).otherwise(0).alias("s"))


@query("c14_label_rate", f"""WITH {_PU} SELECT round(c_mean, 6) AS c_mean, round(c_max, 6) AS c_max, round(c_median, 6) AS c_median FROM rates""")
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(_unlabelled(spark, sf_dir).drop("row_id"))
    rates = [round(probability.pu_label_rate(rows, e, label="s"), 6) for e in ("mean", "max", "median")]
    return spark.createDataFrame([tuple(rates)], "c_mean double, c_max double, c_median double")


@query("c15_label_rate_correction", f"""WITH {_PU} SELECT row_id, round(least(greatest(score / greatest(c_mean, 1e-3), 0), 1), 6) AS p
FROM pu CROSS JOIN rates""")
def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(_unlabelled(spark, sf_dir))
    c = probability.pu_label_rate(rows, "mean", label="s")
    return rows.select("row_id", F.round(probability.pu_correct(F.col("score"), c), 6).alias("p"))


@query("c16_calibration_precedence")
def c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every switch combination of the demonstration model: the calibration it resolves to, and its mean score."""
    base = staged_lines(spark, sf_dir)
    parts = []
    for calibrate, platt, iso in ((False, True, True), (True, False, False), (True, True, False), (True, True, True)):
        config = replace(DEMO, calibrate=calibrate, platt_scale=platt, raw_isotonic=iso)
        model = train(base, FEATURES, config)
        mode = {"platt": "platt"}.get(config.calibration, "auto")
        parts.append(transform(base, model, mode).agg(F.round(F.avg("p"), 6).alias("mean_p")).select(
            F.lit(config.calibration).alias("calibration"), F.lit(resolve_mode(model, mode)).alias("mode"), "mean_p"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
