"""Scoring, model tables and sinks, on the demonstration model."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareboost.operators.binning import fit_binner
from rareboost.operators.probability import collect_breakpoints, isotonic_breakpoints
from rareboost.operators.scoring import leaf_index, mode_from_flags, transform
from rareboost.operators.trees import route_codes
from rareboost.plans.catalog_features import scratch_path
from rareboost.plans.fixtures import FEATURES, N_BINS, sigmoid_sql, staged_lines
from rareboost.plans.models import demo
from rareboost.plans.oracles import boost_sql, isotonic_apply_sql, isotonic_sql
from rareboost.plans.registry import query
from rareboost.session import staged_path
from rareboost.sources import tables
from rareboost.sources.models import Model, load_model, model_tables, save_model, tree_report
from rareboost.streaming.scoring import score_folder

PU_RATE = 0.4

_ISOTONIC: dict[tuple, Model] = {}


def calibrated_demo(spark: SparkSession, sf_dir: str) -> Model:
    """The demonstration model with an isotonic map of its own margins, Platt numbers and a label rate."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ISOTONIC:
        model = demo(spark, sf_dir)
        margins = transform(staged_lines(spark, sf_dir), model, "margin", "score").select("score", "y")
        points = collect_breakpoints(isotonic_breakpoints(margins))
        _ISOTONIC[key] = replace(model, isotonic=points, platt=(1.5, -0.25)).with_pu_label_rate(PU_RATE)
    return _ISOTONIC[key]


_BOOST = boost_sql()
_ISO = f"{_BOOST}, {isotonic_sql('state2', 'pred')}, {isotonic_apply_sql('state2', 'pred', 'applied')}"


def _scored(spark: SparkSession, sf_dir: str, modes: dict[str, str], model: Model | None = None) -> DataFrame:
    out = transform(staged_lines(spark, sf_dir), model or demo(spark, sf_dir), modes)
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in modes])


@query("r1_route_values", f"WITH {_BOOST} SELECT row_id, CAST(leaf0 AS INTEGER) AS leaf0, CAST(leaf1 AS INTEGER) AS leaf1 FROM state2")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = demo(spark, sf_dir)
    return staged_lines(spark, sf_dir).select("row_id", *[leaf_index(t, FEATURES).alias(f"leaf{i}") for i, t in enumerate(model.trees)])


@query("r2_route_bins", f"WITH {_BOOST} SELECT row_id, CAST(leaf0 AS INTEGER) AS leaf0, CAST(leaf1 AS INTEGER) AS leaf1 FROM state2")
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, out = demo(spark, sf_dir), staged_lines(spark, sf_dir)
    out = out.select("row_id", fit_binner(out, FEATURES, N_BINS).codes().alias("codes"))
    for i, tree in enumerate(model.trees):
        out = route_codes(out, tree, f"leaf{i}")
    return out.drop("codes")


@query("r3_raw_score", f"WITH {_BOOST} SELECT row_id, round(pred, 6) AS raw FROM state2")
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, {"raw": "margin"})


@query("r4_raw_probability", f"WITH {_BOOST} SELECT row_id, round({sigmoid_sql('pred')}, 6) AS p FROM state2")
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, {"p": "raw"})


@query("r5_calibrated_probability", f"WITH {_BOOST} SELECT row_id, round((prob0 + prob1) / 2, 6) AS p FROM state2")
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, {"p": "calibrated"})


@query("r6_isotonic_probability", f"WITH {_ISO} SELECT row_id, round(prob, 6) AS p FROM applied")
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, {"p": "isotonic"}, calibrated_demo(spark, sf_dir))


@query("r7_pu_probability", f"WITH {_ISO} SELECT row_id, round(least(prob / {PU_RATE}e0, 1), 6) AS p FROM applied")
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, {"p": "pu"}, calibrated_demo(spark, sf_dir))


@query("r8_auto_mode", f"""WITH {_ISO} SELECT row_id, round((prob0 + prob1) / 2, 6) AS p_leaf, round(prob, 6) AS p_isotonic FROM applied""")
def r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The automatic mode of a leaf-calibrated and of an isotonic model."""
    plain, full = demo(spark, sf_dir), calibrated_demo(spark, sf_dir)
    scored = transform(staged_lines(spark, sf_dir), plain, "auto", "p_leaf")
    scored = transform(scored, full, "auto", "p_isotonic")
    return scored.select("row_id", F.round("p_leaf", 6).alias("p_leaf"), F.round("p_isotonic", 6).alias("p_isotonic"))


@query("r9_batch_scores", f"""WITH {_BOOST} SELECT row_id, round(pred, 6) AS margin, round({sigmoid_sql('pred')}, 6) AS raw,
  round((prob0 + prob1) / 2, 6) AS calibrated FROM state2""")
def r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, {"margin": "margin", "raw": "raw", "calibrated": "calibrated"})


@query("r9_stream_scores", f"""WITH {_BOOST} SELECT row_id, round(pred, 6) AS margin, round({sigmoid_sql('pred')}, 6) AS raw,
  round((prob0 + prob1) / 2, 6) AS calibrated FROM state2""")
def r9_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows arrive as files of a folder, a few a batch, and are scored as they come."""
    rows = staged_lines(spark, sf_dir)
    modes = {"margin": "margin", "raw": "raw", "calibrated": "calibrated"}
    files = max(len(rows.inputFiles()) // 3, 1)
    out = score_folder(spark, rows._staged_path, rows.schema, demo(spark, sf_dir), staged_path(spark), modes, files)
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in modes])


@query("r10_scorer_modes", f"""WITH {_ISO} SELECT row_id, round(least(prob / {PU_RATE}e0, 1), 6) AS pu, round(prob, 6) AS isotonic,
  round({sigmoid_sql('(1.5e0 * pred - 0.25e0)')}, 6) AS platt, round((prob0 + prob1) / 2, 6) AS calibrated,
  round({sigmoid_sql('pred')}, 6) AS raw FROM applied""")
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each switch set together with all switches of lower precedence."""
    order = ["pu", "isotonic", "platt", "calibrated"]
    modes = {name: mode_from_flags(**{n: True for n in order[i:]}) for i, name in enumerate(order)}
    return _scored(spark, sf_dir, {**modes, "raw": mode_from_flags()}, calibrated_demo(spark, sf_dir))


@query("r11_tree_report", f"""WITH {_BOOST} SELECT 0 AS tree_id, CAST(count(*) AS BIGINT) AS n_leaves, CAST(sum(n) AS BIGINT) AS n_rows FROM t0_final
UNION ALL SELECT 1, count(*), CAST(sum(n) AS BIGINT) FROM t1_final""")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_report(spark, demo(spark, sf_dir))


@query("j6_leaf_lookup", f"WITH {_BOOST} SELECT row_id, round(value0 + value1, 6) AS leaf_sum, round(prob0 + prob1, 6) AS prob_sum FROM state2")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row to leaf by an equi-join on (tree, leaf) with the model's leaf table, summed over the trees."""
    model = demo(spark, sf_dir)
    # Bounded by trees x 2^depth.
    leaves = F.broadcast(model_tables(spark, model)["leaves"].select("tree_id", "leaf_idx", "value", "prob"))
    hits = F.array(*[F.struct(F.lit(i).alias("tree_id"), leaf_index(t, FEATURES).alias("leaf_idx")) for i, t in enumerate(model.trees)])
    joined = staged_lines(spark, sf_dir).select("row_id", F.inline(hits)).join(leaves, ["tree_id", "leaf_idx"], "left")
    return joined.groupBy("row_id").agg(F.round(F.sum("value"), 6).alias("leaf_sum"), F.round(F.sum("prob"), 6).alias("prob_sum"))


@query("s5_save_model", f"""WITH {_BOOST} SELECT 0 AS tree_id, CAST(leaf AS INTEGER) AS leaf_idx, round(value, 6) AS value, round(prob, 6) AS prob, CAST(n AS BIGINT) AS n FROM t0_final
UNION ALL SELECT 1, CAST(leaf AS INTEGER), round(value, 6), round(prob, 6), CAST(n AS BIGINT) FROM t1_final""")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf table of a saved model."""
    path = scratch_path(spark, "model")
    save_model(spark, demo(spark, sf_dir), path)
    return spark.read.parquet(f"{path}/leaves").withColumns({c: F.round(c, 6) for c in ("value", "prob")})


@query("s6_load_model", f"WITH {_ISO} SELECT row_id, round(pred, 6) AS margin, round(prob, 6) AS isotonic FROM applied")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a model read back from its tables."""
    path = scratch_path(spark, "model")
    save_model(spark, calibrated_demo(spark, sf_dir), path)
    return _scored(spark, sf_dir, {"margin": "margin", "isotonic": "isotonic"}, load_model(spark, path))


@query("s7_prediction_sink", f"WITH {_BOOST} SELECT row_id, round((prob0 + prob1) / 2, 6) AS p FROM state2")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "predictions")
    tables.write_predictions(transform(staged_lines(spark, sf_dir), demo(spark, sf_dir), "auto"), path)
    return spark.read.parquet(path)
