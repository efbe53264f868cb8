"""Batch scoring: one narrow pass, no shuffle; also valid on a streaming DataFrame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rareboost.functions.losses import sigmoid
from rareboost.operators.probability import isotonic_apply, platt_apply, pu_correct
from rareboost.operators.trees import Tree
from rareboost.sources.models import Model

MODES = ("auto", "raw", "margin", "calibrated", "platt", "isotonic", "pu")


def _packed(tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    n = tree.nodes
    return (
        np.array([x.feature for x in n], dtype=np.int32),
        np.array([x.threshold for x in n]),
        np.array([x.left for x in n], dtype=np.int32),
        np.array([x.leaf for x in n], dtype=np.int32),
        tree.depth,
    )


def _reach(values: np.ndarray, packed) -> np.ndarray:
    """Leaf of every row; a missing value goes left, as in training."""
    feature, threshold, left, leaf, depth = packed
    rows = np.arange(len(values))
    at = np.zeros(len(values), dtype=np.int32)
    for _ in range(depth):
        f = feature[at]
        inner = f >= 0
        v = values[rows, np.maximum(f, 0)]
        at = np.where(inner, left[at] + (v > threshold[at]), at)
    return leaf[at]


def _matrix(columns) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])


def _inputs(features: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features]


def leaf_index(tree: Tree, features: list[str]) -> Column:
    """Leaf reached by the raw feature values: ``value <= threshold`` goes left."""
    packed = _packed(tree)

    def route(*columns: pa.Array) -> pa.Array:
        return pa.array(_reach(_matrix(columns), packed))

    return F.arrow_udf(route, "int")(*_inputs(features))


def model_sums(model: Model) -> Column:
    """Struct of summed leaf values and summed leaf probabilities over all trees."""
    packed = [_packed(t) for t in model.trees]
    values = [np.asarray(t.leaf_values) for t in model.trees]
    probs = [np.asarray(t.leaf_probs) for t in model.trees]

    def score(*columns: pa.Array) -> pa.Array:
        x = _matrix(columns)
        v, p = np.zeros(len(x)), np.zeros(len(x))
        for tree, tv, tp in zip(packed, values, probs):
            leaf = _reach(x, tree)
            v += tv[leaf]
            p += tp[leaf]
        return pa.StructArray.from_arrays([pa.array(v), pa.array(p)], ["value", "prob"])

    return F.arrow_udf(score, "struct<value:double,prob:double>")(*_inputs(model.features))


def margin_by_fold(models: list[Model], fold: str = "fold") -> Column:
    """Raw score of every row from the model of its fold, all in one routing pass."""
    forests = [[(_packed(t), np.asarray(t.leaf_values)) for t in m.trees] for m in models]
    rates, starts = [m.learning_rate for m in models], [m.init_score for m in models]

    def score(folds: pa.Array, *columns: pa.Array) -> pa.Array:
        x, at = _matrix(columns), folds.to_numpy(zero_copy_only=False)
        out = np.empty(len(x))
        for k, forest in enumerate(forests):
            rows = np.flatnonzero(at == k)
            v = np.zeros(len(rows))
            for tree, values in forest:
                v += values[_reach(x[rows], tree)]
            out[rows] = v * rates[k] + starts[k]
        return pa.array(out)

    return F.arrow_udf(score, "double")(F.col(fold), *_inputs(models[0].features))


def resolve_mode(model: Model, mode: str = "auto") -> str:
    """The probability a model can give: missing calibrations fall back to raw."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "auto":
        return "isotonic" if model.isotonic else "calibrated" if model.has_leaf_probabilities else "raw"
    if mode == "platt" and not model.platt or mode == "isotonic" and not model.isotonic:
        return "raw"
    return mode


def mode_from_flags(pu: bool = False, isotonic: bool = False, platt: bool = False, calibrated: bool = False) -> str:
    """Precedence of the scorer's switches."""
    for name, on in (("pu", pu), ("isotonic", isotonic), ("platt", platt), ("calibrated", calibrated)):
        if on:
            return name
    return "raw"


def _probability(model: Model, mode: str, sums: Column) -> Column:
    raw = sums["value"] * F.lit(model.learning_rate) + F.lit(model.init_score)
    mode = resolve_mode(model, mode)
    if mode == "margin":
        return raw
    if mode == "calibrated":
        return sums["prob"] / len(model.trees) if model.trees else F.lit(0.5)
    if mode == "platt":
        return platt_apply(raw, *model.platt)
    if mode == "isotonic":
        return isotonic_apply(raw, model.isotonic)
    if mode == "pu":
        best = "isotonic" if model.isotonic else "platt" if model.platt else "raw"
        p = _probability(model, best, sums)
        return p if model.pu_label_rate is None else pu_correct(p, model.pu_label_rate)
    return sigmoid(raw)


def transform(df: DataFrame, model: Model, mode: str | dict[str, str] = "auto", name: str = "p") -> DataFrame:
    """Add the probability of ``mode``; a dict ``{column: mode}`` adds several from one routing pass."""
    wanted = mode if isinstance(mode, dict) else {name: mode}
    sums = df.withColumn("_sums", model_sums(model))
    return sums.select(*df.columns, *[_probability(model, m, F.col("_sums")).alias(c) for c, m in wanted.items()])
