"""The trained model, and its four Parquet tables."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareboost.operators.trees import Node, Tree


@dataclass
class Model:
    trees: list[Tree]
    learning_rate: float
    init_score: float
    features: list[str]
    platt: tuple[float, float] | None = None
    pu_label_rate: float | None = None
    isotonic: list[tuple[float, float]] = field(default_factory=list)

    @property
    def n_trees(self) -> int:
        return len(self.trees)

    @property
    def has_leaf_probabilities(self) -> bool:
        return any(p > 0.0 for t in self.trees for p in t.leaf_probs)

    def with_pu_label_rate(self, c: float) -> "Model":
        return replace(self, pu_label_rate=min(max(c, 1e-3), 1.0))


NODES = "tree_id int, node_id int, is_leaf boolean, feature int, split_bin int, threshold double, left int, right int, leaf_idx int"
LEAVES = "tree_id int, leaf_idx int, value double, prob double, n long"
PARAMS = (
    "learning_rate double, init_score double, features array<string>, n_trees int, "
    "platt_a double, platt_b double, pu_label_rate double"
)
ISOTONIC = "seq int, score double, prob double"


def model_tables(spark: SparkSession, model: Model) -> dict[str, DataFrame]:
    """``params``, ``nodes``, ``leaves`` and ``isotonic`` as DataFrames."""
    nodes = [
        (t, i, n.feature < 0, n.feature, n.split_bin, n.threshold, n.left, n.left + 1 if n.left >= 0 else -1, n.leaf)
        for t, tree in enumerate(model.trees) for i, n in enumerate(tree.nodes)
    ]
    leaves = [
        (t, i, v, p, c)
        for t, tree in enumerate(model.trees)
        for i, (v, p, c) in enumerate(zip(tree.leaf_values, tree.leaf_probs, tree.leaf_counts))
    ]
    a, b = model.platt or (None, None)
    params = [(model.learning_rate, model.init_score, model.features, len(model.trees), a, b, model.pu_label_rate)]
    iso = [(i, s, p) for i, (s, p) in enumerate(model.isotonic)]
    return {
        "params": spark.createDataFrame(params, PARAMS),
        "nodes": spark.createDataFrame(nodes, NODES),
        "leaves": spark.createDataFrame(leaves, LEAVES),
        "isotonic": spark.createDataFrame(iso, ISOTONIC),
    }


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    for name, table in model_tables(spark, model).items():
        table.write.mode("overwrite").parquet(os.path.join(path, name))


def load_model(spark: SparkSession, path: str) -> Model:
    tables = {name: spark.read.parquet(os.path.join(path, name)) for name in ("params", "nodes", "leaves", "isotonic")}
    return model_from_tables(tables)


def model_from_tables(tables: dict[str, DataFrame]) -> Model:
    p = tables["params"].collect()[0]
    trees = [Tree(nodes=[]) for _ in range(p["n_trees"])]
    for r in tables["nodes"].orderBy("tree_id", "node_id").collect():
        trees[r["tree_id"]].nodes.append(Node(r["feature"], r["split_bin"], r["threshold"], r["left"], r["leaf_idx"]))
    for r in tables["leaves"].orderBy("tree_id", "leaf_idx").collect():
        tree = trees[r["tree_id"]]
        tree.leaf_values.append(r["value"])
        tree.leaf_probs.append(r["prob"])
        tree.leaf_counts.append(r["n"])
    return Model(
        trees, p["learning_rate"], p["init_score"], list(p["features"]),
        platt=None if p["platt_a"] is None else (p["platt_a"], p["platt_b"]),
        pu_label_rate=p["pu_label_rate"],
        isotonic=[(r["score"], r["prob"]) for r in tables["isotonic"].orderBy("seq").collect()],
    )


def tree_report(spark: SparkSession, model: Model) -> DataFrame:
    """Trees and leaves of a model, counted on its tables."""
    leaves = model_tables(spark, model)["leaves"]
    return leaves.groupBy("tree_id").agg(F.count("*").alias("n_leaves"), F.sum("n").alias("n_rows"))
