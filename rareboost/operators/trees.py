"""Tree structure and level-wise growth."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rareboost.operators import histogram, levels
from rareboost.operators.binning import MAX_BINS, Binner
from rareboost.session import Scratch


@dataclass
class Node:
    """Internal node (``feature >= 0``) or leaf (``leaf >= 0``); children are neighbours."""

    feature: int = -1
    split_bin: int = -1
    threshold: float = float("nan")
    left: int = -1
    leaf: int = -1


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=lambda: [Node()])
    leaf_values: list[float] = field(default_factory=list)
    leaf_probs: list[float] = field(default_factory=list)
    leaf_counts: list[int] = field(default_factory=list)

    @property
    def n_leaves(self) -> int:
        return len(self.leaf_values)

    @property
    def depth(self) -> int:
        def down(i: int) -> int:
            n = self.nodes[i]
            return 0 if n.feature < 0 else 1 + max(down(n.left), down(n.left + 1))

        return down(0)


def route_codes(df: DataFrame, tree: Tree, name: str = "leaf", values: list | None = None) -> DataFrame:
    """Follow the tree on the ``codes`` array and add the reached leaf (or ``values[leaf]``).

    A narrow projection of constant size for any tree: the nodes are two array
    literals, and nothing is shuffled or sent to Python.
    """
    return df.withColumn(name, F.get(_leaf_lookup(tree, values), node_position(tree.nodes, tree.depth)))


def reached(tree: Tree) -> Column:
    """Leaf by ``codes``, routed in numpy batches: a plan of constant size for any tree."""
    routing, leaf = levels.Routing.of(tree.nodes, tree.depth), np.array([n.leaf for n in tree.nodes], np.int32)
    return F.arrow_udf(lambda codes: pa.array(leaf[routing.position(levels.bin_matrix(codes))]), "int")(F.col("codes"))


@dataclass(frozen=True)
class Step:
    """A finished tree as arrays: what it adds to a row's prediction, and by fold to its out-of-fold one."""

    routing: levels.Routing
    add: np.ndarray
    add_by_fold: np.ndarray | None = None

    @classmethod
    def of(cls, tree: Tree, rate: float, by_fold: list[list[float]] | None = None) -> "Step":
        leaf = np.array([max(n.leaf, 0) for n in tree.nodes])
        add = rate * np.array(tree.leaf_values, float)
        return cls(levels.Routing.of(tree.nodes, tree.depth), add[leaf], None if by_fold is None else rate * np.array(by_fold, float)[leaf])


def advanced(
    bins: np.ndarray, pred: np.ndarray, oof: np.ndarray | None, fold: np.ndarray | None, steps: list[Step]
) -> tuple[np.ndarray, np.ndarray | None]:
    """``pred``, and ``oof`` if there is one, after ``steps``."""
    pred, oof = pred.copy(), None if oof is None else oof.copy()
    for step in steps:
        at = step.routing.position(bins)
        pred += step.add[at]
        if oof is not None:
            oof += step.add_by_fold[at, fold]
    return pred, oof


def replay(df: DataFrame, steps: list[Step]) -> DataFrame:
    """``pred`` (and ``oof``) after ``steps``, from rows with ``codes, pred`` (and ``fold, oof``).

    One narrow pass, whose plan is the same however many trees there are; the
    forest travels with the function, a few kilobytes a tree.
    """
    if not steps:
        return df
    folded = "oof" in df.columns

    def run(codes: pa.Array, pred: pa.Array, oof: pa.Array, fold: pa.Array) -> pa.Array:
        old, other, folds = (c.to_numpy(zero_copy_only=False) for c in (pred, oof, fold))
        new, other = advanced(levels.bin_matrix(codes), old, other if folded else None, folds, steps)
        other = new if other is None else other
        return pa.StructArray.from_arrays([pa.array(new), pa.array(other)], ["pred", "oof"])

    extra = [F.col("oof"), F.col("fold").cast("int")] if folded else [F.col("pred"), F.lit(0)]
    moved = df.withColumn("_new", F.arrow_udf(run, "struct<pred:double,oof:double>")(F.col("codes"), F.col("pred"), *extra))
    return moved.select(*[F.col(f"_new.{c}").alias(c) if c in ("pred", "oof") else F.col(c) for c in df.columns])


def _leaf_lookup(tree: Tree, values: list | None = None) -> Column:
    leaves = [n.leaf for n in tree.nodes]
    return literal_array(leaves if values is None else [float("nan") if i < 0 else float(values[i]) for i in leaves])


def literal_array(values: list[int] | list[float]) -> Column:
    """Array constant; parsed from one text, which is much faster than one literal per entry."""
    if values and isinstance(values[0], float):
        return F.expr(f"array({', '.join(f'double({v!r})' if math.isfinite(v) else 'double(null)' for v in values)})")
    return F.expr(f"array({', '.join(str(v) for v in values)})")


def _step(nodes: list[Node]):
    """One step down the tree: from a node to its child, or stay in a leaf."""
    cuts = literal_array([n.feature * MAX_BINS + n.split_bin if n.feature >= 0 else -1 for n in nodes])
    lefts = literal_array([n.left for n in nodes])

    def down(at: Column) -> Column:
        cut = F.get(cuts, at)
        beyond = (F.get(F.col("codes"), F.shiftright(cut, 8)) > cut).cast("int")
        return F.when(cut < 0, at).otherwise(F.get(lefts, at) + beyond)

    return down


def node_position(nodes: list[Node], depth: int) -> Column:
    """Node that a row has reached after ``depth`` steps from the root, as one expression.

    A fold over the levels: filters on the result may be pushed below it and
    stay small, which a chain of projections would not.
    """
    if depth == 0 or len(nodes) == 1:
        return F.lit(0)
    down = _step(nodes)
    return F.aggregate(F.expr(f"sequence(1, {depth})"), F.lit(0), lambda at, _: down(at))


@dataclass(frozen=True)
class GrowthLimits:
    max_depth: int = 6
    min_child_weight: float = 1.0
    min_samples_leaf: int = 20
    lam: float = 1.0


def grow(
    rows: DataFrame,
    binner: Binner,
    limits: GrowthLimits,
    splitter: histogram.Splitter | None = None,
    only: list[int] | None = None,
    tasks: int | None = None,
) -> Tree:
    """Grow one tree from sampled rows with ``codes, y, g, h, ipc_w``.

    All open nodes of a level share one pass, which reads the rows of each split's
    smaller child only; the larger one is its parent's histogram minus that. One
    record per (node, feature) returns to the driver. Nodes do not influence one
    another, so the tree equals the depth-first one.
    """
    splitter = splitter or histogram.GainSplitter()
    features = list(range(len(binner.features))) if only is None else only
    choose = splitter.chooser(limits.lam, limits.min_child_weight) if hasattr(splitter, "chooser") else None
    nodes = [Node()]
    if not features:
        root = histogram.weighted_sums(rows).collect()[0]
        return with_leaves(nodes, {0: (root["sum_g"] or 0.0, root["sum_h"] or 0.0, root["cnt"])}, limits.lam)
    stats = {0: (0.0, 0.0, 0)}
    plan, cells = [levels.Children(0, 0, -1)], None
    with Scratch() as scratch:
        for depth in range(max(limits.max_depth, 1)):
            level = levels.level_cells(rows, cells, levels.Routing.of(nodes, depth), plan, features, choose, tasks)
            cells = scratch.keep(level)
            found = levels.records(cells)
            if depth == 0 and found:
                stats[0] = tuple(next(r for r in found if r["feature"] == features[0])[m] for m in ("g", "h", "n"))
            best = _best_per_node(found) if choose else splitter.best(levels.as_cells(cells), limits.lam, limits.min_child_weight).collect()
            open_ = {c for p in plan for c in (p.read, p.other) if c >= 0 and is_open(stats[c], limits)}
            plan = []
            for s in sorted((s for s in best if s["node"] in open_), key=lambda r: r["node"]):
                if depth >= limits.max_depth or s["nl"] < limits.min_samples_leaf or s["nr"] < limits.min_samples_leaf:
                    continue
                left = len(nodes)
                nodes[s["node"]] = Node(s["feature"], s["bin"], binner.uppers[s["feature"]][s["bin"]], left)
                nodes += [Node(), Node()]
                stats[left] = (s["gl"], s["hl"], s["nl"])
                stats[left + 1] = (s["gr"], s["hr"], s["nr"])
                if is_open(stats[left], limits) or is_open(stats[left + 1], limits):
                    small = left if s["nl"] <= s["nr"] else left + 1
                    plan.append(levels.Children(s["node"], small, 2 * left + 1 - small))
            if not plan:
                break
    return with_leaves(nodes, stats, limits.lam)


def is_open(stats: tuple[float, float, int], limits: GrowthLimits) -> bool:
    return stats[2] >= max(limits.min_samples_leaf, 2) and stats[1] >= limits.min_child_weight


def _best_per_node(found: list) -> list:
    """The best record of every node; of equal scores the lowest feature."""
    best: dict[int, object] = {}
    for r in sorted((r for r in found if r["bin"] is not None), key=lambda r: (r["node"], -r["score"], r["feature"])):
        best.setdefault(r["node"], r)
    return list(best.values())


def breadth_first(nodes: list[Node], stats: dict[int, tuple]) -> tuple[list[Node], dict[int, tuple]]:
    """The same tree with nodes numbered level by level, as growth numbers them."""
    order = [0]
    for i in order:
        order += [nodes[i].left, nodes[i].left + 1] if nodes[i].feature >= 0 else []
    place = {old: new for new, old in enumerate(order)}
    return [replace(nodes[i], left=place.get(nodes[i].left, -1)) for i in order], {place[i]: stats[i] for i in order}


def with_leaves(nodes: list[Node], stats: dict[int, tuple[float, float, int]], lam: float) -> Tree:
    """Number the leaves from left to right and set their Newton values."""
    tree = Tree(nodes)
    stack = [0]
    while stack:
        i = stack.pop()
        n = nodes[i]
        if n.feature >= 0:
            stack += [n.left + 1, n.left]
            continue
        g, h, count = stats[i]
        n.leaf = tree.n_leaves
        tree.leaf_values.append(-g / (h + lam) if h + lam else 0.0)
        tree.leaf_probs.append(0.0)
        tree.leaf_counts.append(count)
    return tree
