"""Histograms, splits, tree growth and boosting."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareboost.functions.losses import log_loss, sigmoid
from rareboost.operators import histogram
from rareboost.operators.binning import fit_binner
from rareboost.operators.boosting import default_bce, focal_calibrated, train
from rareboost.operators.sampling import Uniform
from rareboost.operators.scoring import transform
from rareboost.operators.trees import GrowthLimits, Tree, grow, route_codes
from rareboost.plans.fixtures import FEATURES, GRADIENTS_SQL, N_BINS, gradients, staged_lines, uniform_sql
from rareboost.plans.models import DEMO, demo
from rareboost.plans.oracles import best_sql, bins_sql, boost_sql, candidates_sql, cells_sql, grow_sql
from rareboost.plans.registry import query

LIMITS = GrowthLimits(max_depth=2)

# Rows of the histogram queries: an 80 % sample with weights, in two nodes.
_SAMPLE = f"""{GRADIENTS_SQL}, {bins_sql('gradients')},
sampled AS MATERIALIZED (SELECT *, 1e0 / 0.8e0 AS w, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS node
  FROM binned WHERE {uniform_sql('uniform')} < 0.8e0),
cells AS MATERIALIZED ({cells_sql('sampled')})"""


def _coded(spark: SparkSession, sf_dir: str):
    base = gradients(spark, sf_dir, staged_lines(spark, sf_dir))
    binner = fit_binner(base, FEATURES, N_BINS)
    rows = base.select("row_id", "y", "g", "h", "l_quantity", binner.codes().alias("codes"))
    return binner, rows


def _sampled(spark: SparkSession, sf_dir: str):
    binner, rows = _coded(spark, sf_dir)
    drawn = Uniform(0.8).sample(rows, 0)
    return binner, drawn.withColumn("node", F.when(F.col("l_quantity") > 25, 1).otherwise(0))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    binner, rows = _sampled(spark, sf_dir)
    return histogram.build(rows, len(FEATURES))


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_SUMS = ", ".join(f"round({m}, 4) AS {m}" if m.startswith("sum") else m for m in histogram.MEASURES)


@query("h1_histogram", f"WITH {_SAMPLE} SELECT node, feature, bin, {_SUMS} FROM cells")
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_cells(spark, sf_dir), 4)


_TOTALS = ", ".join(
    f"round(sum({m}), 4) AS {m}" if m.startswith("sum") else f"CAST(sum({m}) AS BIGINT) AS {m}" for m in histogram.MEASURES
)


@query("h2_histogram_totals", f"WITH {_SAMPLE} SELECT node, feature, {_TOTALS} FROM cells GROUP BY node, feature")
def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(histogram.totals(_cells(spark, sf_dir)), 4)


@query("h3_sibling_histogram", f"WITH {_SAMPLE} SELECT feature, bin, {_SUMS} FROM cells WHERE node = 1")
def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent minus left child, without the cells the right child has no row in."""
    binner, rows = _sampled(spark, sf_dir)
    parent = histogram.build(rows.withColumn("node", F.lit(0)), len(FEATURES))
    child = histogram.build(rows.where("node = 0"), len(FEATURES))
    return _round(histogram.complement(parent, child).where("cnt > 0"), 4).withColumns(
        {m: F.col(m) + 0.0 for m in histogram.MEASURES if m.startswith("sum")}
    )


_CAND = f"{_SAMPLE}, cand AS ({candidates_sql('cells')})"


@query("h4_newton_gain", f"WITH {_CAND} SELECT node, feature, bin, round(gain, 6) AS gain FROM cand")
def h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(histogram.candidates(_cells(spark, sf_dir), 1.0, 1.0).select("node", "feature", "bin", "gain"))


@query("h5_purity_delta", f"WITH {_CAND} SELECT node, feature, bin, round(purity, 6) AS purity FROM cand")
def h5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(histogram.candidates(_cells(spark, sf_dir), 1.0, 1.0).select("node", "feature", "bin", "purity"))


_RECORD = ["node", "feature", "bin", "gain", "purity", "score", "gl", "hl", "nl", "pl", "gr", "hr", "nr", "pr"]
_RECORD_SQL = ", ".join(c if c in ("node", "feature", "bin", "nl", "pl", "nr", "pr") else f"round({c}, 4) AS {c}" for c in _RECORD)
_ROOT = f"""{GRADIENTS_SQL}, {bins_sql('gradients')},
rooted AS MATERIALIZED (SELECT *, 1e0 AS w, 0 AS node FROM binned), root_cells AS MATERIALIZED ({cells_sql('rooted')})"""


@query("h6_best_split", f"""WITH {_ROOT} SELECT b.feature, b.bin, round(upper, 4) AS threshold, round(gain, 4) AS gain, round(gl, 4) AS gl,
  round(hl, 4) AS hl, nl, round(gr, 4) AS gr, round(hr, 4) AS hr, nr
FROM ({best_sql('root_cells')}) b JOIN thr ON thr.feature = b.feature AND thr.bin = b.bin""")
def h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best root split of the whole table, with its threshold."""
    binner, rows = _coded(spark, sf_dir)
    cells = histogram.build(rows.select("*", F.lit(0).alias("node"), F.lit(1.0).alias("ipc_w")), len(FEATURES))
    best = histogram.GainSplitter().best(cells, 1.0, 1.0)
    uppers = F.array(*[F.array(*[F.lit(u) for u in feature]) for feature in binner.uppers])
    return _round(best.select("feature", "bin", uppers[F.col("feature")][F.col("bin")].alias("threshold"), "gain", "gl", "hl", "nl", "gr", "hr", "nr"), 4)


@query("h7_purity_split", f"WITH {_SAMPLE} SELECT {_RECORD_SQL} FROM ({best_sql('cells', purity=50.0)})")
def h7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(histogram.GainSplitter(purity_weight=50.0).best(_cells(spark, sf_dir), 1.0, 1.0), 4)


@query("h8_split_record", f"WITH {_SAMPLE} SELECT {_RECORD_SQL} FROM ({best_sql('cells')})")
def h8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(histogram.GainSplitter().best(_cells(spark, sf_dir), 1.0, 1.0), 4)


# --- one tree of depth two on the gradients -------------------------------------------

TREE_SQL = f"{GRADIENTS_SQL}, {bins_sql('gradients')}, all_rows AS MATERIALIZED (SELECT *, 1e0 AS w FROM binned), {grow_sql('t', 'all_rows', 2)}"

_GROWN: dict[tuple, tuple] = {}


def grown_tree(spark: SparkSession, sf_dir: str):
    """Binner, coded rows (a narrow view of the staged lines) and tree; kept per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GROWN:
        binner, rows = _coded(spark, sf_dir)
        _GROWN[key] = binner, rows, grow(rows.withColumn("ipc_w", F.lit(1.0)), binner, LIMITS)
    return _GROWN[key]


def node_frame(spark: SparkSession, tree: Tree) -> DataFrame:
    rows = [(i, n.feature, n.split_bin, n.left) for i, n in enumerate(tree.nodes)]
    return spark.createDataFrame(rows, "node int, feature int, bin int, left int")


@query("h9_partition_rows", f"""WITH {TREE_SQL} SELECT row_id, CAST(node AS INTEGER) AS side FROM t_n1""")
def h9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side of every row under the root split: 1 left, 2 right."""
    binner, rows, tree = grown_tree(spark, sf_dir)
    root = tree.nodes[0]
    return rows.select("row_id", F.when(F.col("codes")[root.feature] > root.feature * 256 + root.split_bin, 2).otherwise(1).alias("side"))


@query("h10_weighted_sums", f"""WITH {_SAMPLE} SELECT round(sum(g * w), 4) AS sum_g, round(sum(h * w), 4) AS sum_h,
  CAST(count(*) AS BIGINT) AS cnt FROM sampled""")
def h10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(histogram.weighted_sums(_sampled(spark, sf_dir)[1]), 4)


@query("h11_leaf_values", f"WITH {TREE_SQL} SELECT leaf, round(value, 6) AS value, CAST(n AS BIGINT) AS n FROM t_leaves")
def h11(spark: SparkSession, sf_dir: str) -> DataFrame:
    binner, rows, tree = grown_tree(spark, sf_dir)
    sums = route_codes(rows, tree).groupBy("leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
    return _round(sums.select("leaf", histogram.leaf_value(F.col("g"), F.col("h"), 1.0).alias("value"), "n"))


@query("h12_grow_tree", f"""WITH {TREE_SQL} SELECT row_id, CAST(leaf AS INTEGER) AS leaf, round(value, 6) AS value
FROM t_n2 JOIN t_leaves USING (node)""")
def h12(spark: SparkSession, sf_dir: str) -> DataFrame:
    binner, rows = _coded(spark, sf_dir)
    tree = grow(rows.withColumn("ipc_w", F.lit(1.0)), binner, LIMITS)
    routed = route_codes(rows, tree)
    value = F.array(*[F.lit(v) for v in tree.leaf_values])[F.col("leaf")]
    return routed.select("row_id", "leaf", F.round(value, 6).alias("value"))


# --- boosting -------------------------------------------------------------------------

_FINAL = " UNION ALL ".join(
    f"SELECT {r} AS tree_id, CAST(leaf AS INTEGER) AS leaf_idx, round(value, 6) AS value, round(prob, 6) AS prob, CAST(n AS BIGINT) AS n FROM t{r}_final"
    for r in range(2)
)


@query("b1_train", f"WITH {boost_sql()} {_FINAL}")
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of two boosted, sampled, leaf-calibrated trees."""
    model = train(staged_lines(spark, sf_dir), FEATURES, DEMO)
    rows = [
        (t, i, round(v, 6), round(p, 6), n)
        for t, tree in enumerate(model.trees) for i, (v, p, n) in enumerate(zip(tree.leaf_values, tree.leaf_probs, tree.leaf_counts))
    ]
    return spark.createDataFrame(rows, "tree_id int, leaf_idx int, value double, prob double, n long")


@query("b1_train_uncalibrated", f"WITH {boost_sql(calibrate=False)} SELECT row_id, round(pred, 6) AS pred FROM state2")
def b1_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(staged_lines(spark, sf_dir), FEATURES, replace(DEMO, calibrate=False))
    return transform(staged_lines(spark, sf_dir), model, "margin", "pred").select("row_id", F.round("pred", 6).alias("pred"))


@query("b2_update_predictions", f"WITH {boost_sql()} SELECT row_id, round(pred, 6) AS pred FROM state2")
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initial score plus each tree's shrunken leaf value, routed on the bins."""
    model = demo(spark, sf_dir)
    base = staged_lines(spark, sf_dir)
    out = base.select("row_id", fit_binner(base, FEATURES, N_BINS).codes().alias("codes"), F.lit(model.init_score).alias("pred"))
    for tree in model.trees:
        step = route_codes(out, tree, "_v", values=tree.leaf_values)
        out = step.withColumn("pred", F.col("pred") + model.learning_rate * F.col("_v")).drop("_v")
    return out.select("row_id", F.round("pred", 6).alias("pred"))


@query("b3_early_stopping")
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate above one overshoots: the loss improves, then stalls, and the rounds of the stall stay in the model."""
    base = staged_lines(spark, sf_dir)
    config = replace(DEMO, calibrate=False, n_rounds=6, learning_rate=1.05, early_stopping_rounds=2)
    model = train(base, FEATURES, config)
    scored = transform(base, model, "margin", "pred")
    loss = F.avg(log_loss(F.col("y"), sigmoid(F.col("pred"))))
    return scored.agg(F.round(loss, 6).alias("log_loss"), F.lit(model.n_trees).alias("n_trees"))


@query("b4_presets")
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both presets as they are defined, trained on the whole table and scored with their calibration."""
    base = staged_lines(spark, sf_dir)
    parts = []
    for name, config in (("bce", default_bce()), ("focal", focal_calibrated(2.0, 0.25))):
        model = train(base, FEATURES, config)
        parts.append(transform(base, model, "auto").select(F.lit(name).alias("preset"), "row_id", F.round("p", 6).alias("p")))
    return parts[0].unionAll(parts[1])
