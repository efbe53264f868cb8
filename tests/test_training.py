"""Whole models against an independent single-machine twin, and model round trips."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rareboost import Config, fit, load_model, save_model, train, transform
from rareboost.functions import losses
from rareboost.functions.hashing import row_uniform
from rareboost.operators import boosting
from rareboost.operators.folds import assign_folds, stratified_folds
from rareboost.operators.histogram import GainSplitter
from rareboost.operators.probability import platt_fit
from rareboost.operators.sampling import Adaptive, SegmentQuota, Uniform
from rareboost.operators.scoring import mode_from_flags, resolve_mode
from rareboost.plans.fixtures import FEATURES, lines, staged_lines
from rareboost.session import stage, unstage
from tests import twin

PLAIN = Config(
    n_rounds=5, learning_rate=0.1, max_depth=6, n_bins=64, col_subsample=1.0, sampler=Uniform(1.0), calibrate=False
)


@pytest.fixture(scope="module")
def table(spark, sf):
    return stage(stratified_folds(lines(spark, sf), 5).withColumn("u", row_uniform("uniform", 42, 0)).withColumn("u1", row_uniform("uniform", 42, 1)))


@pytest.fixture(scope="module")
def local(table):
    return table.orderBy("row_id").toPandas()


def margins(table, model, mode="margin"):
    return transform(table, model, mode, "m").select("row_id", "m").orderBy("row_id").toPandas()["m"].to_numpy()


def assert_same_trees(model, trees):
    for tree, (values, counts) in zip(model.trees, trees):
        assert tree.leaf_counts == counts
        assert np.allclose(tree.leaf_values, values, atol=1e-9)


def test_deep_model_equals_twin(table, local):
    model = train(table, FEATURES, PLAIN)
    pred, _, _, trees = twin.train(local[FEATURES].to_numpy(), local["y"].to_numpy(), 5, 0.1, 6, 64)
    assert_same_trees(model, trees)
    assert np.allclose(margins(table, model), pred, atol=1e-9)


def test_sampled_platt_model_equals_twin(table, local):
    """Weights, leaf calibration, out-of-fold scores and the Platt fit on them."""
    config = replace(PLAIN, n_rounds=2, max_depth=3, sampler=Uniform(0.7), calibrate=True, platt_scale=True)
    model = train(table, FEATURES, config)
    u = [local["u"].to_numpy(), local["u1"].to_numpy()]
    weights = lambda r: np.where(u[r] < 0.7, 1 / 0.7, 0.0)
    pred, prob, oof, trees = twin.train(
        local[FEATURES].to_numpy(), local["y"].to_numpy(), 2, 0.1, 3, 64, weights, local["fold"].to_numpy()
    )
    assert_same_trees(model, trees)
    assert np.allclose(margins(table, model), pred, atol=1e-9)
    assert np.allclose(margins(table, model, "calibrated"), prob, atol=1e-9)
    scores = table.sparkSession.createDataFrame(list(zip(oof.tolist(), local["y"].tolist())), "score double, y int")
    assert model.platt == pytest.approx(platt_fit(scores), abs=1e-6)


def test_purity_splitter_equals_twin(table, local):
    model = train(table, FEATURES, replace(PLAIN, n_rounds=1, max_depth=3, splitter=GainSplitter(purity_weight=40.0)))
    _, _, _, trees = twin.train(local[FEATURES].to_numpy(), local["y"].to_numpy(), 1, 0.1, 3, 64, purity=40.0)
    assert_same_trees(model, trees)


def test_training_does_not_depend_on_partitioning(table):
    config = replace(PLAIN, n_rounds=2, max_depth=2, sampler=Adaptive(0.2, 0.3, 0.5, 0.2), calibrate=True)
    models = [train(df, FEATURES, config) for df in (table, table.repartition(1), table.repartition(17, "l_tax"))]
    for other in models[1:]:
        for a, b in zip(models[0].trees, other.trees):
            assert [(n.feature, n.split_bin) for n in a.nodes] == [(n.feature, n.split_bin) for n in b.nodes]
            assert np.allclose(a.leaf_values, b.leaf_values, atol=1e-12)


def test_loss_never_rises_without_sampling(table):
    model = train(table, FEATURES, replace(PLAIN, n_rounds=4, max_depth=2))
    seen = []
    for n in range(len(model.trees) + 1):
        part = replace(model, trees=model.trees[:n])
        p = transform(table, part, "raw")
        seen.append(p.agg(F.avg(losses.log_loss(F.col("y"), F.col("p")))).collect()[0][0])
    assert all(b <= a for a, b in zip(seen, seen[1:]))


def test_missing_values_go_left_in_training_and_scoring(spark):
    """Training margins (from bins) and scoring margins (from values) agree with missing values."""
    rows = [(i, float("nan") if i % 7 == 0 else (None if i % 11 == 0 else float(i % 50)), float(i % 3), int(i % 50 > 30)) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, y int")
    model = train(df, ["a", "b"], replace(PLAIN, n_rounds=1, max_depth=3))
    from rareboost.operators.binning import fit_binner
    from rareboost.operators.scoring import leaf_index
    from rareboost.operators.trees import route_codes

    coded = df.withColumn("codes", fit_binner(df, ["a", "b"], 64).codes())
    both = route_codes(coded, model.trees[0], "by_bin").withColumn("by_value", leaf_index(model.trees[0], ["a", "b"]))
    assert both.where("by_bin <> by_value").count() == 0
    assert model.trees[0].n_leaves > 2


def test_save_and_load_score_equally(spark, table, tmp_path):
    model = replace(train(table, FEATURES, replace(PLAIN, n_rounds=2, max_depth=2, calibrate=True)), platt=(1.2, 0.1), isotonic=[(-3.0, 0.01), (0.0, 0.4)])
    model = model.with_pu_label_rate(0.5)
    save_model(spark, model, str(tmp_path / "m"))
    back = load_model(spark, str(tmp_path / "m"))
    for mode in ("margin", "calibrated", "platt", "isotonic", "pu", "auto"):
        assert np.array_equal(margins(table, model, mode), margins(table, back, mode))
    assert back == replace(model, trees=back.trees) and back.n_trees == 2


def test_modes_and_fallbacks(table):
    model = train(table, FEATURES, replace(PLAIN, n_rounds=1, max_depth=1))
    assert [resolve_mode(model, m) for m in ("auto", "platt", "isotonic", "calibrated")] == ["raw", "raw", "raw", "calibrated"]
    assert mode_from_flags(pu=True, platt=True) == "pu" and mode_from_flags(platt=True, calibrated=True) == "platt"
    empty = replace(model, trees=[])
    assert set(margins(table, empty, "calibrated")) == {0.5}
    assert np.allclose(margins(table, empty), model.init_score)
    with pytest.raises(ValueError):
        transform(table, model, "best")


def test_early_stopping_keeps_the_trailing_trees(table):
    model = train(table, FEATURES, replace(PLAIN, n_rounds=9, max_depth=1, learning_rate=1e-9, early_stopping_rounds=2))
    assert model.n_trees == 3


def test_raw_isotonic_skips_leaf_calibration_and_is_monotone(table):
    config = replace(PLAIN, n_rounds=1, max_depth=2, calibrate=True, platt_scale=True, raw_isotonic=True, k_folds=2)
    assert config.calibration == "isotonic"
    model = train(table, FEATURES, config)
    assert model.platt is None and not model.has_leaf_probabilities and model.isotonic
    scores, probs = zip(*model.isotonic)
    assert list(scores) == sorted(scores) and list(probs) == sorted(probs)


def test_quotas_and_temporal_folds_end_to_end(table):
    config = replace(
        PLAIN, n_rounds=1, max_depth=2, calibrate=True, fold_by="time", time="ts", segments=("seg_brand",),
        sampler=Adaptive(0.2, 0.1, 0.5, quotas=(SegmentQuota("seg_brand", 40, 0.1),)),
    )
    model = train(table, FEATURES, config)
    assert model.has_leaf_probabilities


def test_unseen_leaves_can_take_the_prior(spark, table):
    """A leaf whose rows share one fold has no out-of-fold rate: 0, or the prior when asked for."""
    from rareboost.operators.trees import Node, Tree

    rows = [(i, i % 2, i % 4 if i < 40 else 1, 0.1, 0.2, [0 if i < 40 else 1]) for i in range(50)]
    work = spark.createDataFrame(rows, "row_id int, y int, fold int, g double, h double, codes array<int>")
    for null_leaf, want in (("zero", 0.0), ("prior", 0.5)):
        tree = Tree([Node(0, 0, 0.5, 1), Node(leaf=0), Node(leaf=1)], [0.3, 0.7], [0.0, 0.0], [40, 10])
        boosting._calibrate(work, tree, replace(PLAIN, calibrate=True, null_leaf=null_leaf), 0.5)
        assert tree.leaf_probs[1] == want and tree.leaf_values[1] == 0.7 and tree.leaf_probs[0] > 0


def test_a_segment_may_also_be_a_feature(table):
    config = replace(
        PLAIN, n_rounds=1, max_depth=1, segments=("p_size",), sampler=Adaptive(0.2, 0.1, 0.5, quotas=(SegmentQuota("p_size", 30),))
    )
    assert train(table, FEATURES, config).n_trees == 1


def test_checkpoints_do_not_change_the_model(table):
    config = replace(PLAIN, n_rounds=3, max_depth=2)
    a = train(table, FEATURES, replace(config, checkpoint_every=1))
    b = train(table, FEATURES, replace(config, checkpoint_every=100))
    assert [t.leaf_values for t in a.trees] == [t.leaf_values for t in b.trees]


def test_presets_and_defaults():
    bce, focal = boosting.default_bce(), boosting.focal_calibrated(2.0, 0.25)
    assert (bce.n_rounds, bce.learning_rate, bce.max_depth, bce.min_child_weight, bce.early_stopping_rounds) == (300, 0.05, 6, 1.0, 20)
    assert (focal.n_rounds, focal.max_depth, focal.min_child_weight) == (200, 7, 5.0)
    assert focal.splitter.purity_weight == 0.1 and focal.splitter.min_positives == 5
    assert bce.sampler == focal.sampler == Adaptive(0.2, 0.1, 0.5, 0.0, 42)
    cli = boosting.command_line_config(early_stopping_rounds=0)
    assert cli.early_stopping_rounds is None and cli.sampler == Uniform(0.8, 42) and not cli.calibrate
    assert Config().sampler == Adaptive(0.2, 0.8, 0.5, 0.0, 42)


def test_fit_rejects_bad_input(spark, table):
    empty = table.limit(0)
    with pytest.raises(ValueError, match="empty"):
        fit(empty, FEATURES)
    with pytest.raises(ValueError, match="not found"):
        fit(table, ["nope"])
    with pytest.raises(ValueError, match="label"):
        fit(table.withColumn("y", F.when(F.col("l_tax") > 0, F.col("y"))), FEATURES)
    with pytest.raises(ValueError, match="unknown loss"):
        fit(table, FEATURES, loss="hinge")


def test_fit_returns_a_booster(table):
    booster = fit(table, FEATURES, n_rounds=1, max_depth=2)
    assert booster.n_trees == 1
    p = booster.predict_proba(table).agg(F.min("p"), F.max("p")).collect()[0]
    assert 0 <= p[0] <= p[1] <= 1
    assert booster.predict_raw(table).columns[-1] == "raw"


def test_the_presets_query_trains_the_presets_as_defined(spark, sf, monkeypatch):
    from rareboost.plans import catalog_trees

    seen = []

    def record(df, features, config):
        seen.append(config)
        return boosting.train(df, features, replace(config, n_rounds=1, max_depth=1))

    monkeypatch.setattr(catalog_trees, "train", record)
    out = catalog_trees.b4(spark, sf)
    assert seen == [boosting.default_bce(), boosting.focal_calibrated(2.0, 0.25)]
    assert out.count() == 2 * lines(spark, sf).count()


def test_early_stopping_query_improves_then_stalls(spark, sf, table, local):
    """The twin's loss after every round: best after some rounds, then two rounds no better, which are kept."""
    from rareboost.plans.catalog_trees import b3

    draws = table.select("row_id", *[row_uniform("uniform", 42, r).alias(f"d{r}") for r in range(6)]).orderBy("row_id").toPandas()
    y, losses_ = local["y"].to_numpy(), []
    for n in range(1, 7):
        weights = lambda r: np.where(draws[f"d{r}"].to_numpy() < 0.8, 1 / 0.8, 0.0)
        pred = twin.train(local[FEATURES].to_numpy(), y, n, 1.05, 2, 32, weights=weights)[0]
        p = np.clip(twin.sigmoid(pred), losses.EPS, 1 - losses.EPS)
        losses_.append(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    best = next(i for i in range(4) if min(losses_[i + 1], losses_[i + 2]) >= losses_[i] - 1e-6)
    assert best >= 2 and losses_[:best + 1] == sorted(losses_[:best + 1], reverse=True)
    got = b3(spark, sf).collect()[0]
    assert got["n_trees"] == best + 3 and got["log_loss"] == pytest.approx(losses_[best + 2], abs=2e-6)


def test_calibration_precedence_query_trains_the_demo_model(spark, sf, con, local):
    """No and leaf calibration against SQL, Platt against the twin, isotonic against a fit on held-out scores."""
    from rareboost.operators.boosting import held_out_scores
    from rareboost.plans.catalog_calibration import c16
    from rareboost.plans.fixtures import sigmoid_sql
    from rareboost.plans.models import DEMO
    from rareboost.plans.oracles import boost_sql

    got = {r["calibration"]: (r["mode"], r["mean_p"]) for r in c16(spark, sf).collect()}
    assert {c: m for c, (m, _) in got.items()} == {"none": "raw", "leaf": "calibrated", "platt": "platt", "isotonic": "isotonic"}
    raw = con.execute(f"WITH {boost_sql(calibrate=False)} SELECT avg({sigmoid_sql('pred')}) FROM state2").fetchone()[0]
    leaf = con.execute(f"WITH {boost_sql()} SELECT avg((prob0 + prob1) / 2) FROM state2").fetchone()[0]
    assert got["none"][1] == pytest.approx(raw, abs=2e-6) and got["leaf"][1] == pytest.approx(leaf, abs=2e-6)
    u, y = [local["u"].to_numpy(), local["u1"].to_numpy()], local["y"].to_numpy()
    weights = lambda r: np.where(u[r] < 0.8, 1 / 0.8, 0.0)
    pred, _, oof, _ = twin.train(local[FEATURES].to_numpy(), y, 2, 0.3, 2, 32, weights=weights, fold=local["fold"].to_numpy(), k=5)
    a, b = platt_fit(spark.createDataFrame([(float(s), int(t)) for s, t in zip(oof, y)], "score double, y int"))
    assert got["platt"][1] == pytest.approx(twin.sigmoid(a * pred + b).mean(), abs=2e-6)
    held = held_out_scores(lines(spark, sf), FEATURES, replace(DEMO, raw_isotonic=True)).groupBy("score").agg(F.avg("y"), F.count("*")).collect()
    points = sorted(tuple(float(x) for x in r) for r in held)
    fit_ = isotonic_brute(points)
    margin = margins(lines(spark, sf), train(lines(spark, sf), FEATURES, replace(DEMO, calibrate=False)))
    assert got["isotonic"][1] == pytest.approx(np.interp(margin, [s for s, _, _ in points], fit_).mean(), abs=2e-4)


def isotonic_brute(points):
    """Max-min form of the isotonic fit of (score, rate, weight)."""
    r, w = np.array([p[1] for p in points]), np.array([p[2] for p in points])
    n = len(points)
    mean = lambda j, k: (r[j:k + 1] * w[j:k + 1]).sum() / w[j:k + 1].sum()
    return [max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]


def test_a_staged_table_is_trained_on_where_it_lies(table, monkeypatch):
    copies = []
    monkeypatch.setattr(boosting, "stage", lambda df, *a: copies.append(df) or stage(df, *a))
    config = replace(PLAIN, n_rounds=1, max_depth=2, calibrate=True, raw_isotonic=True, k_folds=2)
    model = train(table, FEATURES, config)
    # Bins and predictions only, of the model and of each fold's.
    assert model.isotonic and ["codes" in df.columns for df in copies] == [True] * 3
    copies.clear()
    assert train(table.where("true"), FEATURES, replace(PLAIN, n_rounds=1, max_depth=2)).n_trees == 1 and len(copies) == 2


def test_lines_are_staged_once_and_again_when_dropped(spark, sf):
    first = staged_lines(spark, sf)
    assert staged_lines(spark, sf) is first
    unstage(first)
    again = staged_lines(spark, sf)
    assert again is not first and again.count() == lines(spark, sf).count()


@pytest.mark.parametrize("by", ["random", "shuffled"])
def test_a_fold_hashes_the_key_once_per_pass(table, by):
    """A filter on the fold repeated the hash for every comparison with a fold's end."""
    folded = assign_folds(table, 5, by)
    plan = folded.where("fold <> 1").select("row_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    assert sorted(sizes) == list(range(5)) and max(sizes.values()) - min(sizes.values()) <= 2


def test_held_out_scores_are_those_of_each_folds_model_from_one_pass(table):
    config = replace(PLAIN, n_rounds=2, max_depth=2, k_folds=3, fold_by="shuffled")
    held = boosting.held_out_scores(table, FEATURES, config)
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation") == 1
    got = {r["row_id"]: r for r in held.collect()}
    folded = assign_folds(table, 3, "shuffled", config.fold_seed)
    seed = lambda k: config.seed + k * boosting.FOLD_SEED_STRIDE
    for k in range(3):
        model = train(folded.where(F.col("fold") != k), FEATURES, replace(config, calibrate=False, seed=seed(k)))
        want = transform(folded.where(F.col("fold") == k), model, "margin", "m").select("row_id", "m").collect()
        assert all(got[r["row_id"]]["fold"] == k and got[r["row_id"]]["score"] == pytest.approx(r["m"], abs=1e-9) for r in want)
    assert len(got) == table.count()


def test_one_pass_counts_the_classes_outside_of_every_fold(spark):
    rows = [(0, 1.0), (0, 0.0), (1, 0.0), (1, 0.0), (1, 1.0)]
    got = boosting._priors_without(spark.createDataFrame(rows, "fold int, y double"), 3)
    assert got == [{"n": 3, "n_pos": 1, "prior": 1 / 3}, {"n": 2, "n_pos": 1, "prior": 0.5}, {"n": 5, "n_pos": 2, "prior": 0.4}]
