"""Edge frames, skewed groups and brute-force checks of single operators."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rareboost import session
from rareboost.functions.hashing import row_hash
from rareboost.operators import boosting, encoding, folds, metrics, probability, sampling, scoring
from rareboost.operators.binning import cut_points, fit_binner
from rareboost.operators.encoding import FeatureSet, target_encode, target_encode_oof
from rareboost.operators.folds import shuffled_folds, stratified_folds, stratified_holdout, temporal_folds
from rareboost.operators.histogram import build, totals
from rareboost.operators import leaf_calibration as calibration
from rareboost.operators import posthoc
from rareboost.session import stage
from rareboost.sources import tables
from tests import twin

INF, NAN = float("inf"), float("nan")


# --- binning --------------------------------------------------------------------------


def test_binning_of_edge_columns(spark):
    n = 300
    columns = {
        "constant": [5.0] * n, "all_nan": [NAN] * n, "all_null": [None] * n, "two": [float(i % 2) for i in range(n)],
        "infinite": [[-INF, 1.0, INF][i % 3] for i in range(n)], "many": [float(i) for i in range(n)],
    }
    rows = list(zip(range(n), *columns.values()))
    df = spark.createDataFrame(rows, "row_id int, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    binner = fit_binner(df, list(columns), 16)
    assert binner.n_bins == [1, 1, 1, 2, 1, 16]
    coded = {r["row_id"]: [c % 256 for c in r["codes"]] for r in df.select("row_id", binner.codes().alias("codes")).collect()}
    for j, (name, values) in enumerate(columns.items()):
        t = np.array(binner.uppers[j])
        v = np.array([NAN if x is None else x for x in values])
        assert np.array_equal(t, twin.thresholds(v, 16)), name
        want = [0 if math.isnan(x) else min(int(np.searchsorted(t, x)), len(t) - 1) for x in v]
        assert [coded[i][j] for i in range(n)] == want, name


@pytest.mark.parametrize("n_bins", [1, 257])
def test_bin_count_limits(spark, n_bins):
    with pytest.raises(ValueError):
        cut_points(spark.createDataFrame([(1.0,)], "a double"), ["a"], n_bins)


def test_histogram_totals_equal_the_sample(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(4), 256 + rng.randrange(3)], rng.random(), 0.5, 2.0, rng.randrange(2), rng.randrange(3)) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id int, codes array<int>, g double, h double, ipc_w double, y int, node int")
    for r in totals(build(df, 2)).collect():
        mine = [x for x in rows if x[6] == r["node"]]
        assert r["cnt"] == len(mine) and r["cnt_pos"] == sum(x[5] for x in mine)
        assert r["sum_g"] == pytest.approx(sum(2 * x[2] for x in mine)) and r["sum_h"] == pytest.approx(len(mine))


# --- folds ----------------------------------------------------------------------------


def test_temporal_folds_follow_time(spark):
    df = spark.createDataFrame([(i, i * 100) for i in range(10)], "row_id int, ts long").repartition(3)
    fold = lambda d, k: [r["fold"] for r in temporal_folds(d, "ts", k).orderBy("ts", "row_id").collect()]
    assert fold(df, 4) == [0, 0, 0, 1, 1, 2, 2, 2, 3, 3]
    assert fold(df, 5) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    tied = temporal_folds(df.withColumn("ts", F.lit(7)), "ts", 4).groupBy("fold").count().collect()
    assert sorted((r["fold"], r["count"]) for r in tied) == [(0, 3), (1, 2), (2, 3), (3, 2)]


@pytest.mark.parametrize("column", ["timestamp '2024-03-31 02:30:00'", "timestamp_ntz '2024-03-31 02:30:00'", "date '2024-03-31'"])
def test_temporal_folds_take_any_time_type(spark, column):
    days = spark.range(8).selectExpr("id AS row_id", f"{column} + make_interval(0, 0, 0, cast(id AS int)) AS ts")
    assert [r["fold"] for r in temporal_folds(days, "ts", 2).orderBy("row_id").collect()] == [0] * 4 + [1] * 4


def test_stratified_folds_balance_both_classes(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(103)], "row_id int, y int")
    counts = {}
    for r in stratified_folds(df, 5).groupBy("y", "fold").count().collect():
        counts.setdefault(r["y"], []).append(r["count"])
    assert len(counts[0]) == len(counts[1]) == 5
    assert max(counts[0]) - min(counts[0]) <= 1 and max(counts[1]) - min(counts[1]) <= 1


@pytest.mark.parametrize("labels", [[1] * 7, [0] * 7, [1], [0, 1]])
def test_folds_of_one_class_and_tiny_tables(spark, labels):
    df = spark.createDataFrame(list(enumerate(labels)), "row_id int, y int")
    for folded in (stratified_folds(df, 3), shuffled_folds(df, 3)):
        got = [r["fold"] for r in folded.collect()]
        assert len(got) == len(labels) and all(0 <= f < 3 for f in got)


def test_folds_need_two(spark):
    with pytest.raises(ValueError):
        stratified_folds(spark.range(3), 1)


def test_holdout_is_exact(spark):
    df = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(1000)], "row_id int, y int")
    got = {r["y"]: r["count"] for r in stratified_holdout(df, 300).where("is_test").groupBy("y").count().collect()}
    assert got == {0: 285, 1: 15}


# --- samplers -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def gradients(spark):
    """A third of all rows in one segment, and few distinct gradients."""
    rng = random.Random(11)
    rows = []
    for i in range(9000):
        y = int(rng.random() < 0.06)
        seg = "hot" if i % 3 == 0 else f"s{rng.randrange(400)}"
        p = rng.choice([0.02, 0.05, 0.2])
        rows.append((i, y, p - y, p * (1 - p), seg))
    return spark.createDataFrame(rows, "row_id int, y int, g double, h double, seg string").repartition(6).persist()


def test_sampler_weights_are_unbiased(gradients):
    for sampler in (sampling.Uniform(0.3), sampling.Goss(0.1, 0.2), sampling.Adaptive(0.1, 0.2, 0.5)):
        total = np.mean([sampler.sample(gradients, r).agg(F.sum("ipc_w")).collect()[0][0] for r in range(4)])
        assert total == pytest.approx(9000, rel=0.05)


def test_goss_top_is_exact_with_ties(gradients):
    assert sampling.Goss(0.2, 0.1).sample(gradients, 0).where("stratum = 'top'").count() == 1800


def test_adaptive_threshold_keeps_ties_and_counts_quotas(gradients):
    local = gradients.toPandas()
    ag = local["g"].abs()
    thr = ag.sort_values(ascending=False).iloc[math.ceil(9000 * 0.2) - 1]
    got = {r["stratum"]: r["count"] for r in sampling.Adaptive(0.2, 0.1, 0.5).sample(gradients, 0).groupBy("stratum").count().collect()}
    rest = local[ag < thr]
    budget = math.ceil(len(rest) * 0.1)
    n_pos = min(int((rest["y"] == 1).sum()), math.floor(budget * 0.5 + 0.5))
    assert got.get("pos_top", 0) + got.get("neg_top", 0) == (ag >= thr).sum()
    assert got.get("pos_rest", 0) == n_pos and got["neg_rest"] == budget - math.floor(budget * 0.5 + 0.5)


def test_keep_nothing_and_natural_target(gradients):
    got = sampling.Adaptive(0.0, 0.1, None).sample(gradients, 0)
    assert got.where("stratum like '%top'").count() == 0
    share = gradients.agg(F.avg("y")).collect()[0][0]
    assert got.where("y = 1").count() == math.floor(900 * share + 0.5)


def test_segment_floor_and_cap_with_a_hot_segment(gradients):
    quota = sampling.SegmentQuota("seg", min_per_segment=5, max_fraction=0.05)
    only_floor = sampling.Adaptive(0.02, 0.05, 0.5, quotas=(sampling.SegmentQuota("seg", 5, 1.0),)).sample(gradients, 0)
    size = {r["seg"]: r["count"] for r in gradients.groupBy("seg").count().collect()}
    drawn = {r["seg"]: r["count"] for r in only_floor.groupBy("seg").count().collect()}
    assert all(drawn.get(s, 0) >= min(5, n) for s, n in size.items())
    total = sum(drawn.values())
    capped = sampling.Adaptive(0.02, 0.05, 0.5, quotas=(quota,)).sample(gradients, 0)
    after = {r["seg"]: r["count"] for r in capped.groupBy("seg").count().collect()}
    cap = math.ceil(total * 0.05)
    assert after == {s: min(n, cap) for s, n in drawn.items()} and drawn["hot"] > cap


def test_samples_are_bags(gradients):
    """Boundary rows are added on top of the strata, weighted by their own rate."""
    got = sampling.Adaptive(0.01, 1.0, None, bonus=0.5).sample(gradients, 0)
    extra = got.where("stratum = 'bonus'")
    assert extra.count() > 0 and got.groupBy("row_id").count().where("count > 1").count() > 0
    assert {r["ipc_w"] for r in extra.collect()} == {2.0}


def test_sampler_rates_are_checked():
    for make in (lambda: sampling.Uniform(0.0), lambda: sampling.Goss(1.0, 0.1), lambda: sampling.Goss(0.1, 0.0)):
        with pytest.raises(ValueError):
            make()


# --- probability maps -----------------------------------------------------------------


def points(spark, rows):
    return spark.createDataFrame(rows, "score double, y double, w double")


@pytest.mark.parametrize("rows", [
    [(0.0, 0.9, 1.0), (1.0, 0.1, 1.0), (2.0, 0.5, 1.0), (3.0, 0.8, 1.0)],
    [(float(i), 1.0 - i / 10, 1.0) for i in range(10)],
    [(0.0, 0.5, 1.0), (1.0, 0.4, 1000.0), (2.0, 0.9, 1.0), (3.0, 0.2, 5.0)],
    [(float(i), random.Random(i).random(), 1.0 + i % 3) for i in range(200)],
])
def test_isotonic_equals_pooling(spark, rows):
    got = [r["fitted"] for r in probability.isotonic_fit(points(spark, rows).repartition(4)).orderBy("score").collect()]
    assert np.allclose(got, twin.pav(rows), atol=1e-12)
    assert all(a <= b + 1e-12 for a, b in zip(got, got[1:]))


def test_breakpoints_and_interpolation(spark):
    rows = [(s, y) for s, ys in ((0.0, [0, 0]), (1.0, [1, 0]), (2.0, [0, 0, 1, 0]), (3.0, [1, 0]), (4.0, [1])) for y in ys]
    df = spark.createDataFrame(rows, "score double, y int").repartition(3)
    bps = probability.collect_breakpoints(probability.isotonic_breakpoints(df))
    # Scores 1 and 2 pool to 2/6; the middle of two points is the first of them.
    assert bps == [(0.0, 0.0), (1.0, pytest.approx(1 / 3)), (1.0, pytest.approx(1 / 3)), (2.0, pytest.approx(1 / 3)), (3.0, 0.5), (4.0, 1.0)]
    probe = spark.createDataFrame([(v,) for v in (-5.0, 0.5, 1.0, 1.5, 2.5, 4.0, 9.0)], "v double")
    got = [r[0] for r in probe.select(probability.isotonic_apply(F.col("v"), bps)).collect()]
    assert got == pytest.approx([0.0, 1 / 6, 1 / 3, 1 / 3, 5 / 12, 1.0, 1.0], abs=1e-8)
    assert probability.isotonic_breakpoints(df.limit(0)).count() == 0
    no_map = probe.select(probability.isotonic_apply(F.col("v"), [])).collect()[0][0]
    assert no_map == pytest.approx(1 / (1 + math.exp(5)))


def test_platt_of_empty_and_separable_scores(spark):
    df = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)], "score double, y int")
    assert probability.platt_fit(df.limit(0)) == (1.0, 0.0)
    a, b = probability.platt_fit(df)
    assert a > 0 and math.isfinite(b)


def test_label_rate_estimators(spark):
    df = spark.createDataFrame([(0.2, 1), (0.6, 1), (0.4, 1), (0.8, 1), (0.99, 0)], "score double, y int")
    assert probability.pu_label_rate(df, "mean") == pytest.approx(0.5)
    assert probability.pu_label_rate(df, "max") == 0.8 and probability.pu_label_rate(df, "median") == 0.6
    assert all(probability.pu_label_rate(df.where("y = 0"), e) == 1.0 for e in ("mean", "max", "median"))
    with pytest.raises(ValueError):
        probability.pu_label_rate(df, "mode")


def test_leaf_calibration_with_empty_and_single_fold_leaves(spark):
    rng = random.Random(8)
    rows = [(i, l, f, rng.gauss(0, 1), 0.1 + rng.random(), int(rng.random() < 0.3)) for i, (l, f) in enumerate(
        [(l, f) for l in range(3) for f in range(4) for _ in range(12) if (l, f) != (1, 2)] + [(3, 1)] * 5)]
    df = spark.createDataFrame(rows, "row_id int, leaf int, fold int, g double, h double, y int")
    a = np.array([r[1:] for r in rows])
    prior = min(max((a[:, 4] > 0.5).mean(), 1e-4), 1 - 1e-4)
    stats = calibration.fold_values(calibration.fold_statistics(df), 1.0, prior)
    leaves = {r["leaf"]: r for r in calibration.calibrated_leaves(stats).collect()}
    values, probs, per_row = twin.calibrate(a[:, 0].astype(int), np.zeros(4), a[:, 2], a[:, 3], a[:, 4], a[:, 1], 4, 1.0)
    assert 3 not in leaves
    for l in range(3):
        assert leaves[l]["value"] == pytest.approx(values[l], abs=1e-12) and leaves[l]["prob"] == pytest.approx(probs[l], abs=1e-12)
    got = calibration.row_values(df, stats, calibration.calibrated_leaves(stats)).orderBy("row_id").toPandas()["oof_value"]
    assert np.allclose(got, per_row, atol=1e-12)


# --- metrics --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    draws = [(i, m, round(rng.random() if m == "a" else rng.choice([0.0, 0.5, 1.0]), 2)) for i in range(2000) for m in "ab"]
    rows = [(i, m, int(rng.random() < 0.1 + 0.3 * p), p) for i, m, p in draws]
    return spark.createDataFrame(rows, "row_id int, model string, y int, p double").repartition(5).persist()


def brute(y, p):
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    prauc, last, recall1 = 0.0, 0, 0.0
    for t in sorted(set(p), reverse=True):
        tp, fp = ((p >= t) & (y == 1)).sum(), ((p >= t) & (y == 0)).sum()
        prauc += (tp - last) / len(pos) * tp / (tp + fp)
        last = tp
        if fp / len(neg) <= 0.01:
            recall1 = max(recall1, tp / len(pos))
    q = np.clip(p, 1e-7, 1 - 1e-7)
    edges, ece = np.linspace(0, 1, 11), 0.0
    for lo, hi in zip(edges[:-1], edges[1:]):
        m = (q >= lo) & (q < hi)
        ece += abs(y[m].sum() - q[m].sum())
    return dict(auc=auc, prauc=prauc, r1pct=recall1, ece=ece / len(y), brier=((q - y) ** 2).mean(),
                logloss=-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())


def test_metric_record_equals_brute_force(scored):
    local = scored.toPandas()
    for r in metrics.evaluate(scored, ["model"]).collect():
        mine = local[local["model"] == r["model"]]
        for name, want in brute(mine["y"].to_numpy(), mine["p"].to_numpy()).items():
            assert r[name] == pytest.approx(want, abs=1e-9), (r["model"], name)
        top = mine.sort_values("p", ascending=False)["p"].iloc[99]
        assert r["p5pct"] <= 1 and (mine["p"] >= top).sum() >= 100


def test_metrics_of_one_class_are_null(scored):
    r = metrics.ranking_metrics(scored.where("y = 0"), ["model"]).collect()[0]
    assert r["auc"] is None and r["prauc"] is None and r["r1pct"] is None


def test_metrics_without_groups(scored):
    whole = scored.where("model = 'a'")
    local = whole.toPandas()
    got = metrics.ranking_metrics(whole, []).collect()[0]
    assert got["auc"] == pytest.approx(brute(local["y"].to_numpy(), local["p"].to_numpy())["auc"])
    assert metrics.precision_at_top(whole, []).count() == 1


def test_a_score_of_one_lies_in_no_calibration_bin(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 0), (0.3, 1), (0.30000000000000004, 0)], "p double, y int")
    # 0.3 lies below the fourth edge (0.30000000000000004), the next value in the bin above.
    assert metrics.calibration_error(df, []).collect()[0]["ece"] == pytest.approx((0.7 + 0.3) / 4)


def test_dual_calibration_is_monotone_and_calibrated(scored):
    df = scored.where("model = 'a'")
    out = posthoc.dual(df, df, "q").toPandas().sort_values("p")
    assert (out["q"].diff().dropna() >= -1e-9).all()
    assert out["q"].mean() == pytest.approx(out["y"].mean(), abs=0.02)


# --- encodings and sources ------------------------------------------------------------


def test_encodings_with_a_hot_category(spark):
    rng = random.Random(6)
    rows = [(i, "hot" if i % 3 == 0 else f"c{rng.randrange(20)}", int(rng.random() < 0.2), i % 4) for i in range(1200)]
    df = spark.createDataFrame(rows, "row_id int, c string, y int, fold int").repartition(4)
    mean = sum(r[2] for r in rows) / len(rows)
    got = {r["row_id"]: r["e"] for r in target_encode_oof(df, ["c"], "e").collect()}
    for i, c, _, f in rows[:200]:
        other = [r[2] for r in rows if r[1] == c and r[3] != f]
        assert got[i] == pytest.approx((sum(other) + 10 * mean) / (len(other) + 10))
    unseen = target_encode(df, spark.createDataFrame([(1, "new")], "row_id int, c string"), ["c"], "e").collect()[0]["e"]
    assert unseen == pytest.approx(mean)


def test_feature_set_columns(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2, i % 5 == 0, i % 4) for i in range(60)], "row_id int, a int, b int, y boolean, fold int")
    df = df.withColumn("y", F.col("y").cast("int"))
    fs = FeatureSet(("a", "b"), (("a", "b"),), ("a",))
    assert fs.train_rows(df).columns == df.columns + fs.names == df.columns + ["te_a", "te_b", "te_a_b", "freq_a"]
    assert fs.other_rows(df, df.select("row_id", "a", "b")).count() == 60


def test_csv_reads_blanks_and_rejects_words(spark, tmp_path):
    (tmp_path / "good.csv").write_text("1, 2.5 ,0\n 3,4,1\n")
    (tmp_path / "bad.csv").write_text("1,x,0\n")
    good = tables.read_labelled_csv(spark, str(tmp_path / "good.csv"), ["a", "b"])
    assert sorted(tuple(r) for r in good.collect()) == [(1.0, 2.5, 0.0), (3.0, 4.0, 1.0)]
    with pytest.raises(Exception):
        tables.read_labelled_csv(spark, str(tmp_path / "bad.csv"), ["a", "b"]).collect()


# --- missing values and names that used to change answers without a word ---------------


def test_glued_names_stay_apart(spark):
    rows = [(f"r{i}", a, b, i / 100, float(i % 3 == 0)) for i in range(60) for a, b in ((("a|b", "c"), ("a", "b|c"), (None, "c")))]
    df = spark.createDataFrame([(f"{r[0]}-{r[1]}-{r[2]}", *r[1:]) for r in rows], "row_id string, g string, s string, p double, y double")
    got = metrics.evaluate(df, ["g", "s"]).collect()
    assert sorted(((r["g"], r["s"]) for r in got), key=str) == sorted([("a|b", "c"), ("a", "b|c"), (None, "c")], key=str)
    assert all(r["auc"] is not None and r["p5pct"] is not None for r in got)


def test_precision_at_top_of_tied_scores(spark):
    df = spark.createDataFrame([(f"r{i}", 0.5, float(i < 30)) for i in range(100)], "row_id string, p double, y double")
    hashed = df.withColumn("h", row_hash("top-tie")).toPandas().sort_values(["h", "row_id"])
    assert metrics.precision_at_top(df, []).first()["p5pct"] == pytest.approx(hashed["y"].head(5).mean())


def test_unknown_names_raise(spark):
    df = spark.createDataFrame([(f"r{i}", i, float(i % 2)) for i in range(20)], "row_id string, ts int, y double")
    with pytest.raises(ValueError, match="fold strategy"):
        folds.assign_folds(df, 5, "typo")
    with pytest.raises(ValueError, match="sampler"):
        sampling.sampler_by_name("typo", 0.5)
    with pytest.raises(ValueError, match="unknown loss"):
        boosting.command_line_config(loss="typo")
    assert folds.assign_folds(df, 5, "temporal", time="ts").where("fold <> ts div 4").count() == 0
    missing = df.withColumn("ts", F.when(F.col("ts") > 9, F.col("ts")))
    with pytest.raises(ValueError, match="10 rows without a time"):
        folds.temporal_folds(missing, "ts", 5)


def test_quota_needs_its_column(spark):
    df = spark.createDataFrame([(f"r{i}", float(i % 2), 0.1 * i, "a" if i else None) for i in range(60)], "row_id string, y double, x double, seg string")
    config = boosting.Config(n_rounds=1, max_depth=1, k_folds=2, sampler=sampling.Adaptive(quotas=(sampling.SegmentQuota("country", 5),)))
    with pytest.raises(ValueError, match="country"):
        boosting.train(df, ["x"], config)
    # A quota's column is carried without being named as a segment.
    config = boosting.Config(n_rounds=1, max_depth=1, k_folds=2, sampler=sampling.Adaptive(quotas=(sampling.SegmentQuota("seg", 5),)))
    assert boosting.train(df, ["x"], config).n_trees == 1


def test_missing_segment_is_topped_up(spark):
    df = spark.createDataFrame(
        [(f"r{i}", float(i % 2), 0.001 * i, 0.2, None if i < 40 else "x") for i in range(400)],
        "row_id string, y double, g double, h double, seg string",
    )
    quota = sampling.SegmentQuota("seg", 20)
    drawn = sampling.Adaptive(0.2, 0.1, 0.5, quotas=(quota,)).sample(df, 0)
    assert drawn.where("seg is null").count() == 20


def test_repeated_keys_raise(spark):
    df = spark.createDataFrame([("a", 1.0)] * 50 + [("b", 2.0)], "row_id string, x double")
    with pytest.raises(ValueError, match="unique"):
        sampling.draw_without_replacement(df, 10).count()
    table = df.withColumn("y", F.lit(1.0))
    with pytest.raises(ValueError, match="repeats"):
        tables.labelled_table(table, ["x"])
    with pytest.raises(ValueError, match="without a row_id"):
        tables.labelled_table(table.withColumn("row_id", F.nullif("row_id", F.lit("b"))).dropDuplicates(), ["x"])


def test_missing_category_has_its_own_rate(spark):
    train = spark.createDataFrame([(f"r{i}", None if i < 25 else "a", float(i < 20)) for i in range(50)], "row_id string, c string, y double")
    rows = spark.createDataFrame([("n", None), ("a", "a"), ("b", "b")], "row_id string, c string")
    got = {r["row_id"]: r["e"] for r in encoding.target_encode(train, rows, ["c"], "e").collect()}
    assert got == pytest.approx({"n": (20 + 4) / 35, "a": 4 / 35, "b": 0.4})


def test_rows_of_a_csv_get_keys(spark, tmp_path):
    rows = [(float(i % 7), float(i % 3), float(i % 2)) for i in range(300)]
    spark.createDataFrame(rows, "a double, b double, y double").write.csv(str(tmp_path / "t"))
    df = tables.read_labelled_csv(spark, str(tmp_path / "t"), ["a", "b"])
    keyed = tables.with_row_key(df)
    keys = sorted(r["row_id"] for r in keyed.collect())
    assert len(set(keys)) == 300
    assert keys == sorted(r["row_id"] for r in tables.with_row_key(df.repartition(5)).collect())
    config = boosting.Config(n_rounds=2, max_depth=2, sampler=sampling.Uniform(1.0), col_subsample=1.0, calibrate=False, min_samples_leaf=1)
    model, by_key = boosting.train(df, ["a", "b"], config), boosting.train(keyed, ["a", "b"], config)
    assert np.allclose([t.leaf_values for t in model.trees], [t.leaf_values for t in by_key.trees])
    assert scoring.transform(df, model, "raw").count() == 300


def test_targets_of_many_categories_meet_by_their_widest_column(spark, monkeypatch):
    """Crowded and missing categories included, the same rates as by a join for each target; no target moves the rows by itself."""
    rows = [(i, None if i % 11 == 0 else i % 7 if i % 2 else 100, f"s{i % 3}", i % 4, i % 5, float(i % 13 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id int, a int, b string, c int, fold int, y double").repartition(5)
    fs = FeatureSet(("a", "b"), (("a", "b"), ("a", "c")), ("b",), smoothing=2.0)
    joined = {r["row_id"]: r for r in fs.train_rows(df).collect()}
    monkeypatch.setattr(encoding, "MANY", 4)
    for crowd in (1 << 20, 50):
        monkeypatch.setattr(encoding, "CROWD", crowd)
        met = fs.train_rows(df)
        assert met.columns == df.columns + fs.names
        out = met.collect()
        assert len(out) == len(rows)
        assert all(abs(r[n] - joined[r["row_id"]][n]) < 1e-12 for r in out for n in fs.names)
    monkeypatch.setattr(encoding, "CROWD", 1 << 20)
    plan = fs.train_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("REPARTITION_BY_COL") == 1 and "SortMergeJoin" not in plan


def test_isotonic_points_are_computed_once(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(probability, "stage", lambda df: staged.append(stage(df)) or staged[-1], raising=False)
    fitted = probability.isotonic_fit(spark.createDataFrame([(0.1, 1.0, 1.0), (0.4, 0.0, 2.0)], "score double, y double, w double"))
    assert len(staged) == 1 and fitted.count() == 2


def test_large_tables_in_few_files_are_not_dealt_out(spark, sf, monkeypatch):
    table = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert session.spread(table, "l_orderkey") is not table or len(table.inputFiles()) >= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "SMALL", 1, raising=False)
    assert session.spread(table, "l_orderkey") is table


def test_caps_read_the_drawn_rows_only(spark):
    segments = {f"s{i}": (F.col("id") % (i + 2)).cast("string") for i in range(3)}
    base = spark.range(0, 4000, 1, 4).select(
        F.concat(F.lit("r"), F.col("id")).alias("row_id"), (F.col("id") % 10 == 0).cast("double").alias("y"),
        (F.sin("id") / 2).alias("g"), F.lit(0.2).alias("h"), *[c.alias(n) for n, c in segments.items()],
    ).localCheckpoint()

    def scanned(n_caps: int) -> tuple[int, int]:
        seen = spark.sparkContext.accumulator(0)

        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        rows = base.mapInArrow(count, base.schema)
        quotas = tuple(sampling.SegmentQuota(f"s{i}", 0, 0.2) for i in range(n_caps))
        drawn = sampling.Adaptive(0.2, 0.1, 0.5, quotas=quotas).sample(rows, 0).count()
        return drawn, seen.value

    (one, read), (three, read_more) = scanned(1), scanned(3)
    assert 0 < three < one
    assert read_more == read


def test_fold_models_share_the_passes_over_the_rows(spark):
    from rareboost.operators.binning import fit_fold_binners

    rng = random.Random(3)
    rows = [(i % 3, float(rng.randrange(40)), None if i % 7 == 0 else rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows + [(1, 1e6, float("nan"))], "fold int, a double, b double").repartition(2).localCheckpoint()
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    found = fit_fold_binners(df.mapInArrow(count, df.schema), ["a", "b"], 16, 3)
    assert seen.value == 301
    assert found == [fit_binner(df.where(F.col("fold") != k), ["a", "b"], 16) for k in range(3)]
    assert found[0] != found[1]


def test_floor_counts_repeated_rows_at_its_edge(spark):
    rows = spark.createDataFrame([(f"r{i // 3}", "a") for i in range(30)], "row_id string, s string")
    rows = rows.withColumn("_draws", F.array().cast(sampling._DRAWS))
    with session.Scratch() as scratch:
        topped, taken = sampling.apply_floor(rows, rows.where("false"), sampling.SegmentQuota("s", 4), 1, 0, 5, scratch)
        key = lambda df: sorted((r["row_id"], r["draw_seq"]) for r in sampling.drawn(df).collect())
        assert len(key(topped)) == 6
        assert key(taken) == key(topped)


def test_only_rows_at_the_cut_of_the_top_are_moved(spark, monkeypatch):
    """All rows used to be shuffled to meet the score at the cut; cells of any width give the same draw, repeated and missing keys included."""
    rows = [(None if i % 50 == 7 else f"r{i % 350}", g, 0.5 if i % 4 else 0.9, float(i % 350 % 3 == 0)) for i in range(400) for g in ("a", None)]
    df = stage(spark.createDataFrame(rows, "row_id string, g string, p double, y double").repartition(4))
    local = df.withColumn("h", row_hash("top-tie")).toPandas().sort_values(["p", "h", "row_id"], ascending=[False, True, True])
    want = {g: local[local["g"].isna() if g is None else local["g"] == g]["y"].head(160).mean() for g in ("a", None)}
    moved = []
    summed = metrics.running_sums
    monkeypatch.setattr(metrics, "running_sums", lambda d, *a: moved.append(d.count()) or summed(d, *a))
    for bits in (46, 52, 56):
        monkeypatch.setattr(metrics, "CELL_BITS", bits)
        moved.clear()
        got = {r["g"]: r["p5pct"] for r in metrics.precision_at_top(df, ["g"], 0.4).collect()}
        assert got == pytest.approx(want)
        assert moved[-1] <= (40 if bits == 46 else 120 if bits == 52 else 600)


def test_a_staged_table_is_evaluated_where_it_lies(spark, monkeypatch):
    df = stage(spark.createDataFrame([(f"r{i}", "m", i % 100 / 100, float(i % 3 == 0)) for i in range(400)], "row_id string, g string, p double, y double"))
    copies = []
    monkeypatch.setattr(metrics, "stage", lambda d: copies.append(d.columns) or stage(d))
    staged = metrics.evaluate(df, ["g"]).first()
    assert ["row_id", "g", "p", "y"] not in copies
    again = metrics.evaluate(df.where("true"), ["g"]).first()
    assert again[1:] == pytest.approx(staged[1:]) and ["row_id", "g", "p", "y"] in copies


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_staging_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(session._CLEANUP, None)
    staged = stage(spark.range(1000).repartition(3, "id"))
    for _ in range(100):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(session._CLEANUP, None) == setting and staged.count() == 1000


def test_large_exchanges_of_encodings_go_share_by_share(spark, monkeypatch):
    """Two leading columns with missing values and a crowd: shares give the same rates, and no exchange moves all rows."""
    rows = [(i, None if i % 11 == 0 else i % 37, f"s{i % 23}" if i % 5 else "hot", i % 4, i % 5, float(i % 13 == 0)) for i in range(400)]
    df = stage(spark.createDataFrame(rows, "row_id int, a int, b string, c int, fold int, y double").repartition(5))
    fs = FeatureSet(("a", "b"), (("a", "c"), ("b", "c")), ("c",), smoothing=2.0)
    joined = {r["row_id"]: r for r in fs.train_rows(df).collect()}
    monkeypatch.setattr(encoding, "MANY", 4)
    monkeypatch.setattr(encoding, "CROWD", 60)
    monkeypatch.setattr(encoding, "EXCHANGED", 100)
    moved = []
    share = encoding._encode_share
    monkeypatch.setattr(encoding, "_encode_share", lambda train, rows, *a: moved.append(rows.count()) or share(train, rows, *a))
    out = fs.train_rows(df).collect()
    assert len(out) == len({r["row_id"] for r in out}) == len(rows) and len(moved) >= 8 and max(moved) < 300
    assert all(abs(r[n] - joined[r["row_id"]][n]) < 1e-12 for r in out for n in fs.names)
