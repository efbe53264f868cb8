"""Hashing, exact order statistics, ranks and losses."""

import math
import random
import uuid
from bisect import bisect_left, bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from rareboost.functions import losses, quantiles, selection
from rareboost.functions.hashing import HASH_SPAN, row_hash, row_uniform
from rareboost.functions.ranking import global_rank, running_sums
from rareboost.functions.selection import head_filter, order_cuts
from rareboost.operators.sampling import Adaptive, SegmentQuota


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_row_uniform_is_uniform_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    u = df.select(row_uniform("a").alias("u")).toPandas()["u"]
    again = df.repartition(7).select("row_id", row_uniform("a").alias("u")).orderBy("row_id").toPandas()["u"]
    assert (u == again).all() and 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02
    assert df.select(F.max(row_hash("b"))).collect()[0][0] < HASH_SPAN


@pytest.mark.parametrize("values", [
    [random.Random(1).gauss(0, 1) for _ in range(20000)],
    [float(random.Random(2).randrange(4)) for _ in range(20000)],
    [1e300, -1e300, 1e-300, 0.0, 5e-324, float("inf"), -1.0] * 3,
    [7.0] * 9000 + [random.Random(3).random() for _ in range(9000)],
    [3.0],
    [math.exp(random.Random(4).gauss(0, 40)) for _ in range(30000)],
    [float(k) for k in range(40000)] + [5.0] * 40000,
])
def test_order_cuts_match_sorting(spark, values):
    df = frame(spark, [(float(v),) for v in values], "v double").repartition(5)
    n = len(values)
    ranks = sorted({1, n, (n + 1) // 2, max(1, n // 3), max(1, n - 2)})
    if float("inf") in values:
        df, values = df.where("v < double('infinity')"), [v for v in values if v != float("inf")]
        ranks = [r for r in ranks if r <= len(values)]
    got = order_cuts(df, F.col("v"), lambda total: ranks)[None]
    ordered = sorted(values)
    for r in ranks:
        v = ordered[r - 1]
        assert (got[r].value, got[r].below, got[r].equal) == (v, sum(x < v for x in values), sum(x == v for x in values))


def jobs_of(spark, run):
    """What ``run`` returns, and how many jobs it started; adaptive plans would start one for every shuffle of a job."""
    sc, name = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(name, name)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("read", [64, 1 << 14])
def test_order_cuts_of_heavy_tails_take_few_passes(spark, monkeypatch, read):
    """Keys over 300 orders of magnitude, half of them equal, and pairs of longs that doubles cannot tell apart."""
    monkeypatch.setattr(selection, "READ", read)
    rng = random.Random(6)
    tails = [10.0 ** rng.uniform(-150, 150) for _ in range(20000)] + [2.0] * 20000
    longs = [(1 << 55) + rng.randrange(50000) for _ in range(40000)]
    df = frame(spark, list(zip(tails, longs)), "v double, k long").repartition(7).cache()
    df.count()
    passes = []
    counted = selection._pass
    monkeypatch.setattr(selection, "_pass", lambda *a: passes.append(1) or counted(*a))
    for name, values in (("v", tails), ("k", longs)):
        ranks = [1, 399, 20000, 39990, 40000]
        passes.clear()
        got = order_cuts(df, F.col(name), lambda n: ranks)[None]
        ordered = sorted(values)
        for r in ranks:
            v = ordered[r - 1]
            assert (got[r].value, got[r].below, got[r].equal) == (v, bisect_left(ordered, v), bisect_right(ordered, v) - bisect_left(ordered, v))
        assert len(passes) <= (2 if read > 64 else 5)
    df.unpersist()


def test_cuts_of_spread_keys_need_no_sketch_and_survive_wrong_guesses(spark):
    """Hashes are found in one pass; keys that are not spread as promised are found all the same."""
    df = spark.range(30000).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("s")).repartition(5)
    for key, span in ((row_hash("t"), HASH_SPAN), (F.pow(F.col("row_id"), F.lit(2)).cast("long"), HASH_SPAN)):
        take = {0: 4000, 1: 14999}
        sized = head_filter(df, [key], {s: (lambda n, k=k: k) for s, k in take.items()}, F.col("s"), sizes={0: 15000, 1: 15000}, span=span)
        first = {s: sorted(df.where(F.col("s") == s).select(key).toPandas().iloc[:, 0])[k - 1] for s, k in take.items()}
        kept = df.select("s", key.alias("k"), sized.alias("in")).toPandas()
        assert ((kept["k"] <= kept["s"].map(first)) == kept["in"]).all()


def test_a_sampled_round_takes_at_most_three_jobs(spark):
    rng = random.Random(7)
    rows = [(str(i), int(rng.random() < 0.1), rng.gauss(0, 1) if i % 50 else None, 0.2) for i in range(6000)]
    df = frame(spark, rows, "row_id string, y int, g double, h double").cache()
    df.count()
    sample, jobs = jobs_of(spark, lambda: Adaptive(0.2, 0.1, 0.5).sample(df, 3))
    assert jobs <= 3
    found = sample.groupBy("stratum").agg(F.count("*").alias("n"), F.min(F.abs("g")).alias("least")).toPandas().set_index("stratum")
    size = sorted((abs(r[2]) for r in rows if r[2] is not None), reverse=True)
    top = math.ceil(len(size) * 0.2)
    assert found.loc["pos_top", "n"] + found.loc["neg_top", "n"] == top
    assert found.loc[["pos_top", "neg_top"], "least"].min() == size[top - 1]
    assert found.loc["pos_rest", "n"] + found.loc["neg_rest", "n"] == math.ceil((len(rows) - top) * 0.1)
    df.unpersist()


def test_quotas_shuffle_nothing_by_row_key_and_hold_on_many_and_hot_segments(spark):
    """A segment with a third of the rows, many of a few rows, and missing ones; floors and caps by hand."""
    rng = random.Random(8)
    seg = lambda i: "hot" if i % 3 == 0 else None if i % 3 == 1 and i % 7 == 0 else f"s{i % 400}"
    rows = [(str(i), int(rng.random() < 0.1), rng.gauss(0, 1), 0.2, seg(i)) for i in range(9000)]
    df = frame(spark, rows, "row_id string, y int, g double, h double, seg string").repartition(6).cache()
    base = Adaptive(0.02, 0.05, 0.5).sample(df, 1).toPandas()
    quota = SegmentQuota("seg", 9, 0.03)
    got = Adaptive(0.02, 0.05, 0.5, quotas=(quota,)).sample(df, 1)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not any("row_id" in line.split("Join")[1] for line in plan.splitlines() if "Join" in line)
    sizes = lambda table: table["seg"].fillna("missing").value_counts().to_dict()
    have, members, mine = sizes(base), sizes(df.toPandas()), got.toPandas()
    topped = {k: max(have.get(k, 0), min(9, n)) for k, n in members.items()}
    cap = math.ceil(sum(topped.values()) * 0.03)
    assert sizes(mine) == {k: min(n, cap) for k, n in topped.items()}
    hot = mine[mine["seg"] == "hot"]["draw_seq"].max()
    assert (base[(base["seg"] == "hot") & (base["draw_seq"] <= hot)]["row_id"].isin(mine["row_id"])).all()
    df.unpersist()


def test_order_cuts_skip_missing_and_take_groups(spark):
    rows = [("a", 1.0), ("a", None), ("a", float("nan")), ("a", 5.0), ("b", 2.0)]
    got = order_cuts(frame(spark, rows, "g string, v double"), F.col("v"), {"a": lambda n: [n], "b": lambda n: [1], "c": lambda n: [1]}, F.col("g"))
    assert got["a"][2].value == 5.0 and got["b"][1].value == 2.0 and got["c"] == {}


def test_head_filter_with_a_hot_key_keeps_exactly_n(spark):
    df = spark.range(30000).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("double").alias("k")).repartition(9)
    for n in (0, 1, 7000, 19999, 20000, 25000, 30000, 40000):
        kept = df.where(head_filter(df, [F.col("k"), row_hash("t")], lambda total, n=n: n))
        assert kept.count() == min(n, 30000)


def test_head_filter_resolves_equal_hashes_by_row_id(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"), F.lit(1).alias("k"))
    kept = df.where(head_filter(df, [F.col("k")], lambda n: 4))
    assert sorted(r[0] for r in kept.collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_global_rank_and_running_sums(spark, parts):
    rng = random.Random(5)
    rows = [(i, rng.choice("abc") if rng.random() > 0.4 else "hot", rng.randrange(50)) for i in range(3000)]
    df = frame(spark, rows, "row_id long, g string, v int").repartition(parts)
    ranked = {r["row_id"]: r["rank"] for r in global_rank(df, [F.col("v"), F.col("row_id")]).collect()}
    assert [i for i, _ in sorted(ranked.items(), key=lambda x: x[1])] == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert sorted(ranked.values()) == list(range(3000))
    got = running_sums(df, [F.col("v"), F.col("row_id")], {"s": F.col("v")}, ["g"]).collect()
    want, run = {}, {}
    for i, g, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        run[g] = run.get(g, 0) + v
        want[i] = run[g]
    assert {r["row_id"]: r["s"] for r in got} == want


# --- losses ---------------------------------------------------------------------------


def evaluate(spark, objective, points):
    df = frame(spark, points, "x double, y double")
    g, h = objective.grad_hess(F.col("y"), F.col("x"))
    return [(r["x"], r["y"], r["g"], r["h"]) for r in df.select("x", "y", g.alias("g"), h.alias("h")).collect()]


def sig(x):
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def slope(loss, x, y, e=1e-4):
    return (loss(x + e, y) - loss(x - e, y)) / (2 * e)


def bce(x, y):
    return -math.log(sig(x) if y > 0.5 else 1 - sig(x))


def focal(gamma, alpha):
    def loss(x, y):
        t = sig(x) if y > 0.5 else 1 - sig(x)
        return -(alpha if y > 0.5 else 1 - alpha) * (1 - t) ** gamma * math.log(t)

    return loss


GRID = [(x, y) for x in (-2.0, -0.5, 0.0, 0.5, 2.0) for y in (0.0, 1.0)]


@pytest.mark.parametrize("objective,loss", [
    (losses.CrossEntropy(), bce), (losses.Focal(0.0, 0.25), focal(0.0, 0.25)), (losses.Focal(2.0, 0.25), focal(2.0, 0.25)),
    (losses.Focal(1.5, 0.6), focal(1.5, 0.6)),
])
def test_gradients_match_finite_differences(spark, objective, loss):
    for x, y, g, h in evaluate(spark, objective, GRID):
        assert g == pytest.approx(slope(loss, x, y), abs=2e-6)
        second = (loss(x + 1e-3, y) - 2 * loss(x, y) + loss(x - 1e-3, y)) / 1e-6
        assert h == pytest.approx(max(second, 1e-7), abs=2e-5)


def test_focal_without_focusing_is_weighted_cross_entropy(spark):
    a = evaluate(spark, losses.Focal(0.0, 0.25), GRID)
    b = evaluate(spark, losses.CrossEntropy(), GRID)
    for (x, y, g, h), (_, _, g2, h2) in zip(a, b):
        w = 0.25 if y > 0.5 else 0.75
        assert g == pytest.approx(w * g2, abs=1e-7) and h == pytest.approx(w * h2, abs=1e-7)


@pytest.mark.parametrize("objective", [
    losses.CrossEntropy(), losses.Focal(2.0, 0.25), losses.PositiveUnlabeled(0.1), losses.Asymmetric(1.0, 4.0, 0.05),
    losses.Asymmetric(1.0, 4.0, 0.05, neg_weight=0.0),
])
def test_hessians_are_positive_and_everything_is_finite(spark, objective):
    points = [(x, y) for x in (-800.0, -40.0, -4.0, -1.0, 0.0, 1.0, 4.0, 40.0, 800.0) for y in (0.0, 1.0)]
    for x, y, g, h in evaluate(spark, objective, points):
        assert h >= 1e-7 and math.isfinite(g) and math.isfinite(h)


def test_silent_asymmetric_negatives_have_no_gradient(spark):
    for x, y, g, h in evaluate(spark, losses.Asymmetric(1.0, 4.0, 0.05, neg_weight=0.0), GRID):
        if y < 0.5:
            assert g == 0.0 and h == 1e-7


def test_bad_parameters_are_rejected():
    with pytest.raises(ValueError):
        losses.PositiveUnlabeled(1.0)
    with pytest.raises(ValueError):
        losses.Asymmetric(clip=1.0)
    with pytest.raises(ValueError):
        losses.objective_by_name("hinge")


def test_init_score_without_both_classes_is_zero(spark):
    for label, want in ((0, 0.0), (1, 0.0)):
        df = frame(spark, [(label,)] * 3, "y int")
        assert losses.class_prior(df).select(losses.init_score(F.col("prior"))).collect()[0][0] == want
    assert losses.class_prior(frame(spark, [], "y int")).collect()[0]["prior"] == 0.0
    assert np.isfinite(losses.class_prior(frame(spark, [(1,), (0,)], "y int")).collect()[0]["prior"])


@pytest.mark.parametrize("limit", [1 << 16, 40])
def test_many_ranks_of_many_features(spark, monkeypatch, limit):
    """Skewed, tiny and single-valued features; a small limit cuts cells again and again."""
    monkeypatch.setattr(quantiles, "SORTED", limit)
    monkeypatch.setattr(quantiles, "ACCURACY", 100 if limit == 40 else 10_000)
    rng = np.random.default_rng(5)
    values = {0: np.exp(rng.normal(0, 8, 9000)), 3: rng.normal(0, 1e-9, 5000), 4: np.array([7.0]), 7: np.r_[np.arange(300.0), 1e300, -1e300]}
    values = {f: np.unique(v) for f, v in values.items()}
    df = spark.createDataFrame([(f, float(x)) for f, v in values.items() for x in v], "feature int, value double").repartition(6)
    ranks = lambda n: sorted({1, n, (n + 1) // 2, *[max(1, k * n // 37) for k in range(1, 37)]})
    found = quantiles.values_at_ranks(df, ranks, quantiles.around([k / 37 for k in range(1, 37)]))
    assert found == {f: (len(v), [v[r - 1] for r in ranks(len(v))]) for f, v in values.items()}
    assert quantiles.values_at_ranks(df.where("false"), ranks, [0.5]) == {}
