"""Objectives and samplers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareboost.functions import losses
from rareboost.operators import sampling
from rareboost.plans.fixtures import GRADIENTS_SQL, gradients, hash_sql, sigmoid_sql, uniform_sql
from rareboost.plans.registry import query
from rareboost.session import Scratch, stage

# --- objectives: one row per line, gradients at the fixed first score -----------------


def _grad_sql(g: str, h: str, cte: str = "") -> str:
    return f"""WITH {GRADIENTS_SQL}, e AS (SELECT row_id, y, pr, least(greatest(pr, 1e-7), 1 - 1e-7) AS p FROM gradients){cte}
SELECT row_id, round({g}, 6) AS g, round(greatest({h}, 1e-7), 6) AS h FROM e"""


def _gradients(spark: SparkSession, sf_dir: str, objective) -> DataFrame:
    g, h = objective.grad_hess(F.col("y"), F.col("pred"))
    return gradients(spark, sf_dir).select("row_id", F.round(g, 6).alias("g"), F.round(h, 6).alias("h"))


def focal_sql(p: str, gamma: float, w1: float, w0: float) -> tuple[str, str]:
    """Gradient and hessian as sums of monomials t^a u^b (ln t)^c, t the true class's probability and u = 1 - t.

    Along x the loss -w u^gamma ln t has the slope w (gamma t u^gamma ln t - u^(gamma+1)), negated for the other class;
    t' = t u and u' = -t u give the second derivative term by term.
    """

    def terms(t: str, u: str, w: float) -> tuple[str, str]:
        low, high = f"pow({u}, {gamma}e0)", f"pow({u}, {gamma + 1}e0)"
        slope = f"{w}e0 * ({gamma}e0 * {t} * {low} * ln({t}) - {high})"
        curve = f"{w}e0 * ({gamma}e0 * {t} * {high} * ln({t}) - {gamma * gamma}e0 * {t} * {t} * {low} * ln({t}) + {2 * gamma + 1}e0 * {t} * {high})"
        return slope, curve

    g1, h1 = terms(p, f"(1 - {p})", w1)
    g0, h0 = terms(f"(1 - {p})", p, w0)
    return f"CASE WHEN y > 0.5 THEN {g1} ELSE -({g0}) END", f"CASE WHEN y > 0.5 THEN {h1} ELSE {h0} END"


@query("o1_sigmoid", f"WITH {GRADIENTS_SQL} SELECT row_id, round({sigmoid_sql('(40 * pred)')}, 9) AS p FROM gradients")
def o1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gradients(spark, sf_dir).select("row_id", F.round(losses.sigmoid(40 * F.col("pred")), 9).alias("p"))


@query("o2_cross_entropy", _grad_sql("pr - y", "pr * (1 - pr)"))
def o2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gradients(spark, sf_dir, losses.CrossEntropy())


@query("o3_focal", _grad_sql(*focal_sql("p", 2.0, 0.25, 0.75)))
def o3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gradients(spark, sf_dir, losses.Focal(2.0, 0.25))


@query("o4_positive_unlabeled", _grad_sql(
    "CASE WHEN y > 0.5 THEN 0.1e0 * (2 * pr - 1) ELSE pr END", "CASE WHEN y > 0.5 THEN 0.2e0 * pr * (1 - pr) ELSE pr * (1 - pr) END"))
def o4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gradients(spark, sf_dir, losses.PositiveUnlabeled(0.1))


def _asymmetric_sql(neg_weight: float) -> str:
    pos_g, pos_h = focal_sql("p", 1.0, 1.0, 1.0)
    neg_g, neg_h = focal_sql("ps", 3.0, 1.0, neg_weight)
    moved = f""", s AS (SELECT *, greatest(pr - 0.05e0, 0) AS pm FROM e),
t AS (SELECT *, CASE WHEN pm < 1e-7 THEN 0 ELSE ln(pm / (1 - pm + 1e-7)) END AS xs FROM s),
v AS (SELECT *, least(greatest({sigmoid_sql('xs')}, 1e-7), 1 - 1e-7) AS ps FROM t)"""
    g = f"CASE WHEN y > 0.5 THEN {pos_g} WHEN pm < 1e-7 THEN 0 ELSE {neg_g} END"
    h = f"CASE WHEN y > 0.5 THEN {pos_h} WHEN pm < 1e-7 THEN 1e-7 ELSE {neg_h} END"
    return _grad_sql(g, h, moved).replace("AS h FROM e", "AS h FROM v")


@query("o5_asymmetric", _asymmetric_sql(1.0))
def o5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gradients(spark, sf_dir, losses.Asymmetric(1.0, 3.0, 0.05))


@query("o5_asymmetric_silent", _asymmetric_sql(0.0))
def o5_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gradients(spark, sf_dir, losses.Asymmetric(1.0, 3.0, 0.05, neg_weight=0.0))


@query("o6_mean_log_loss", f"""WITH {GRADIENTS_SQL}
SELECT seg_brand, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss
FROM (SELECT *, least(greatest(pr, 1e-7), 1 - 1e-7) AS p FROM gradients) GROUP BY seg_brand""")
def o6(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = losses.log_loss(F.col("y"), losses.sigmoid(F.col("pred")))
    return gradients(spark, sf_dir).groupBy("seg_brand").agg(F.round(F.avg(loss), 6).alias("log_loss"))


# --- samplers on the fixed gradients --------------------------------------------------

_OUT = "SELECT row_id, stratum, round(ipc_w, 6) AS ipc_w, draw_seq FROM"


def _drawn(df: DataFrame) -> DataFrame:
    return df.select("row_id", "stratum", F.round("ipc_w", 6).alias("ipc_w"), "draw_seq")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(gradients(spark, sf_dir).select("row_id", "y", "g", "h", "seg_brand", "seg_priority"))


def _seq_sql(phase: str | int, tag: str) -> str:
    return f"(CAST({phase} AS BIGINT) << 48) + ({hash_sql(tag)} >> 8)"


UNIFORM_SQL = f"""SELECT row_id, 'uniform' AS stratum, 1.25e0 AS ipc_w, {_seq_sql(0, 'uniform')} AS draw_seq
FROM gradients WHERE {uniform_sql('uniform')} < 0.8e0"""


@query("a1_uniform", f"WITH {GRADIENTS_SQL} {_OUT} ({UNIFORM_SQL})")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(sampling.Uniform(0.8).sample(_rows(spark, sf_dir), 0))


def goss_sql(top: float, other: float) -> str:
    return f"""SELECT row_id, CASE WHEN rn <= k THEN 'top' ELSE 'rest' END AS stratum,
  CASE WHEN rn <= k THEN 1e0 ELSE 1e0 / {other}e0 END AS ipc_w, {_seq_sql('CASE WHEN rn <= k THEN 0 ELSE 1 END', 'goss')} AS draw_seq
FROM (SELECT *, row_number() OVER (ORDER BY abs(g) DESC, {hash_sql('goss-tie')}, row_id) AS rn, ceil(count(*) OVER () * {top}e0) AS k
  FROM gradients) WHERE rn <= k OR {uniform_sql('goss')} < {other}e0"""


@query("a2_goss", f"WITH {GRADIENTS_SQL} {_OUT} ({goss_sql(0.2, 0.1)})")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(sampling.Goss(0.2, 0.1).sample(_rows(spark, sf_dir), 0))


def adaptive_sql(rest: float, bonus: float = 0.0, keep: float = 0.2, target: float = 0.5) -> str:
    """CTEs ending in ``drawn``: strata, balanced rest, boundary bonus."""
    extra = f""" UNION ALL
  SELECT row_id, seg_brand, seg_priority, 'bonus', 1e0 / {bonus}e0, {_seq_sql(4, 'bonus')} FROM strata
  WHERE h >= coalesce((SELECT h FROM (SELECT h, row_number() OVER (ORDER BY h DESC) AS rn FROM gradients)
    WHERE rn = (SELECT ceil(count(*) * 0.05e0) + 1 FROM gradients)), 0) AND abs(g) < thr AND {uniform_sql('bonus')} < {bonus}e0""" if bonus else ""
    return f"""thr AS MATERIALIZED (SELECT min(ag) AS thr FROM (SELECT abs(g) AS ag, row_number() OVER (ORDER BY abs(g) DESC) AS rn,
  ceil(count(*) OVER () * {keep}e0) AS k FROM gradients) WHERE rn <= k),
strata AS MATERIALIZED (SELECT *, CASE WHEN y > 0.5 AND abs(g) >= thr THEN 0 WHEN abs(g) >= thr THEN 1 WHEN y > 0.5 THEN 2 ELSE 3 END AS s
  FROM gradients CROSS JOIN thr),
quota AS MATERIALIZED (SELECT *, greatest(budget - take2, 0) AS take3 FROM (SELECT *, floor(budget * {target}e0 + 0.5e0) AS take2 FROM (
  SELECT ceil((n2 + n3) * {rest}e0) AS budget, n2, n3 FROM (SELECT count(*) FILTER (s = 2) AS n2, count(*) FILTER (s = 3) AS n3 FROM strata)))),
drawn AS MATERIALIZED (
  SELECT row_id, seg_brand, seg_priority, CASE s WHEN 0 THEN 'pos_top' WHEN 1 THEN 'neg_top' WHEN 2 THEN 'pos_rest' ELSE 'neg_rest' END AS stratum,
    CASE s WHEN 2 THEN 1e0 / greatest(least(1e0, take2 / n2), 1.1920928955078125e-07) WHEN 3
      THEN 1e0 / greatest(least(1e0, take3 / n3), 1.1920928955078125e-07) ELSE 1e0 END AS ipc_w,
    {_seq_sql('s', 'adaptive')} AS draw_seq
  FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY {hash_sql('adaptive')}, row_id) AS rn FROM strata CROSS JOIN quota)
  WHERE s < 2 OR (s = 2 AND rn <= take2) OR (s = 3 AND rn <= take3){extra})"""


@query("a3_adaptive", f"WITH {GRADIENTS_SQL}, {adaptive_sql(0.1)} {_OUT} drawn")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(sampling.Adaptive(0.2, 0.1, 0.5).sample(_rows(spark, sf_dir), 0))


@query("a4_boundary_bonus", f"WITH {GRADIENTS_SQL}, {adaptive_sql(0.1, 0.3, keep=0.02)} {_OUT} drawn")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(sampling.Adaptive(0.02, 0.1, 0.5, 0.3).sample(_rows(spark, sf_dir), 0))


def floor_sql(src: str, out: str, seg: str, minimum: int, phase: int) -> str:
    return f"""{out} AS MATERIALIZED (SELECT * FROM {src} UNION ALL
  SELECT row_id, seg_brand, seg_priority, 'floor', 1e0 / greatest(least(1e0, need / CAST(n AS DOUBLE)), 1.1920928955078125e-07),
    {_seq_sql(phase, f'floor-{seg}')} FROM (
    SELECT g.*, need, count(*) OVER (PARTITION BY {seg}) AS n,
      row_number() OVER (PARTITION BY {seg} ORDER BY {hash_sql(f'floor-{seg}')}, row_id) AS rn
    FROM gradients g JOIN (SELECT {seg}, {minimum} - coalesce(have, 0) AS need FROM (SELECT DISTINCT {seg} FROM gradients)
      LEFT JOIN (SELECT {seg}, count(*) AS have FROM {src} GROUP BY {seg}) USING ({seg})) q USING ({seg})
    WHERE need > 0 AND row_id NOT IN (SELECT row_id FROM {src})) WHERE rn <= need)"""


def cap_sql(src: str, out: str, seg: str, fraction: float) -> str:
    return f"""{out} AS MATERIALIZED (SELECT * EXCLUDE (rn, total) FROM (
  SELECT *, row_number() OVER (PARTITION BY {seg} ORDER BY draw_seq, row_id) AS rn, count(*) OVER () AS total FROM {src})
  WHERE rn <= ceil(total * {fraction}e0))"""


# The floor lies above the usual draw of a brand, the cap below it (in shares of all rows).
def _quota(rows: DataFrame) -> int:
    return rows.count() // 200


_FLOOR = "(SELECT count(*) // 200 FROM gradients)"


@query("a5_segment_floor", f"WITH {GRADIENTS_SQL}, {adaptive_sql(0.02)}, {floor_sql('drawn', 'topped', 'seg_brand', _FLOOR, 5)} {_OUT} topped")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    quota = sampling.SegmentQuota("seg_brand", min_per_segment=_quota(rows))
    return _drawn(sampling.Adaptive(0.2, 0.02, 0.5, quotas=(quota,)).sample(rows, 0))


# One brand goes missing; the SQL leaves it its name, as a missing segment is one like any other.
@query("a5_segment_floor_null", f"WITH {GRADIENTS_SQL}, {adaptive_sql(0.02)}, {floor_sql('drawn', 'topped', 'seg_brand', _FLOOR, 5)} {_OUT} topped")
def a5_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("seg_brand", F.nullif("seg_brand", F.lit("Brand#11")))
    quota = sampling.SegmentQuota("seg_brand", min_per_segment=_quota(rows))
    return _drawn(sampling.Adaptive(0.2, 0.02, 0.5, quotas=(quota,)).sample(rows, 0))


@query("a6_segment_quotas", f"""WITH {GRADIENTS_SQL}, {adaptive_sql(0.02, 0.3, keep=0.02)}, {floor_sql('drawn', 'q1', 'seg_brand', _FLOOR, 5)},
{cap_sql('q1', 'q2', 'seg_brand', 0.04)}, {cap_sql('q2', 'q3', 'seg_priority', 0.2)} {_OUT} q3""")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    quotas = (
        sampling.SegmentQuota("seg_brand", _quota(rows), 0.04), sampling.SegmentQuota("seg_priority", 0, 0.2),
        sampling.SegmentQuota("absent", 10, 0.1),
    )
    return _drawn(sampling.Adaptive(0.02, 0.02, 0.5, 0.3, quotas=quotas).sample(rows, 0))


@query("a7_without_replacement", f"""WITH {GRADIENTS_SQL} SELECT row_id FROM gradients
QUALIFY row_number() OVER (ORDER BY {hash_sql('draw')}, row_id) <= 1234""")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.draw_without_replacement(_rows(spark, sf_dir), 1234).select("row_id")


@query("a8_unit_weights", f"WITH {GRADIENTS_SQL} SELECT row_id, 1e0 AS ipc_w, 'all' AS stratum FROM gradients")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.unit_weights(_rows(spark, sf_dir)).select("row_id", "ipc_w", "stratum")


# j7: candidates of the segment floor, rows of short segments that the sample lacks.
@query("j7_not_sampled", f"""WITH {GRADIENTS_SQL}, {adaptive_sql(0.1)}
SELECT row_id, seg_brand FROM gradients WHERE row_id NOT IN (SELECT row_id FROM drawn)""")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return sampling.not_drawn(sampling.Adaptive(0.2, 0.1, 0.5).draws(rows, 0)).select("row_id", "seg_brand")


_PICKED = f"""SELECT 'uniform' AS name, row_id, stratum, ipc_w FROM ({UNIFORM_SQL.replace('1.25e0', '1e0 / 0.8e0')})
UNION ALL SELECT 'goss', row_id, stratum, ipc_w FROM ({goss_sql(0.2, 0.8)})
UNION ALL SELECT 'adaptive', row_id, stratum, ipc_w FROM drawn"""


@query("b5_sampler_by_name", f"""WITH {GRADIENTS_SQL}, {adaptive_sql(0.8, 0.1)}
SELECT name, stratum, CAST(count(*) AS BIGINT) AS n, round(sum(ipc_w), 4) AS weight FROM ({_PICKED}) GROUP BY name, stratum""")
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    parts = [
        sampling.sampler_by_name(name, 0.8).sample(rows, 0, Scratch()).select(F.lit(name).alias("name"), "stratum", "ipc_w")
        for name in ("uniform", "goss", "adaptive")
    ]
    both = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return both.groupBy("name", "stratum").agg(F.count("*").alias("n"), F.round(F.sum("ipc_w"), 4).alias("weight"))
