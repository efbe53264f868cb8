"""Row samplers with inverse-probability weights.

A sampler takes the full training frame of a round (``row_id, y, g, h`` and any
segment columns) and returns the drawn rows with ``ipc_w``, ``stratum`` and
``draw_seq``. A sample is a bag: a row may be drawn twice. Quotas are turned into
exact thresholds on a row hash, so drawing n rows of a pool is a filter, not a sort,
and topping up or cutting back a segment changes the rows' draws where they lie.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window, functions as F

from rareboost.functions.hashing import HASH_SPAN, row_hash, row_uniform
from rareboost.functions.joins import null_safe_join
from rareboost.functions.losses import positive
from rareboost.functions.selection import head_filter, marked_cuts, order_cuts
from rareboost.session import Scratch

# Fixed value: smallest inclusion probability (single-precision epsilon).
MIN_PROBABILITY = 1.1920928955078125e-07
# The draw order keeps the phase in the top bits and 48 hash bits below it.
PHASE_SHIFT = 48
_DRAWS = "array<struct<ipc_w: double, stratum: string, draw_seq: bigint>>"


class Sampler(Protocol):
    def sample(self, df: DataFrame, round_: int, scratch: Scratch) -> DataFrame: ...


def _seq(phase: int | Column, tag: str, seed: int, round_: int) -> Column:
    phase = F.lit(phase) if isinstance(phase, int) else phase
    return F.shiftleft(phase.cast("long"), PHASE_SHIFT) + F.shiftright(row_hash(tag, seed, round_), 8)


def unit_weights(df: DataFrame) -> DataFrame:
    """Every row once, weight 1."""
    return df.select("*", F.lit(1.0).alias("ipc_w"), F.lit("all").alias("stratum"))


def draw_without_replacement(df: DataFrame, n: int, tag: str = "draw", seed: int = 42, round_: int = 0) -> DataFrame:
    """The ``n`` rows of smallest row hash; all rows when ``n`` exceeds the pool."""
    return df.where(head_filter(df, [row_hash(tag, seed, round_)], lambda total: n))


@dataclass(frozen=True)
class Uniform:
    rate: float = 0.8
    seed: int = 42

    def __post_init__(self) -> None:
        if not 0.0 < self.rate <= 1.0:
            raise ValueError("rate must be in (0, 1]")

    def sample(self, df: DataFrame, round_: int, scratch: Scratch | None = None) -> DataFrame:
        if self.rate < 1.0:
            df = df.where(row_uniform("uniform", self.seed, round_) < self.rate)
        weight = 1.0 if self.rate >= 1.0 else 1.0 / self.rate
        return df.select(
            "*", F.lit(weight).alias("ipc_w"), F.lit("uniform").alias("stratum"), _seq(0, "uniform", self.seed, round_).alias("draw_seq")
        )


@dataclass(frozen=True)
class Goss:
    """All rows of the largest gradients, a Bernoulli share of the rest."""

    top_rate: float = 0.2
    other_rate: float = 0.1
    seed: int = 42

    def __post_init__(self) -> None:
        if not 0.0 < self.top_rate < 1.0:
            raise ValueError("top_rate must be in (0, 1)")
        if not 0.0 < self.other_rate <= 1.0:
            raise ValueError("other_rate must be in (0, 1]")

    def sample(self, df: DataFrame, round_: int, scratch: Scratch | None = None) -> DataFrame:
        keys = [-F.abs("g"), row_hash("goss-tie", self.seed, round_)]
        top = head_filter(df, keys, lambda n: math.ceil(n * self.top_rate))
        marked = df.withColumn("stratum", F.when(top, "top").otherwise("rest"))
        kept = marked.where((F.col("stratum") == "top") | (row_uniform("goss", self.seed, round_) < self.other_rate))
        phase = F.when(F.col("stratum") == "top", 0).otherwise(1)
        return kept.select(
            *df.columns,
            F.when(F.col("stratum") == "top", 1.0).otherwise(1.0 / self.other_rate).alias("ipc_w"),
            "stratum",
            _seq(phase, "goss", self.seed, round_).alias("draw_seq"),
        )


@dataclass(frozen=True)
class SegmentQuota:
    """Floor and cap on the drawn rows of every value of one segment column."""

    segment: str
    min_per_segment: int = 0
    max_fraction: float = 1.0


@dataclass(frozen=True)
class Adaptive:
    """Large gradients, class-balanced rest, optional boundary bonus and segment quotas."""

    keep: float = 0.2
    rest: float = 0.1
    target: float | None = 0.5
    bonus: float = 0.0
    seed: int = 42
    quotas: tuple[SegmentQuota, ...] = ()

    def sample(self, df: DataFrame, round_: int, scratch: Scratch | None = None) -> DataFrame:
        return drawn(self.draws(df, round_, scratch))

    def draws(self, df: DataFrame, round_: int, scratch: Scratch | None = None) -> DataFrame:
        """All rows, with ``_draws``: what each was drawn for, nothing if it was not.

        Quotas add to and take from this column, so no row is ever looked up by its key.
        What quotas count are draws, so the drawn rows are kept apart, narrow and cached;
        of all rows a floor reads the segments once and the pool once, a cap nothing.
        """
        scratch = scratch or Scratch()
        threshold, sizes = self._gradient_threshold(df)
        marked, *draw = self._strata(df, threshold, sizes, round_)
        draws = [_listed(*draw)] + ([_listed(*self._boundary(df, threshold, round_))] if self.bonus > 0.0 else [])
        rows = marked.select(*df.columns, F.concat(*draws).alias("_draws"))
        # Training carries the columns of all quotas and fails without them; a bare frame may lack some.
        quotas = [(5 + i, q) for i, q in enumerate(self.quotas) if q.segment in df.columns]
        if quotas:
            narrow = dict.fromkeys(["row_id", *[q.segment for _, q in quotas], "_draws"])
            taken = scratch.keep(rows.where(F.size("_draws") > 0).select(*narrow))
        for phase, quota in quotas:
            rows, taken = apply_floor(rows, taken, quota, self.seed, round_, phase, scratch)
            rows, taken = apply_cap(rows, taken, quota, scratch)
        return rows

    def _gradient_threshold(self, df: DataFrame) -> tuple[Column, dict[int, int]]:
        """The k-th largest absolute gradient, k = ceil(n * keep), infinite for k = 0; and the rows of every stratum."""
        ranks = lambda n: [min(math.ceil(n * self.keep), n)]
        cuts, pos, neg = marked_cuts(df, -F.abs("g"), positive(F.col("y")), ranks)
        if not cuts:
            return F.lit(float("inf")), {2: pos, 3: neg}
        cut = next(iter(cuts.values()))
        high = cut.below + cut.equal
        return F.lit(-cut.value), {0: cut.marked, 1: high - cut.marked, 2: pos - cut.marked, 3: neg - high + cut.marked}

    def _strata(self, df: DataFrame, threshold: Column, size: dict[int, int], round_: int) -> tuple[DataFrame, Column, Column]:
        """The rows with their stratum ``_s``, whether a row is drawn, and its draw."""
        # NaN counts as missing, as it has no rank.
        high = (F.abs("g") >= threshold) & ~F.isnan("g")
        pos = positive(F.col("y"))
        stratum = F.when(pos & high, 0).when(high, 1).when(pos, 2).otherwise(3)
        marked = df.withColumn("_s", stratum)
        n = sum(size.values())
        pool = {2: size.get(2, 0), 3: size.get(3, 0)}
        target = self.target if self.target is not None else (size.get(0, 0) + pool[2]) / max(n, 1)
        budget = math.ceil((pool[2] + pool[3]) * self.rest)
        take_pos = math.floor(budget * target + 0.5)
        take = {2: take_pos, 3: max(budget - take_pos, 0)}
        weight = {s: 1.0 / max(min(1.0, take[s] / pool[s]), MIN_PROBABILITY) if pool[s] else 1.0 for s in (2, 3)}
        taken = head_filter(
            marked,
            [row_hash("adaptive", self.seed, round_)],
            {s: (lambda total, s=s: take[s]) for s in (2, 3)},
            group=F.col("_s"),
            sizes=pool,
            span=HASH_SPAN,
        )
        names = F.element_at(F.array(*[F.lit(x) for x in ("pos_top", "neg_top", "pos_rest", "neg_rest")]), F.col("_s") + 1)
        weights = F.when(F.col("_s") == 2, weight[2]).when(F.col("_s") == 3, weight[3]).otherwise(1.0)
        return marked, (F.col("_s") < 2) | taken, _draw(weights, names, _seq(F.col("_s"), "adaptive", self.seed, round_))

    def _boundary(self, df: DataFrame, threshold: Column, round_: int) -> tuple[Column, Column]:
        cuts = order_cuts(df, -F.col("h"), lambda n: [math.ceil(n * 0.05) + 1])[None]
        h_min = -next(iter(cuts.values())).value if cuts else 0.0
        near = (F.col("h") >= h_min) & (F.abs("g") < threshold)
        weight = F.lit(1.0 / max(self.bonus, MIN_PROBABILITY))
        chosen = near & (row_uniform("bonus", self.seed, round_) < self.bonus)
        return chosen, _draw(weight, F.lit("bonus"), _seq(4, "bonus", self.seed, round_))


def _draw(weight: Column, stratum: Column, seq: Column) -> Column:
    return F.struct(weight.alias("ipc_w"), stratum.alias("stratum"), seq.alias("draw_seq"))


def _listed(chosen: Column, draw: Column) -> Column:
    """The draw in a list, or an empty list; without a function on elements, so that it stays in generated code."""
    return F.when(chosen, F.array(draw)).otherwise(F.array().cast(_DRAWS))


def drawn(rows: DataFrame) -> DataFrame:
    """The sample: a row for every draw."""
    # Outer, as Spark would otherwise filter by the length of the list first, and so compute every list twice.
    each = rows.withColumn("_draw", F.explode_outer("_draws")).where("_draw is not null")
    return each.select("*", "_draw.*").drop("_draws", "_draw")


def not_drawn(rows: DataFrame) -> DataFrame:
    """The rows without a draw."""
    return rows.where(F.size("_draws") == 0).drop("_draws")


def not_sampled(df: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows of ``df`` that a sample given as a table lacks; ``not_drawn`` needs no join."""
    return df.join(sample.select("row_id"), "row_id", "left_anti")


def apply_floor(
    rows: DataFrame, taken: DataFrame, quota: SegmentQuota, seed: int, round_: int, phase: int, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """Top up every segment value that has fewer than ``min_per_segment`` drawn rows, by smallest row hash.

    ``taken`` holds key, segments and draws of the drawn rows; it returns with those
    added. Only one edge per short segment is joined to the rows, by segment; the
    edges are as many rows as there are short segments, and the planner broadcasts
    them where they are small.
    """
    if quota.min_per_segment <= 0:
        return rows, taken
    seg = quota.segment
    tag = f"floor-{seg}"
    key = F.struct(row_hash(tag, seed, round_).alias("hash"), F.col("row_id"))
    have = taken.groupBy(seg).agg(F.sum(F.size("_draws")).alias("_have"), F.count_if(F.size("_draws") > 0).alias("_busy"))
    sizes = rows.groupBy(seg).agg(F.count("*").alias("_rows"))
    need = F.lit(quota.min_per_segment) - F.coalesce("_have", F.lit(0))
    short = scratch.keep(
        null_safe_join(sizes, have, [seg], "left")
        .select(seg, need.alias("_need"), (F.col("_rows") - F.coalesce("_busy", F.lit(0))).alias("_pool"))
        .where((F.col("_need") > 0) & (F.col("_pool") > 0))
    )
    names = [c for c in taken.columns if c not in ("row_id", "_draws")]
    edges, first = _edges(rows.where(F.size("_draws") == 0).select(*names, key.alias("_key")), short, seg, scratch)
    pi = F.greatest(F.least(F.lit(1.0), F.col("_need") / F.col("_pool")), F.lit(MIN_PROBABILITY))
    extra = F.array(_draw(1.0 / pi, F.lit("floor"), _seq(phase, tag, seed, round_)))
    within = F.coalesce(F.col("_edge").isNotNull() & (F.size("_draws") == 0) & (key <= F.col("_edge")), F.lit(False))
    topped = F.when(within, extra).otherwise(F.col("_draws"))
    more = first.withColumn("row_id", F.col("_key.row_id")).withColumn("_draws", extra).select(*taken.columns)
    out = null_safe_join(rows, edges, [seg], "left").select(*[topped.alias(c) if c == "_draws" else F.col(c) for c in rows.columns])
    return out, taken.unionByName(more)


def _edges(pool: DataFrame, short: DataFrame, seg: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Per short segment the key of the last row it needs (of a segment with too few rows, of its last row), and the rows up to it.

    Row hashes are evenly spread, so the wanted rows lie below a bound six standard
    deviations beyond their expected place, and few others do: what is ranked grows
    with the quota, not with the segment. Where too few lie there, the bound is raised.
    """
    last = Window.partitionBy(seg).orderBy("_key")
    # Counted before the join is planned: the planner then knows how few they are and does not shuffle the rows.
    segments = short.count()
    spare = 6.0
    while True:
        share = (F.col("_need") + spare * F.sqrt(F.col("_need") + 1)) / F.col("_pool")
        near = null_safe_join(pool, short, [seg]).where(F.col("_key.hash") < share * float(HASH_SPAN))
        # By rank, not number: rows that repeat the key of the edge lie within it, all of them.
        first = scratch.keep(near.withColumn("_r", F.rank().over(last)).where(F.col("_r") <= F.col("_need")))
        edges = scratch.keep(
            first.groupBy(seg).agg(F.max("_key").alias("_edge"), F.max("_need").alias("_need"), F.max("_pool").alias("_pool"), F.count("*").alias("_n"))
        )
        if edges.where(F.col("_n") >= F.least("_need", "_pool")).count() == segments:
            return edges.drop("_n"), first
        spare *= 16


def apply_cap(rows: DataFrame, taken: DataFrame, quota: SegmentQuota, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Keep the first ``ceil(total * max_fraction)`` draws per segment value in draw order.

    Fewer than ``1 / max_fraction`` values can exceed the cap, so their list is
    short; each gets an exact threshold on ``draw_seq``, found among the drawn rows.
    """
    if quota.max_fraction >= 1.0:
        return rows, taken
    seg = quota.segment
    have = scratch.keep(taken.groupBy(seg).agg(F.sum(F.size("_draws")).alias("n")))
    total = have.agg(F.sum("n")).collect()[0][0] or 0
    cap = math.ceil(total * quota.max_fraction)
    over = [r[seg] for r in have.where(F.col("n") > cap).collect()]
    if not over:
        return rows, taken
    sample = taken.select("row_id", seg, F.explode("_draws.draw_seq").alias("draw_seq"))
    cuts = order_cuts(sample, F.col("draw_seq"), {v: (lambda n: [cap]) for v in over}, F.col(seg))

    def kept(draw: Column) -> Column:
        seq, out = draw["draw_seq"], F
        for v, cut in cuts.items():
            here = F.col(seg).eqNullSafe(F.lit(v))
            if cap == 0:
                out = out.when(here, False)
                continue
            cut = cut[cap]
            inside = seq <= F.lit(cut.value)
            if cap < cut.below + cut.equal:
                # Equal hashes: a handful, told apart by their names.
                tied = sample.where(here & (F.col("draw_seq") == cut.value))
                names = [r[0] for r in tied.select("row_id").orderBy("row_id").limit(cap - cut.below).collect()]
                inside = (seq < F.lit(cut.value)) | ((seq == F.lit(cut.value)) & F.col("row_id").isin(names))
            out = out.when(here, inside)
        return out.otherwise(True)

    # Lists without a draw are passed by, and the others come from generated code, not from within the filter.
    left = F.when(F.size("_draws") > 0, F.filter("_draws", kept)).otherwise(F.col("_draws"))
    return rows.withColumn("_draws", left), taken.withColumn("_draws", left)


def sampler_by_name(name: str, subsample: float, seed: int = 42) -> Sampler:
    if name == "goss":
        return Goss(0.2, max(subsample, 0.1), seed)
    if name == "adaptive":
        return Adaptive(0.2, max(subsample, 0.1), 0.5, 0.1, seed)
    if name != "uniform":
        raise ValueError(f"unknown sampler {name!r}")
    return Uniform(subsample, seed)


def default_sampler(subsample: float, seed: int = 42) -> Sampler:
    """Uniform when everything is kept, otherwise the class-balanced adaptive sampler."""
    if subsample >= 1.0:
        return Uniform(1.0, seed)
    return Adaptive(0.2, max(subsample, 0.05), 0.5, 0.0, seed)
