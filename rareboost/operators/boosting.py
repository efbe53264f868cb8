"""The boosting loop: a driver loop over DataFrame passes."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from rareboost.functions.losses import (
    CrossEntropy, Focal, Objective, class_prior, log_loss, objective_by_name, positive, sigmoid,
)
from rareboost.operators import blocks, leaf_calibration as calibration
from rareboost.operators.binning import Binner, column_subset, fit_binner, fit_fold_binners
from rareboost.operators.folds import assign_folds
from rareboost.operators.histogram import GainSplitter, Splitter
from rareboost.operators.probability import collect_breakpoints, isotonic_breakpoints, platt_fit
from rareboost.operators.sampling import Adaptive, Sampler, Uniform, default_sampler, sampler_by_name
from rareboost.operators.scoring import margin_by_fold, transform
from rareboost.operators.trees import GrowthLimits, Step, Tree, grow, reached, replay
from rareboost.session import Scratch, as_staged, is_staged, spread, stage, unstage
from rareboost.sources.models import Model
from rareboost.sources.tables import checked, labelled

# Least improvement of the loss, and the seed stride of fold models.
MIN_IMPROVEMENT = 1e-6
FOLD_SEED_STRIDE = 0x9E3779B9


@dataclass(frozen=True)
class Config:
    """One training configuration; the defaults are those of ``fit``."""

    objective: Objective = field(default_factory=CrossEntropy)
    n_rounds: int = 300
    learning_rate: float = 0.05
    max_depth: int = 6
    min_child_weight: float = 1.0
    min_samples_leaf: int = 20
    lam: float = 1.0
    n_bins: int = 255
    col_subsample: float = 0.8
    sampler: Sampler = field(default_factory=lambda: default_sampler(0.8))
    splitter: Splitter = field(default_factory=GainSplitter)
    k_folds: int = 5
    fold_by: str = "random"
    fold_seed: int = 42
    time: str | None = None
    segments: tuple[str, ...] = ()
    calibrate: bool = True
    platt_scale: bool = False
    raw_isotonic: bool = False
    null_leaf: str = "zero"
    early_stopping_rounds: int | None = None
    seed: int = 42
    checkpoint_every: int = 50

    @property
    def limits(self) -> GrowthLimits:
        return GrowthLimits(self.max_depth, self.min_child_weight, self.min_samples_leaf, self.lam)

    @property
    def calibration(self) -> str:
        """Which calibration runs: isotonic over Platt over per-leaf; none when off."""
        if not self.calibrate:
            return "none"
        return "isotonic" if self.raw_isotonic else "platt" if self.platt_scale else "leaf"


def default_bce() -> Config:
    return Config(sampler=Adaptive(0.2, 0.1, 0.5, 0.0, 42), early_stopping_rounds=20)


def focal_calibrated(gamma: float, alpha: float) -> Config:
    return replace(
        default_bce(), objective=Focal(gamma, alpha), n_rounds=200, max_depth=7, min_child_weight=5.0,
        splitter=GainSplitter(purity_weight=0.1, min_positives=5),
    )


def command_line_config(
    loss: str = "bce", n_rounds: int = 100, learning_rate: float = 0.1, max_depth: int = 6, subsample: float = 0.8,
    sampler: str = "uniform", gamma: float = 2.0, alpha: float = 0.25, calibrate: bool = False, platt: bool = False,
    raw_isotonic: bool = False, early_stopping_rounds: int = 20, col_subsample: float = 0.8, lam: float = 1.0,
    min_samples_leaf: int = 20, min_child_weight: float = 1.0, seed: int = 42,
) -> Config:
    """Configuration with the command line's defaults; 0 early stopping rounds means none."""
    return Config(
        objective=objective_by_name(loss, gamma, alpha), n_rounds=n_rounds, learning_rate=learning_rate,
        max_depth=max_depth, min_child_weight=min_child_weight, min_samples_leaf=min_samples_leaf, lam=lam,
        col_subsample=col_subsample, sampler=sampler_by_name(sampler, subsample, seed), calibrate=calibrate, platt_scale=platt,
        raw_isotonic=raw_isotonic, early_stopping_rounds=early_stopping_rounds or None, fold_seed=seed, seed=seed,
    )


def first_score(prior: float) -> float:
    return math.log(prior / (1.0 - prior)) if 0.0 < prior < 1.0 else 0.0


def train(df: DataFrame, features: list[str], config: Config, label: str = "y") -> Model:
    """Train a model on ``row_id``, ``label`` and the named feature columns.

    Bin codes are staged to shared storage once. A round rebuilds the predictions
    by one narrow pass over them, in which the latest trees are replayed as arrays;
    every ``checkpoint_every`` rounds codes and predictions are staged anew, so that
    few trees are replayed. The plan of a round has the same size in every round,
    and a lost executor repeats that one pass. Only histogram cells, leaf statistics
    and single-row sums are shuffled. The input is staged first: it is read several
    times, and its plan may be expensive; a table that ``stage`` returned is read as it is.
    """
    quotas = [q.segment for q in getattr(config.sampler, "quotas", ())]
    config = replace(config, segments=tuple(dict.fromkeys([*config.segments, *quotas])))
    extra = list(dict.fromkeys([*config.segments, *([config.time] if config.time else [])]))
    table = _prepared(df, features, label, extra)
    bins = (tuple(features), config.n_bins)
    if bins not in table._facts:
        table._facts[bins] = fit_binner(table, features, config.n_bins)
    model = _boost(table, features, config, table._facts[bins])
    if config.calibration == "isotonic":
        scores = _held_out(table, features, config, config.fold_seed)
        model.isotonic = collect_breakpoints(isotonic_breakpoints(scores))
    unstage(table)
    return model


def _prepared(df: DataFrame, features: list[str], label: str, keep: list[str]) -> DataFrame:
    """The checked table, staged; one that is staged already is read where it lies.

    A staged table does not change, so what one training finds out about it, that
    it is in order and its bins, is noted on it as ``_facts`` for the next.
    """
    table = labelled(df, features, label, keep=keep)
    if not (is_staged(df) and "row_id" in df.columns):
        table = checked(stage(spread(table, "row_id")))
        table._facts = {}
        return table
    facts = df.__dict__.setdefault("_facts", {})
    if label not in facts:
        checked(table)
        facts[label] = {}
    table = as_staged(table)
    table._facts = facts[label]
    return table


def _boost(table: DataFrame, features: list[str], config: Config, binner: Binner, stats: dict | None = None) -> Model:
    """The rounds, on a checked, staged table of ``row_id``, ``y``, features and metadata; ``stats`` is its ``class_prior``, if known."""
    mode = config.calibration
    base = table
    if mode in ("leaf", "platt"):
        base = assign_folds(table, config.k_folds, config.fold_by, config.fold_seed, config.time)
    stats = class_prior(table).first().asDict() if stats is None else stats
    prior = config.objective.prior if config.objective.prior is not None else stats["prior"]
    start = first_score(prior)
    kept = [c for c in base.columns if c not in features or c in config.segments]
    state = base.select(*kept, binner.packed().alias("codes"), F.lit(start).alias("pred"), F.lit(start).alias("oof"))
    staged = stage(state if mode == "platt" else state.drop("oof"))
    leaf_prior = calibration.clamp_prior(stats["prior"])
    if blocks.fits(features, config.objective, config.sampler, config.splitter):
        trees, staged, steps = _rounds_on_blocks(staged, features, config, binner, stats, leaf_prior)
    else:
        trees, staged, steps = _rounds(staged, features, config, binner, leaf_prior)
    model = Model(trees, config.learning_rate, start, list(features))
    if mode == "platt":
        model.platt = platt_fit(replay(staged, steps).select(F.col("oof").alias("score"), "y"))
    _drop(staged)
    return model


class _Stop:
    """Early stopping: whether the loss has not improved for too many rounds."""

    def __init__(self, patience: int | None) -> None:
        self.patience, self.best, self.stale = patience, float("inf"), 0

    def after(self, loss: float) -> bool:
        self.best, self.stale = (loss, 0) if loss < self.best - MIN_IMPROVEMENT else (self.best, self.stale + 1)
        return self.stale >= self.patience


def _rounds_on_blocks(staged: DataFrame, features: list[str], config: Config, binner: Binner, stats, leaf_prior: float) -> tuple[list[Tree], DataFrame, list[Step]]:
    """The rounds as short jobs over blocks of arrays, see ``blocks``; with the staged predictions and the trees that they lack."""
    trees, steps, stop = [], [], _Stop(config.early_stopping_rounds)
    adaptive, watched = isinstance(config.sampler, Adaptive), config.early_stopping_rounds is not None
    rounds = blocks.Rounds(staged, binner, config, stats["n"], leaf_prior)
    for round_ in range(config.n_rounds):
        if len(steps) >= config.checkpoint_every:
            outdated, staged, steps = staged, stage(replay(staged, steps)), []
            rounds.load(staged)
            unstage(outdated)
        work, sample = rounds.work(round_), None
        try:
            loss, tally, shift = rounds.overview(work) if adaptive or round_ and watched else (None, None, 0)
            if round_ and watched and stop.after(loss):
                break
            sample, rows = rounds.sample(work, tally, shift, stats["n_pos"])
            tree = rounds.grow(sample, rows, column_subset(features, config.col_subsample, config.seed, round_))
            by_fold = rounds.calibrate(work, tree) if config.calibration in ("leaf", "platt") else None
        finally:
            for rdd in (work, sample):
                if rdd is not None:
                    rdd.unpersist()
        trees.append(tree)
        steps.append(Step.of(tree, config.learning_rate, by_fold))
        rounds.add(steps[-1])
    rounds.close()
    return trees, staged, steps


def _rounds(staged: DataFrame, features: list[str], config: Config, binner: Binner, leaf_prior: float) -> tuple[list[Tree], DataFrame, list[Step]]:
    """The rounds as DataFrame passes, for any sampler, loss and splitter; with the staged predictions and the trees that they lack."""
    mode = config.calibration
    staged = staged.persist(StorageLevel.MEMORY_AND_DISK)
    tasks = staged.rdd.getNumPartitions()

    trees: list[Tree] = []
    # Trees that are not yet in the staged predictions.
    steps: list[Step] = []
    stop = _Stop(config.early_stopping_rounds)
    for round_ in range(config.n_rounds):
        if len(steps) >= config.checkpoint_every:
            outdated, staged, steps = staged, stage(replay(staged, steps)).persist(StorageLevel.MEMORY_AND_DISK), []
            _drop(outdated)
        with Scratch() as scratch:
            g, h = config.objective.grad_hess(F.col("y"), F.col("pred"))
            work = scratch.keep(replay(staged, steps).select("*", g.alias("g"), h.alias("h")))
            if round_ and config.early_stopping_rounds is not None:
                loss = work.agg(F.avg(log_loss(F.col("y"), sigmoid(F.col("pred"))))).collect()[0][0]
                if stop.after(loss):
                    break
            sample = config.sampler.sample(work, round_, scratch).select("y", "codes", "g", "h", "ipc_w")
            only = column_subset(features, config.col_subsample, config.seed, round_)
            everything = isinstance(config.sampler, Uniform) and config.sampler.rate >= 1.0
            tree = grow(sample if everything else scratch.keep(sample), binner, config.limits, config.splitter, only, tasks)
            by_fold = _calibrate(work, tree, config, leaf_prior) if mode in ("leaf", "platt") else None
        trees.append(tree)
        steps.append(Step.of(tree, config.learning_rate, by_fold))
    return trees, staged, steps


def _drop(staged: DataFrame) -> None:
    staged.unpersist()
    unstage(staged)


def _calibrate(work: DataFrame, tree: Tree, config: Config, prior: float) -> list[list[float]] | None:
    """Replace the tree's leaf values by out-of-fold ones; with Platt scaling, returns the value of every (leaf, fold)."""
    routed = work.select("y", "fold", "g", "h", reached(tree).alias("leaf"))
    with Scratch() as scratch:
        values = scratch.keep(calibration.fold_values(calibration.fold_statistics(routed), config.lam, prior))
        for r in calibration.calibrated_leaves(values).collect():
            tree.leaf_values[r["leaf"]] = r["value"]
            tree.leaf_probs[r["leaf"]] = r["prob"]
        if config.null_leaf == "prior":
            tree.leaf_probs = [p if p > 0.0 else prior for p in tree.leaf_probs]
        if config.calibration != "platt":
            return None
        by_fold = [[v] * config.k_folds for v in tree.leaf_values]
        for r in values.select("leaf", "fold", "value").collect():
            by_fold[r["leaf"]][r["fold"]] = r["value"]
        return by_fold


def held_out_scores(df: DataFrame, features: list[str], config: Config, label: str = "y", seed: int | None = None) -> DataFrame:
    """Raw score of every row from a model trained without the row's fold.

    Fold models keep the hyper-parameters, drop calibration and segment quotas,
    and bin their own rows.
    """
    table = _prepared(df, features, label, [config.time] if config.time else [])
    return _held_out(table, features, config, seed if seed is not None else config.fold_seed)


def _held_out(table: DataFrame, features: list[str], config: Config, seed: int) -> DataFrame:
    """The same, on a checked, staged table. Folds are predicates on the row, so no fold is stored apart; bins, priors and scores take one pass each."""
    folded = assign_folds(table, config.k_folds, config.fold_by, seed, config.time)
    binners = fit_fold_binners(folded, features, config.n_bins, config.k_folds)
    stats = _priors_without(folded, config.k_folds)
    sampler = replace(config.sampler, quotas=()) if isinstance(config.sampler, Adaptive) else config.sampler
    models = []
    for k in range(config.k_folds):
        plain = replace(
            config, calibrate=False, segments=(), time=None, sampler=sampler, seed=config.seed + k * FOLD_SEED_STRIDE
        )
        others = folded.where(F.col("fold") != k).select("row_id", "y", *features)
        models.append(_boost(others, features, plain, binners[k], stats[k]))
    return folded.select("row_id", "y", "fold", margin_by_fold(models).alias("score"))


def _priors_without(folded: DataFrame, k: int) -> list[dict]:
    """``class_prior`` of the rows outside of every fold, from one pass."""
    own = {r["fold"]: r for r in folded.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(positive(F.col("y"))).alias("n_pos")).collect()}
    out = []
    for fold in range(k):
        n, n_pos = (sum(r[c] for f, r in own.items() if f != fold) for c in ("n", "n_pos"))
        out.append({"n": n, "n_pos": n_pos, "prior": n_pos / max(n, 1)})
    return out


@dataclass
class Booster:
    """Trained model with the scoring calls of the Python interface."""

    model: Model

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return transform(df, self.model, "auto")

    def predict_raw(self, df: DataFrame) -> DataFrame:
        return transform(df, self.model, "margin", "raw")

    @property
    def n_trees(self) -> int:
        return self.model.n_trees


def fit(
    df: DataFrame, features: list[str], label: str = "y", loss: str = "bce", n_rounds: int = 300, learning_rate: float = 0.05,
    max_depth: int = 6, subsample: float = 0.8, col_subsample: float = 0.8, gamma: float = 2.0, alpha: float = 0.25,
    calibrate: bool = True, raw_isotonic: bool = False, fold_by: str = "random", time: str | None = None, seed: int = 42,
) -> Booster:
    """Train with the Python interface's defaults."""
    config = Config(
        objective=objective_by_name(loss, gamma, alpha), n_rounds=n_rounds, learning_rate=learning_rate, max_depth=max_depth,
        col_subsample=col_subsample, sampler=default_sampler(subsample, seed), calibrate=calibrate, raw_isotonic=raw_isotonic,
        fold_by=fold_by, time=time, fold_seed=seed, seed=seed,
    )
    return Booster(train(df, features, config, label))
