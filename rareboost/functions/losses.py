"""Objectives as Column expressions; they stay inside whole-stage codegen."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# Numerical floor of hessians and probabilities.
EPS = 1e-7


class Objective(Protocol):
    """Anything that turns label and raw score into gradient and hessian Columns.

    One that also has ``arrays(y, x)``, the same on numpy arrays, is trained in shorter jobs.
    """

    prior: float | None

    def grad_hess(self, y: Column, x: Column) -> tuple[Column, Column]: ...


def sigmoid(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def sigmoid_array(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1.0 / (1.0 + e), e / (1.0 + e))


def positive(y: Column) -> Column:
    return y > 0.5


def class_prior(df: DataFrame, label: str = "y") -> DataFrame:
    """One row: rows, positives and share of positives (0 for an empty table)."""
    pos = F.count_if(positive(F.col(label)))
    return df.agg(
        F.count("*").alias("n"),
        pos.alias("n_pos"),
        (pos / F.greatest(F.count("*"), F.lit(1))).alias("prior"),
    )


def init_score(prior: Column) -> Column:
    return F.when((prior > 0) & (prior < 1), F.ln(prior / (1.0 - prior))).otherwise(F.lit(0.0))


def log_loss(y: Column, p: Column, eps: float = EPS) -> Column:
    """Per-row binary log-loss of a probability clipped to [eps, 1 - eps]."""
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return -(y * F.ln(p) + (1.0 - y) * F.ln(1.0 - p))


def log_loss_array(y: np.ndarray, p: np.ndarray, eps: float = EPS) -> np.ndarray:
    p = np.clip(p, eps, 1.0 - eps)
    return -(y * np.log(p) + (1.0 - y) * np.log(1.0 - p))


def _focal(x: Column, is_pos: Column, gamma: float, w_pos: float, w_neg: float) -> tuple[Column, Column]:
    """Focal derivatives. With t the probability of the true class, u = 1 - t and
    L = -w u^gamma ln t, dL/dx is +/- w t u^gamma (gamma ln t - u / t); the hessian
    differentiates that product once more. Both classes share one formula, the
    sign of the gradient being the only difference."""
    p = F.least(F.greatest(sigmoid(x), F.lit(EPS)), F.lit(1.0 - EPS))
    t = F.when(is_pos, p).otherwise(1.0 - p)
    u = F.when(is_pos, 1.0 - p).otherwise(p)
    w = F.when(is_pos, F.lit(w_pos)).otherwise(F.lit(w_neg))
    ln_t, u_g = F.ln(t), F.pow(u, F.lit(gamma))
    slope = gamma * t * ln_t - u
    g = F.when(is_pos, F.lit(1.0)).otherwise(F.lit(-1.0)) * w * u_g * slope
    h = w * t * u * (u_g * (gamma * ln_t + gamma + 1.0) - gamma * F.pow(u, F.lit(gamma - 1.0)) * slope)
    return g, h


def _floored(g: Column, h: Column) -> tuple[Column, Column]:
    return g, F.greatest(h, F.lit(EPS))


@dataclass(frozen=True)
class CrossEntropy:
    prior: float | None = None

    def grad_hess(self, y: Column, x: Column) -> tuple[Column, Column]:
        p = sigmoid(x)
        return _floored(p - y, p * (1.0 - p))

    def arrays(self, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid_array(x)
        return p - y, np.maximum(p * (1.0 - p), EPS)


@dataclass(frozen=True)
class Focal:
    gamma: float = 2.0
    alpha: float = 0.25
    prior: float | None = None

    def grad_hess(self, y: Column, x: Column) -> tuple[Column, Column]:
        return _floored(*_focal(x, positive(y), self.gamma, self.alpha, 1.0 - self.alpha))

    def arrays(self, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pos, gamma = y > 0.5, self.gamma
        p = np.clip(sigmoid_array(x), EPS, 1.0 - EPS)
        t, u, w = np.where(pos, p, 1.0 - p), np.where(pos, 1.0 - p, p), np.where(pos, self.alpha, 1.0 - self.alpha)
        ln_t, u_g = np.log(t), np.power(u, gamma)
        slope = gamma * t * ln_t - u
        g = np.where(pos, 1.0, -1.0) * w * u_g * slope
        h = w * t * u * (u_g * (gamma * ln_t + gamma + 1.0) - gamma * np.power(u, gamma - 1.0) * slope)
        return g, np.maximum(h, EPS)


@dataclass(frozen=True)
class PositiveUnlabeled:
    """``prior`` is the assumed share of true positives and also sets the first score."""

    prior: float

    def __post_init__(self) -> None:
        if not 0.0 < self.prior < 1.0:
            raise ValueError("prior must be in (0, 1)")

    def grad_hess(self, y: Column, x: Column) -> tuple[Column, Column]:
        p = sigmoid(x)
        pq = p * (1.0 - p)
        g = F.when(positive(y), self.prior * (2.0 * p - 1.0)).otherwise(p)
        return _floored(g, F.when(positive(y), 2.0 * self.prior * pq).otherwise(pq))


@dataclass(frozen=True)
class Asymmetric:
    """Separate focusing per class; negatives under ``clip`` are dropped.

    ``neg_weight=0`` silences the negatives altogether, as the original formula
    does by passing alpha=1 to both classes; the default weighs both classes 1.
    """

    gamma_pos: float = 0.0
    gamma_neg: float = 4.0
    clip: float = 0.05
    neg_weight: float = 1.0
    prior: float | None = None

    def __post_init__(self) -> None:
        if not 0.0 <= self.clip < 1.0:
            raise ValueError("clip must be in [0, 1)")

    def grad_hess(self, y: Column, x: Column) -> tuple[Column, Column]:
        pm = F.greatest(sigmoid(x) - self.clip, F.lit(0.0))
        moved = F.ln(pm / (1.0 - pm + EPS))
        g1, h1 = _focal(x, F.lit(True), self.gamma_pos, 1.0, 1.0)
        g0, h0 = _focal(moved, F.lit(False), self.gamma_neg, self.neg_weight, self.neg_weight)
        quiet = pm < EPS
        g = F.when(positive(y), g1).when(quiet, F.lit(0.0)).otherwise(g0)
        h = F.when(positive(y), h1).when(quiet, F.lit(EPS)).otherwise(h0)
        return _floored(g, h)


def objective_by_name(name: str, gamma: float = 2.0, alpha: float = 0.25) -> Objective:
    if name == "bce":
        return CrossEntropy()
    if name == "focal":
        return Focal(gamma, alpha)
    raise ValueError(f"unknown loss '{name}': choose 'bce' or 'focal'")
