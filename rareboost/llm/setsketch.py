"""SetSketch: exponentially spaced truncated minima of hash values.

Register i of a set holds ``floor(1 - log_b(min h_i))`` over its elements, with
h_i exponentially distributed of rate a, truncated to 0 .. q + 1. Registers of a
union are the larger of either side's, and registers of similar sets agree, so
they serve as keys of locality-sensitive bands; from how many are larger, equal
or smaller in one of two sets the likelihood of a Jaccard similarity follows.
"""

from __future__ import annotations

import numpy as np

REGISTERS, BASE, RATE, TOP = 128, 1.001, 20.0, (1 << 16) - 2
BANDS, ROWS = 64, 6
_rng = np.random.default_rng(20210101)
_MULTIPLIERS = _rng.integers(1, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
#: Registers of each band: many overlapping choices of few, so that similar sets share some band.
BAND_REGISTERS = np.stack([np.sort(_rng.permutation(REGISTERS)[:ROWS]) for _ in range(BANDS)])
_BAND_POWERS = _rng.integers(1, 1 << 62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit hashes; all 0 for the empty set."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(hashes), 2048):
        x = (hashes[a : a + 2048] >> np.uint64(32)).astype(np.uint32)
        y = hashes[a : a + 2048].astype(np.uint32)
        v = x[:, None] * _MULTIPLIERS
        v ^= y[:, None] + _SHIFTS
        least = np.minimum(least, v.min(0))
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    h = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One key per band for each row of registers; keys of different bands differ."""
    picked = regs[:, BAND_REGISTERS].astype(np.uint64) + np.uint64(1)
    keys = (picked * _BAND_POWERS).sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (keys ^ (keys >> np.uint64(31))).view(np.int64)


def _larger(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(j: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Of Jaccard ``j`` for sets of known sizes whose registers are larger, smaller and equal so often in a."""
    u = n_a / (n_a + n_b)
    p = _larger(u - (1 - u) * j)
    q = _larger((1 - u) - u * j)
    tiny = 1e-12
    return more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny)) + equal * np.log(np.maximum(1 - p - q, tiny))


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, at: float = 0.75) -> tuple[np.ndarray, np.ndarray]:
    """Most likely Jaccard similarity of each pair of register rows, and how much likelier it is than ``at`` (log)."""
    more, less, equal = (a > b).sum(1), (a < b).sum(1), (a == b).sum(1)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    best, best_j = np.full(len(a), -np.inf), np.zeros(len(a))
    for step in np.linspace(0, 1, 51):
        ll = log_likelihood(step * most, n_a, n_b, more, less, equal)
        better = ll > best
        best, best_j = np.where(better, ll, best), np.where(better, step * most, best_j)
    return best_j, best - log_likelihood(np.minimum(at, most), n_a, n_b, more, less, equal)
