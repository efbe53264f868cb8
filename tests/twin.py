"""Single-machine boosting in numpy, written independently of the engine, for comparison in tests."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))


def thresholds(v, n_bins):
    u = np.unique(v[np.isfinite(v)])
    n = len(u)
    if n == 0:
        return np.array([np.inf])
    a = min(n_bins, n)
    t = np.array([u[-(-((b + 1) * n) // a) - 1] for b in range(a)])
    t[-1] = np.inf
    return t


def bin_column(v, t):
    b = np.array([np.argmax(t >= x) if not np.isnan(x) else 0 for x in v])
    return b


def grow(B, nb, g, h, w, y, depth, mcw, min_leaf, lam, purity=0.0):
    """Returns (leaf of every row, leaf values, leaf counts), leaves numbered left to right."""
    leaf_of, values, counts = np.full(len(g), -1), [], []

    def close(idx, all_idx, G, H):
        leaf_of[all_idx] = len(values)
        values.append(-G / (H + lam))
        counts.append(int(w[idx].astype(bool).sum()))

    def node(all_idx, d, G, H):
        idx = all_idx[w[all_idx] > 0]
        if d >= depth or len(idx) < max(min_leaf, 2) or H < mcw:
            return close(idx, all_idx, G, H)
        best = None
        for f in range(B.shape[1]):
            hist = [np.bincount(B[idx, f], weights=x, minlength=nb[f]) for x in (g[idx] * w[idx], h[idx] * w[idx], np.ones(len(idx)), (y[idx] > 0.5) * 1.0)]
            L = [np.cumsum(x)[:-1] for x in hist]
            T = [x.sum() for x in hist]
            R = [t - l for t, l in zip(T, L)]
            for b in range(nb[f] - 1):
                if L[1][b] < mcw or R[1][b] < mcw or L[2][b] == 0 or R[2][b] == 0:
                    continue
                gain = L[0][b] ** 2 / (L[1][b] + lam) + R[0][b] ** 2 / (R[1][b] + lam) - T[0] ** 2 / (T[1] + lam)
                gain += purity * abs(L[3][b] / L[2][b] - R[3][b] / R[2][b])
                if gain > 0 and (best is None or round(gain, 9) > best[0]):
                    best = (round(gain, 9), f, b, L[0][b], L[1][b], R[0][b], R[1][b], L[2][b], R[2][b])
        if best is None or min(best[7], best[8]) < min_leaf:
            return close(idx, all_idx, G, H)
        left = B[all_idx, best[1]] <= best[2]
        node(all_idx[left], d + 1, best[3], best[4])
        node(all_idx[~left], d + 1, best[5], best[6])

    everything = np.arange(len(g))
    node(everything, 0, (g * w).sum(), (h * w).sum())
    return leaf_of, np.array(values), counts


def pav(points):
    """Pool adjacent violators over (value, rate, weight) sorted by value."""
    blocks = []
    for _, y, w in points:
        blocks.append([y, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            y1, w1, n1 = blocks.pop()
            y0, w0, n0 = blocks.pop()
            blocks.append([(y0 * w0 + y1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return [min(max(y, 0), 1) for y, _, n in blocks for _ in range(n)]


def calibrate(leaf_of, values, g, h, y, fold, k, lam):
    prior = min(max((y > 0.5).mean(), 1e-4), 1 - 1e-4)
    probs, per_row, out = np.zeros(len(values)), np.zeros(len(y)), values.copy()
    for l in range(len(values)):
        pairs, vals = [], {}
        for f in range(k):
            own, rest = (leaf_of == l) & (fold == f), (leaf_of == l) & (fold != f)
            if own.any() and rest.any():
                vals[f] = -g[rest].sum() / (h[rest].sum() + lam)
                pairs.append((vals[f], ((y[own] > 0.5).sum() + 10 * prior) / (own.sum() + 10), own.sum()))
            per_row[own] = vals.get(f, 0.0)
        if not pairs:
            continue
        out[l] = sum(v * n for v, _, n in pairs) / sum(n for _, _, n in pairs)
        pairs.sort(key=lambda p: p[0])
        probs[l] = pav(pairs)[int(np.argmin([abs(p[0] - out[l]) for p in pairs]))]
    return out, probs, per_row


def train(X, y, rounds, lr, depth, n_bins, weights=None, fold=None, k=5, mcw=1.0, min_leaf=20, lam=1.0, purity=0.0):
    """Returns margins, mean leaf probabilities, out-of-fold margins, and the trees' (values, counts)."""
    t = [thresholds(X[:, f], n_bins) for f in range(X.shape[1])]
    B = np.column_stack([bin_column(X[:, f], t[f]) for f in range(X.shape[1])])
    nb = [len(x) for x in t]
    p0 = (y > 0.5).mean()
    pred = np.full(len(y), np.log(p0 / (1 - p0)))
    oof, prob, trees = pred.copy(), np.zeros(len(y)), []
    for r in range(rounds):
        p = sigmoid(pred)
        g, h = p - y, np.maximum(p * (1 - p), 1e-7)
        w = np.ones(len(y)) if weights is None else weights(r)
        leaf_of, values, counts = grow(B, nb, g, h, w, y, depth, mcw, min_leaf, lam, purity)
        probs = np.zeros(len(values))
        if fold is not None:
            values, probs, per_row = calibrate(leaf_of, values, g, h, y, fold, k, lam)
            oof += lr * per_row
        pred = pred + lr * values[leaf_of]
        prob += probs[leaf_of]
        trees.append((values, counts))
    return pred, prob / rounds, oof, trees
