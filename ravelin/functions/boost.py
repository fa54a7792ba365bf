"""Two small classifiers on binned features, boosted stumps and a forest, and probabilities refitted as time goes on.

Stumps are fitted to the gradient of the log loss on quantile bins. Executors import this module.
"""

from __future__ import annotations

import numpy as np

ROUNDS, BINS, RATE = 60, 16, 0.2


def _bins(x: np.ndarray) -> np.ndarray:
    return np.nanquantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(x) else np.zeros((x.shape[1], BINS - 1))


def _coded(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.where(np.isnan(x[:, j]), 0, np.searchsorted(edges[j], x[:, j], "right") + 1) for j in range(x.shape[1])], axis=1)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> tuple:
    """(edges, start, stumps); a stump is (feature, cut, value up to the cut, value beyond)."""
    edges = _bins(x)
    code, share = _coded(x, edges), np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start, stumps = float(np.log(share / (1 - share))), []
    f, width = np.full(len(y), start), BINS + 2
    flat = code + np.arange(x.shape[1]) * width
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        gs = np.bincount(flat.ravel(), np.repeat(g, x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(axis=1)
        hs = np.bincount(flat.ravel(), np.repeat(h, x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(axis=1)
        gl, hl = gs[:, :-1], hs[:, :-1]
        gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
        gain = np.where((hl > 1) & (hr > 1), gl**2 / (hl + 1) + gr**2 / (hr + 1), -1.0)
        j, c = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[j, c] <= 0:
            break
        lo, hi = RATE * gl[j, c] / (hl[j, c] + 1), RATE * gr[j, c] / (hr[j, c] + 1)
        stumps.append((int(j), int(c), float(lo), float(hi)))
        f += np.where(code[:, j] <= c, lo, hi)
    return edges, start, stumps


def probability(model: tuple, x: np.ndarray) -> np.ndarray:
    edges, start, stumps = model
    code, f = _coded(x, edges), np.full(len(x), start)
    for j, c, lo, hi in stumps:
        f += np.where(code[:, j] <= c, lo, hi)
    return 1 / (1 + np.exp(-f))


TREES, DEPTH, LEAF, ROWS, COLUMNS = 200, 5, 40, 0.632, 0.8


def forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 7) -> tuple:
    """(edges, features, cuts, shares): trees in level order, each on a share of the rows and of the features.

    Node i has its children at 2i + 1 and 2i + 2; a feature of -1 marks a leaf. shares is the part of good outcomes below a node.
    """
    edges, rng = _bins(x), np.random.default_rng(seed)
    code, (n, m), width = _coded(x, edges), x.shape, BINS + 2
    nodes = 2 ** (depth + 1) - 1
    feature, cut, share = np.full((trees, nodes), -1), np.zeros((trees, nodes), int), np.full((trees, nodes), y.mean())
    for t in range(trees):
        rows = rng.choice(n, max(int(ROWS * n), 1), replace=False)
        use = np.sort(rng.choice(m, max(int(COLUMNS * m), 1), replace=False))
        c, good, at = code[rows][:, use], y[rows], np.zeros(len(rows), int)
        place = 2 * (c + np.arange(len(use)) * width) + (good > 0)[:, None]  # of a row in its node's counts of bad and good outcomes by feature and bin
        for level in range(depth + 1):
            first, wide = 2**level - 1, 2**level
            live = np.flatnonzero(at >= first)
            here = at[live] - first
            total, won = np.bincount(here, minlength=wide), np.bincount(here, good[live], wide)
            share[t, first : first + wide] = np.where(total > 0, won / np.maximum(total, 1), share[t, (np.arange(first, first + wide) - 1) // 2] if level else y.mean())
            if level == depth:
                break
            wanted = np.flatnonzero(total >= 2 * leaf)  # others can't be split
            if not len(wanted):
                at[live] = -1
                continue
            live, here = live[total[here] >= 2 * leaf], here[total[here] >= 2 * leaf]
            at_, n_ = np.searchsorted(wanted, here), len(wanted)
            both = np.bincount((at_[:, None] * (2 * len(use) * width) + place[live]).ravel(), minlength=n_ * len(use) * width * 2)
            both = both.reshape(n_, len(use), width, 2).cumsum(axis=2)
            ones, count = both[..., 1].astype(float), both[..., 0] + both[..., 1]
            left, right = count[:, :, :-1], count[:, :, -1:] - count[:, :, :-1]
            gain = np.where((left >= leaf) & (right >= leaf), ones[:, :, :-1] ** 2 / np.maximum(left, 1) + (ones[:, :, -1:] - ones[:, :, :-1]) ** 2 / np.maximum(right, 1), -1.0).reshape(n_, -1)
            f, k = np.divmod(gain.argmax(axis=1), width - 1)
            split = gain.max(axis=1) > won[wanted] ** 2 / total[wanted] + 1e-12
            feature[t, first + wanted], cut[t, first + wanted] = np.where(split, use[f], -1), k
            beyond = c[live, f[at_]] > k[at_]
            at[live] = np.where(split[at_], 2 * at[live] + 1 + beyond, -1)
    return edges, feature, cut, share


def forest_probability(model: tuple, x: np.ndarray) -> np.ndarray:
    """The mean over trees of the share of good outcomes in the leaf that a row falls into."""
    edges, feature, cut, share = model
    code, total = _coded(x, edges), np.zeros(len(x))
    for f, c, s in zip(feature, cut, share, strict=True):
        at = np.zeros(len(x), int)
        while (inner := f[at] >= 0).any():
            at = np.where(inner, 2 * at + 1 + (code[np.arange(len(x)), np.maximum(f[at], 0)] > c[at]), at)
        total += s[at]
    return total / len(feature)


def expanding(x: np.ndarray, y: np.ndarray, decided: np.ndarray, known: np.ndarray, refits: np.ndarray, least: int = 50) -> np.ndarray:
    """Probabilities by the model of the last refit at or before each decision, fitted on what was known by then; NaN before."""
    out = np.full(len(x), np.nan)
    ok = ~np.isnan(x).all(axis=1)
    for i, at in enumerate(refits):
        to = refits[i + 1] if i + 1 < len(refits) else np.inf
        learn, ask = ok & (known <= at) & ~np.isnan(y), ok & (decided >= at) & (decided < to)
        if learn.sum() >= least and ask.any() and 0 < y[learn].mean() < 1:
            out[ask] = probability(fit(x[learn], y[learn]), x[ask])
    return out
