"""Small learners in numpy, fitted on the driver from bounded samples.

All are deterministic: seeds are fixed and nothing depends on the order in which
rows arrive (callers sort their samples).
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def standardizer(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = x.std(axis=0)
    return x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0)


# -- two-layer network ---------------------------------------------------------


#: Parts of the rows that a network's temperature is fitted on, each by a network of the others.
TEMPERATURE_FOLDS = 3


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, decay: float = 1e-4, seed: int = 7) -> dict:
    """A tanh layer and a logistic output, by Adam, on all rows; the temperature comes from out-of-fold logits, at every size."""
    fold = np.random.default_rng(seed).permutation(len(x)) % TEMPERATURE_FOLDS
    logits = np.zeros(len(x))
    for k in set(fold.tolist()):
        part = _fit_layers(x[fold != k], y[fold != k], hidden, epochs, decay, seed)
        logits[fold == k] = _logits(part, (x[fold == k] - part["centre"]) / part["scale"])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
    loss = [np.logaddexp(0, np.where(y > 0, -1, 1) * logits / g).mean() for g in grid]
    return _fit_layers(x, y, hidden, epochs, decay, seed) | {"temperature": float(grid[int(np.argmin(loss))])}


def _fit_layers(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, decay: float, seed: int) -> dict:
    rng = np.random.default_rng(seed)
    centre, scale = standardizer(x)
    x = (x - centre) / scale
    order = np.arange(len(x))
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    p[3][0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    first, second, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        rng.shuffle(order)
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for low in range(0, len(order), 128):
            xb, yb = x[order[low : low + 128]], y[order[low : low + 128]]
            a = np.tanh(xb @ p[0] + p[1])
            e = (sigmoid(a @ p[2] + p[3]) - yb) / len(yb)
            da = np.outer(e, p[2]) * (1 - a * a)
            grads = [xb.T @ da + decay * p[0], da.sum(axis=0), a.T @ e + decay * p[2], np.array([e.sum()])]
            t += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p[i] -= rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return {"centre": centre, "scale": scale, "p": p}


def _logits(model: dict, x: np.ndarray) -> np.ndarray:
    p = model["p"]
    return np.tanh(x @ p[0] + p[1]) @ p[2] + p[3][0]


def network_scores(model: dict, x: np.ndarray) -> np.ndarray:
    return sigmoid(_logits(model, (x - model["centre"]) / model["scale"]) / model["temperature"])


# -- linear support vector machine -----------------------------------------------


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, steps: int = 150) -> tuple[np.ndarray, float, float]:
    """(weights, bias, slope): squared hinge loss with equal weight for both classes, by accelerated gradients.

    slope turns margins into probabilities: sigmoid(slope * margin).
    """
    s = np.where(y > 0, 1.0, -1.0).astype(np.float32)
    balance = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1)).astype(np.float32) * cost * len(y)
    step = 1.0 / (1.0 + 2 * float((balance * ((x * x).sum(axis=1) + 1)).sum()) / 4)
    w = v = np.zeros(x.shape[1] + 1, np.float32)  # the last is the bias
    for t in range(steps):
        pull = balance * s * np.maximum(0, 1 - s * (x @ v[:-1] + v[-1]))
        new = v - step * (v - 2 * np.append(pull @ x, pull.sum()))
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    margins = s * (x @ w[:-1] + w[-1])
    grid = np.exp(np.linspace(np.log(0.5), np.log(20), 80))
    slope = grid[int(np.argmin([(np.logaddexp(0, -g * margins) * balance).mean() + 1e-3 * g for g in grid]))]
    return w[:-1], float(w[-1]), float(slope)


# -- gradient-boosted trees --------------------------------------------------------


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 1.0) -> dict:
    """Logistic boosting over quantile bins; each tree is a full binary tree of (feature, cut) and leaf values."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    # a rare feature's values all lie above the last quantile: give them cuts of their own
    cuts = [np.unique(np.concatenate([c, np.quantile(v[v > c[-1]], np.linspace(0, 1, 9)[:-1]) if (v > c[-1]).any() else []])) for c, v in zip(cuts, x.T)]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
    width = max(len(c) for c in cuts) + 1
    prior = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    f = np.full(len(y), prior)
    trees = []
    for _ in range(rounds):
        p = sigmoid(f)
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        splits: list[tuple[int, float]] = []
        for level in range(depth):
            count = 1 << level
            g = np.stack([np.bincount(node * width + b, grad, count * width).reshape(count, width) for b in binned.T])
            h = np.stack([np.bincount(node * width + b, hess, count * width).reshape(count, width) for b in binned.T])
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + least) + (gt - gl) ** 2 / (ht - hl + least) - gt**2 / (ht + least)
            gain[(hl < 0.05) | (ht - hl < 0.05)] = -1
            right = np.zeros(len(y), dtype=np.int64)
            for k in range(count):
                feature, cut = np.unravel_index(np.argmax(gain[:, k]), gain[:, k].shape)
                useful = gain[feature, k, cut] > 1e-6 and cut < len(cuts[feature])
                splits.append((int(feature), float(cuts[feature][cut])) if useful else (0, np.inf))
                at = node == k
                right[at] = (binned[at, feature] > cut) if useful else 0
            node = node * 2 + right
        leaves = rate * np.bincount(node, grad, 1 << depth) / (np.bincount(node, hess, 1 << depth) + least)
        f += leaves[node]
        trees.append((splits, leaves))
    return {"prior": prior, "depth": depth, "trees": trees}


def tree_logits(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model["prior"])
    for splits, leaves in model["trees"]:
        node = np.zeros(len(x), dtype=np.int64)
        base = 0
        for level in range(model["depth"]):
            feature = np.array([s[0] for s in splits[base : base + (1 << level)]])
            cut = np.array([s[1] for s in splits[base : base + (1 << level)]])
            base += 1 << level
            node = node * 2 + (x[np.arange(len(x)), feature[node]] > cut[node])
        f += leaves[node]
    return f


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a non-decreasing map from scores to probabilities (pool adjacent violators)."""
    order = np.lexsort((y, score))
    blocks: list[list[float]] = []  # mean, weight, low, high
    for s, v in zip(score[order], y[order]):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, high = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[3] = (a[0] * a[1] + m * w) / (a[1] + w), a[1] + w, high
    # one pseudo-row of the base rate keeps end blocks off 0 and 1
    base = float(y.mean()) if len(y) else 0.5
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([(b[0] * b[1] + base) / (b[1] + 1) for b in blocks for _ in (0, 1)])
    return xs, np.maximum.accumulate(ys) if len(ys) else ys


def isotonic_scores(knots: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    xs, ys = knots
    return np.interp(score, xs, ys) if len(xs) else np.full(len(score), 0.5)
