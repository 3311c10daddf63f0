"""The quality classifier's learner against plain loops."""

import math

import numpy as np

from quillgraph.llm import quality


def plain_tree(g, h, ridge):
    """The cut of greatest gain, then that of each half: every bin's leaf value."""
    worth = lambda lo, hi: sum(g[lo:hi]) ** 2 / (sum(h[lo:hi]) + ridge)

    def cut(lo, hi):
        gains = [worth(lo, k) + worth(k, hi) - worth(lo, hi) for k in range(lo + 1, hi)]
        return lo + 1 + max(range(len(gains)), key=gains.__getitem__) if gains else lo

    out = [0.0] * len(g)
    at = cut(0, len(g))
    for lo, hi in ((0, at), (at, len(g))):
        mid = cut(lo, hi)
        for a, b in ((lo, mid), (mid, hi)):
            for i in range(a, b):
                out[i] = sum(g[a:b]) / (sum(h[a:b]) + ridge)
    return out


def plain_quadrants(g, h, ridge):
    best = (-1.0, None)
    for i in range(1, quality.GRID):
        for j in range(1, quality.GRID):
            boxes = [(slice(a, b), slice(c, d)) for a, b in ((0, i), (i, quality.GRID)) for c, d in ((0, j), (j, quality.GRID))]
            gain = sum(g[x].sum() ** 2 / (h[x].sum() + ridge) for x in boxes)
            if gain > best[0] + 1e-12:
                values = np.zeros_like(g)
                for x in boxes:
                    values[x] = g[x].sum() / (h[x].sum() + ridge)
                best = (gain, values)
    return best


def test_trees_and_quadrants():
    rng = np.random.default_rng(0)
    for bins in (1, 2, 3, 8, 31):
        g, h = rng.standard_normal(bins), rng.random(bins) + 0.1
        assert np.allclose(quality.shallow_tree(g, h, 2.0), plain_tree(g.tolist(), h.tolist(), 2.0))
    for _ in range(20):
        g, h = rng.standard_normal((8, 8)), rng.random((8, 8)) + 0.1
        gain, values = quality.quadrants(g, h, 2.0)
        want = plain_quadrants(g, h, 2.0)
        assert math.isclose(gain, want[0]) and np.allclose(values, want[1])


def test_training_against_plain_loops():
    """Tables by cyclic boosting, row by row, give the same scores."""
    rng = np.random.default_rng(1)
    x = np.round(rng.random((120, len(quality.NAMES))), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float)
    bins, rounds, rate, ridge, pair_rounds = 5, 4, 0.3, 2.0, 2
    model = quality.train(x, y, bins, rounds, rate, 1, pair_rounds, ridge)

    edges = [sorted(set(np.quantile(x[:, i], [k / bins for k in range(1, bins)]).tolist())) for i in range(x.shape[1])]
    at = [[sum(e <= v for e in edges[i]) for i, v in enumerate(row)] for row in x.tolist()]
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    score = [math.log(p0 / (1 - p0))] * len(y)
    chance = lambda s: 1 / (1 + math.exp(-s))
    for _ in range(rounds):
        for i in range(x.shape[1]):
            g, h = [0.0] * (len(edges[i]) + 1), [0.0] * (len(edges[i]) + 1)
            for r, s in enumerate(score):
                g[at[r][i]] += y[r] - chance(s)
                h[at[r][i]] += chance(s) * (1 - chance(s))
            tree = plain_tree(g, h, ridge)
            score = [s + rate * tree[at[r][i]] for r, s in enumerate(score)]
    cell = [[b * quality.GRID // (len(edges[i]) + 1) for i, b in enumerate(row)] for row in at]

    def grid(i, j):
        g, h = np.zeros((8, 8)), np.zeros((8, 8))
        for r, s in enumerate(score):
            g[cell[r][i], cell[r][j]] += y[r] - chance(s)
            h[cell[r][i], cell[r][j]] += chance(s) * (1 - chance(s))
        return g, h

    _, i, j = max((round(plain_quadrants(*grid(i, j), ridge)[0], 9), i, j) for i in range(x.shape[1]) for j in range(i))
    assert [(i, j)] == [p[:2] for p in model.pairs]
    for _ in range(pair_rounds):
        values = plain_quadrants(*grid(i, j), ridge)[1]
        score = [s + rate * values[cell[r][i], cell[r][j]] for r, s in enumerate(score)]
    assert np.allclose(model.score(x), [chance(s) for s in score])
