"""The boosted additive model against plain loops over rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from gridloom.llm import quality


def plain_cuts(values, bins):
    v, out = sorted(values), []
    for b in range(1, bins):
        at = (len(v) - 1) * b / bins
        low = math.floor(at)
        out.append(v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low))
    return sorted(set(out))


def bin_of(v, cuts):
    return sum(c <= v for c in cuts)


def sums(bins, n, g):
    return [sum(x for b, x in zip(bins, g) if b == k) for k in range(n)]


def plain_split(g, h, reg, least):
    best, at = 0.0, 0
    gt, ht = sum(g), sum(h)
    for cut in range(1, len(g)):
        gl, hl = sum(g[:cut]), sum(h[:cut])
        if hl >= least and ht - hl >= least:
            gain = gl**2 / (hl + reg) + (gt - gl) ** 2 / (ht - hl + reg) - gt**2 / (ht + reg)
            if gain > best:
                best, at = gain, cut
    return best, at


def plain_tree(g, h, reg, least):
    parts = [list(range(len(g)))]
    for _ in range(2):
        grown = []
        for p in parts:
            _, at = plain_split([g[k] for k in p], [h[k] for k in p], reg, least)
            grown += [p[:at], p[at:]] if at else [p]
        parts = grown
    out = [0.0] * len(g)
    for p in parts:
        for k in p:
            out[k] = -sum(g[j] for j in p) / (sum(h[j] for j in p) + reg)
    return out


def plain_tree2(g, h, reg, least):
    """``g`` and ``h`` by (row, column); the first cut along rows, then along columns, or the other way round."""
    rows, cols = 1 + max(a for a, _ in g), 1 + max(b for _, b in g)
    best, table = 0.0, {c: 0.0 for c in g}
    for turn in (False, True):
        outer, inner = (cols, rows) if turn else (rows, cols)
        cell = (lambda a, b: (b, a)) if turn else (lambda a, b: (a, b))
        total, cut = plain_split([sum(g[cell(a, b)] for b in range(inner)) for a in range(outer)], [sum(h[cell(a, b)] for b in range(inner)) for a in range(outer)], reg, least)
        if not cut:
            continue
        out = {}
        for half in (range(cut), range(cut, outer)):
            ga, ha = ([sum(w[cell(a, b)] for a in half) for b in range(inner)] for w in (g, h))
            gain, at = plain_split(ga, ha, reg, least)
            total += gain
            for part in (range(at), range(at, inner)) if at else (range(inner),):
                for a in half:
                    for b in part:
                        out[cell(a, b)] = -sum(ga[k] for k in part) / (sum(ha[k] for k in part) + reg)
        if total > best:
            best, table = total, out
    return best, table


def plain_model(x, y, bins, pair_bins, rounds, n_pairs, rate, reg, least):
    """The total of every row of ``x`` after training on it, pair after pair and feature after feature."""
    n, k = len(x), len(x[0])
    prior = (sum(y) + 1) / (n + 2)
    total = [math.log(prior / (1 - prior))] * n

    def gradients():
        p = [1 / (1 + math.exp(-t)) for t in total]
        return [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]

    cuts = [plain_cuts([r[f] for r in x], bins) for f in range(k)]
    place = [[bin_of(r[f], cuts[f]) for r in x] for f in range(k)]
    for _ in range(rounds):
        for f in range(k):
            g, h = gradients()
            step = plain_tree(sums(place[f], len(cuts[f]) + 1, g), sums(place[f], len(cuts[f]) + 1, h), reg, least)
            total[:] = [t + rate * step[b] for t, b in zip(total, place[f])]
    coarse = [plain_cuts([r[f] for r in x], pair_bins) for f in range(k)]
    spot = [[bin_of(r[f], coarse[f]) for r in x] for f in range(k)]

    def grid(i, j, w):
        out = {(a, b): 0.0 for a in range(len(coarse[i]) + 1) for b in range(len(coarse[j]) + 1)}
        for a, b, v in zip(spot[i], spot[j], w):
            out[a, b] += v
        return out

    g, h = gradients()
    gains = sorted((-plain_tree2(grid(i, j, g), grid(i, j, h), reg, least)[0], i, j) for i in range(k) for j in range(i + 1, k))[:n_pairs]
    for _ in range(rounds // 2):
        for gain, i, j in gains:
            if gain < 0:
                g, h = gradients()
                step = plain_tree2(grid(i, j, g), grid(i, j, h), reg, least)[1]
                total[:] = [t + rate * step[a, b] for t, a, b in zip(total, spot[i], spot[j])]
    return [1 / (1 + math.exp(-t)) for t in total], [(i, j) for gain, i, j in gains if gain < 0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_training_and_scores_match_plain_loops(seed):
    rng = random.Random(seed)
    x = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(150)]
    # One feature speaks for itself, two only together.
    y = [int(r[0] + 2 * (r[1] > 0) * (r[2] > 0) + rng.gauss(0, 0.5) > 0.7) for r in x]
    how = dict(bins=8, pair_bins=4, rounds=12, n_pairs=2, rate=0.2, reg=1.0, least=2.0)
    model = quality.train(np.array(x), np.array(y), **how)
    want, pairs = plain_model(x, y, **how)
    assert [(i, j) for i, j, *_ in model.pairs] == pairs and pairs
    assert np.allclose(model.score(np.array(x)), want, rtol=0, atol=1e-9)


def test_one_label_gives_the_prior():
    model = quality.train(np.zeros((8, 3)), np.ones(8))
    assert np.allclose(model.score(np.zeros((2, 3))), 9 / 10)
