"""Living regions of a volume by level against descent and merging by hand."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from gridloom.operators import volume
from gridloom.operators.topology import SIDE
from gridloom.plans.durable import durable

STEPS = [(a * s, b * s, c * s) for a, b, c in ((1, 0, 0), (0, 1, 0), (0, 0, 1)) for s in (1, -1)]
LEVELS = [0.0, 2.0, 4.0, 9.0, 100.0]


def by_hand(at):
    """Basin by voxel, and at each level the region by basin: the lowest saddle left merges, the younger minimum ends."""
    gid = lambda p: (p[0] * SIDE + p[1]) * SIDE + p[2]
    near = lambda p: [q for q in (tuple(a + b for a, b in zip(p, s)) for s in STEPS) if q in at]
    down = {p: min([p, *near(p)], key=lambda q: (at[q], gid(q))) for p in at}

    def end(p):
        while down[p] != p:
            p = down[p]
        return p

    basin = {p: end(p) for p in at}
    saddles = {}
    for p in at:
        for q in near(p):
            a, b = sorted((gid(basin[p]), gid(basin[q])))
            if a != b:
                saddles[a, b] = min(saddles.get((a, b), 1e9), max(at[p], at[q]))
    low = {gid(b): at[b] for b in basin.values()}
    group, into, dies = {b: b for b in low}, {}, {}
    for (a, b), h in sorted(saddles.items(), key=lambda e: (e[1], e[0])):
        a, b = group[a], group[b]
        if a != b:
            old, young = sorted((a, b), key=lambda n: (low[n], n))
            into[young], dies[young] = old, h - low[young]
            group = {k: old if v == young else v for k, v in group.items()}
    out = {}
    for level in LEVELS:
        counts = defaultdict(int)
        for b in basin.values():
            b = gid(b)
            while dies.get(b, 1e9) < level:
                b = into[b]
            counts[b] += 1
        out.update({(level, b): (n, low[b]) for b, n in counts.items()})
    return out


@pytest.mark.parametrize("seed,small", [(1, 100_000), (2, 0)])
def test_living_voxels_by_level(spark, seed, small):
    rng = random.Random(seed)
    at = {(z, y, x): float(rng.randrange(12)) for z in range(5) for y in range(6) for x in range(7) if rng.random() < 0.9}
    df = spark.createDataFrame([(*p, v) for p, v in at.items()], "z int, y int, x int, v double")
    labelled = durable(volume.basins(df), "labelled")
    deaths = durable(volume.persistence(labelled, small=small), "deaths")
    got = volume.snapshots(labelled, deaths, LEVELS).collect()
    assert {(r.level, r.living): (r.voxels, r.low) for r in got} == by_hand(at)
    voxels = volume.living_voxels(labelled, volume.living(deaths, 4.0)).groupBy("living").count().collect()
    assert {r.living: r["count"] for r in voxels} == {r.living: r.voxels for r in got if r.level == 4.0}
