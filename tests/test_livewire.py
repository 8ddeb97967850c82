"""Ways along seams against Dijkstra's search and plain walks of the cracks."""

from __future__ import annotations

import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.operators import seams
from gridloom.plans.durable import durable


def chains(spark, grids):
    rows = [(z, y, x, v) for z, g in enumerate(grids) for y, r in enumerate(g) for x, v in enumerate(r)]
    return durable(seams.seams(seams.cracks(spark.createDataFrame(rows, "z int, y int, x int, label int"), len(grids[0][0]))), "chains")


def blotches(rng, side):
    centres = [(rng.randrange(side), rng.randrange(side), k) for k in range(12)]
    return [[min((abs(y - a) + abs(x - b), k) for a, b, k in centres)[1] for x in range(side)] for y in range(side)]


ISLAND = [[1] * 14 for _ in range(14)]
for _y in range(4, 8):
    for _x in range(3, 9):
        ISLAND[_y][_x] = 2


def walks(rows):
    """Corners of each seam in order, by stepping from crack to crack."""
    by_seam = defaultdict(list)
    for r in rows:
        by_seam[r.z, r.seam].append(r)
    out = {}
    for key, cracks in by_seam.items():
        at = defaultdict(list)
        for c in cracks:
            at[c.c0].append(c)
            at[c.c1].append(c)
        ends = sorted(k for k, v in at.items() if len(v) == 1)
        start = ends[0] if ends else min(cracks, key=lambda c: c.crack).c0
        here, left = [start], list(cracks)
        nxt = None if ends else min(cracks, key=lambda c: c.crack)
        while left:
            c = nxt or next(c for c in left if here[-1] in (c.c0, c.c1))
            nxt = None
            left.remove(c)
            here.append(c.c1 if c.c0 == here[-1] else c.c0)
        out[key] = here
    return out


def search(table, z, start, goal):
    """Least cost from a point to a point of the seams of a slice; None if there is no way."""
    ts = {r.seam: r for r in table if r.z == z}
    (s, i), (t, k) = start, goal
    rate = lambda r: r.toll / r.length
    best = []
    if s == t:
        n = ts[s].length
        best.append((min((k - i) % n, (i - k) % n) if ts[s].closed else abs(k - i)) * rate(ts[s]))
    if not ts[s].closed and not ts[t].closed:
        arcs = defaultdict(list)
        for r in ts.values():
            if not r.closed:
                arcs[r.j0].append((r.j1, r.toll))
                arcs[r.j1].append((r.j0, r.toll))
        dist, heap = {}, [(i * rate(ts[s]), ts[s].j0), ((ts[s].length - i) * rate(ts[s]), ts[s].j1)]
        heapq.heapify(heap)
        while heap:
            c, u = heapq.heappop(heap)
            if u not in dist:
                dist[u] = c
                for v, w in arcs[u]:
                    heapq.heappush(heap, (c + w, v))
        for end, rest in ((ts[t].j0, k), (ts[t].j1, ts[t].length - k)):
            if end in dist:
                best.append(dist[end] + rest * rate(ts[t]))
    return min(best) if best else None


@pytest.mark.parametrize("seed", [1, 2])
def test_ways_are_cheapest_connected_and_in_order(spark, seed):
    rng = random.Random(seed)
    cracks = chains(spark, [blotches(rng, 14), blotches(rng, 14), ISLAND])
    places = durable(seams.placed(cracks), "placed")
    corners = walks(cracks.collect())
    assert places.count() == cracks.count()
    edges = {(r.z, r.c0, r.c1) for r in cracks.collect()}
    for r in places.collect():
        line = corners[r.z, r.seam]
        assert (line[r.at], line[r.at + 1]) == ((r.c0, r.c1) if r.fore else (r.c1, r.c0))

    tolled = durable(seams.seam_table(cracks).withColumn("toll", F.col("length") * (1 + F.pmod(F.xxhash64("seam"), F.lit(7)))), "tolled")
    table = tolled.collect()
    events, wanted = [], []
    for z in range(3):
        of = sorted((r for r in table if r.z == z), key=lambda r: r.seam)
        for trace in range(4):
            stack = []
            for n in range(7):
                if n in (3, 5) and trace < 3:
                    events.append((z, trace, n, None, None))
                    if stack:
                        stack.pop()
                    continue
                r = rng.choice(of)
                p = (r.seam, rng.randint(0, r.length))
                events.append((z, trace, n, *p))
                base = [e for e in events if e[:2] == (z, trace) and e[3] is not None][0]
                if search(table, z, base[3:], p) is not None:
                    stack.append(p)
            wanted += [(z, trace, n, a, b) for n, (a, b) in enumerate(zip(stack, stack[1:]))]
    events += [(0, 9, 0, -5, 0), (0, 9, 1, table[0].seam, -1), (1, 8, 0, None, None)]
    df = spark.createDataFrame(events, "z int, trace int, ordinal int, seam long, idx long")
    steps = durable(seams.livewire(df, tolled), "steps")
    got = defaultdict(list)
    for r in steps.orderBy("z", "trace", "leg", "step").collect():
        got[r.z, r.trace, r.leg].append(r)
    taken = defaultdict(list)
    for r in seams.walked(steps, places).orderBy("z", "trace", "leg", "step", "pos").collect():
        taken[r.z, r.trace, r.leg].append(r.corner)
    by = {(r.z, r.seam): r for r in table}
    assert set(got) <= {w[:3] for w in wanted}
    for z, trace, leg, (s, i), (t, k) in wanted:
        cost = search(table, z, (s, i), (t, k))
        rows = got.get((z, trace, leg), [])
        if not rows:
            assert cost == 0
            continue
        assert abs(rows[0].cost - cost) < 1e-6 and [r.step for r in rows] == list(range(len(rows)))
        assert abs(sum(abs(r.i1 - r.i0) * by[z, r.seam].toll / by[z, r.seam].length for r in rows) - cost) < 1e-6
        line = [corners[z, s][i], *taken[z, trace, leg]]
        assert line[-1] == corners[z, t][k] and len(line) == 1 + sum(abs(r.i1 - r.i0) for r in rows)
        assert all((z, *sorted(p)) in edges for p in zip(line, line[1:]))


def test_traces_of_nothing(spark):
    cracks = chains(spark, [[[1, 1], [1, 1]]])
    tolled = seams.tolls(seams.seam_table(cracks).withColumn("affinity", F.lit(0.5)))
    df = spark.createDataFrame([(0, 0, 0, 3, 1)], "z int, trace int, ordinal int, seam long, idx long")
    assert seams.livewire(df, tolled).count() == 0 and seams.placed(cracks).count() == 0
