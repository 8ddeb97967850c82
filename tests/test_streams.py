"""State over streams: bridges that come late, gaps that never fill, and the state that stays."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import linking
from gridloom.plans.durable import fresh_path
from gridloom.streaming.stateful import PROVIDER, final_ids, in_order, link_stream, to_parquet


def arriving(spark, batches, schema):
    """A stream of one file a batch, in order."""
    path = fresh_path(spark, "arriving")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def linked(spark, slices, connectivity=6, tile=3):
    """``slices``: rows of letters, one component a letter, in a volume of one or more slices."""
    cells = [[(0, z, y, x, ord(c) - 96) for y, row in enumerate(s) for x, c in enumerate(row) if c != "."] for z, s in enumerate(slices)]
    named = to_parquet(link_stream(arriving(spark, cells, "volume long, z int, y int, x int, component long"), connectivity, tile))
    return named, {(r.slice_index, r.segment_id): r.global_id for r in final_ids(named).collect()}


def test_a_late_bridge_merges_what_had_ids_of_its_own(spark):
    before = spark.conf.get(PROVIDER, None)
    named, ids = linked(spark, [["aa.bb"], ["aaaaa"]])
    assert ids == {(0, 1): 1, (0, 2): 1, (1, 1): 1}
    assert [(r.node, r.root) for r in named.filter("renamed").collect()] == [(2, 1)]
    assert spark.conf.get(PROVIDER, None) == before


def test_features_without_a_successor_stay_apart_and_ids_are_first_seen(spark):
    _, ids = linked(spark, [["aa.bb"], ["aa..."], ["....a"]])
    assert ids == {(0, 1): 1, (0, 2): 2, (1, 1): 1, (2, 1): 3}


@pytest.mark.parametrize("connectivity", [18, 26])
def test_links_over_the_border_of_tiles_equal_the_batch(spark, connectivity):
    rng = random.Random(connectivity)
    cells = [(z, y, x) for z in range(3) for y in range(8) for x in range(8) if rng.random() < 0.25]
    labelled = linking.slice_components(spark.createDataFrame(cells, "z int, y int, x int"), connectivity)
    rows = [tuple(r) for r in labelled.select("z", "y", "x", "component").collect()]
    batches = [[(5, *r) for r in rows if r[0] == z] for z in range(3)]
    got = final_ids(to_parquet(link_stream(arriving(spark, batches, "volume long, z int, y int, x int, component long"), connectivity, 3))).drop("volume")
    want = linking.feature_map(linking.assign_global(labelled, connectivity))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_indices_wait_repeats_go_and_gaps_are_flushed(spark):
    stamp = lambda rows, at: [(s, i, at) for s, i in rows]
    batches = [stamp([(1, 2), (1, 0), (2, 1)], 1000), stamp([(1, 1), (1, 0), (1, 5), (1, 4)], 1001), stamp([(9, 0)], 200_000), stamp([(9, 1)], 200_001), stamp([(1, 3), (9, 2)], 200_002)]
    stream = arriving(spark, batches, "sequence long, index long, t long").select("sequence", "index", F.timestamp_seconds("t").alias("ts"))
    got = to_parquet(in_order(stream, time="ts", late="1 minute", patience_ms=60_000)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, False), (1, 1, False), (1, 2, False), (1, 4, True), (1, 5, True), (2, 1, True), (9, 0, False), (9, 1, False), (9, 2, False)]


def test_without_a_time_gaps_wait(spark):
    got = to_parquet(in_order(arriving(spark, [[(1, 1), (1, 0)], [(1, 3)]], "sequence long, index long"))).collect()
    assert sorted(map(tuple, got)) == [(1, 0, False), (1, 1, False)]


class Store:
    """A handle, and its value, list and map states of one key, in plain Python."""

    def __init__(self):
        self.value, self.items, self.map, self.timers = None, [], {}, set()
        self.getValueState = self.getListState = self.getMapState = lambda name, *schema: {"expected": Cell(self, "value"), "waiting": Cell(self, "items" if len(schema) == 1 else "map")}[name]
        self.listTimers, self.deleteTimer, self.registerTimer = lambda: set(self.timers), self.timers.discard, self.timers.add


class Cell:
    def __init__(self, store, kind):
        self.store, self.kind = store, kind
        self.put, self.update = (lambda v: setattr(store, kind, v),) * 2
        self.get = lambda: getattr(store, kind)
        self.exists = lambda: bool(getattr(store, kind))
        self.clear = lambda: setattr(store, kind, type(getattr(store, kind))())
        self.getValue, self.keys = store.map.get, lambda: iter(list(store.map))
        self.updateValue, self.removeKey = store.map.__setitem__, store.map.pop


def processor(store):
    from gridloom.streaming.stateful import InOrder

    p = InOrder(("sequence", "index"), "ts", 1000)
    p.init(store)
    return p


@pytest.mark.parametrize("seed", range(6))
def test_blocks_release_what_a_set_would(seed, monkeypatch):
    import pandas as pd

    from gridloom.streaming.stateful import InOrder

    monkeypatch.setattr(InOrder, "BLOCK", 8, raising=False)
    monkeypatch.setattr(InOrder, "GATHERED", 16, raising=False)
    rng = random.Random(seed)
    store, at, held = Store(), 0, set()
    p = processor(store)
    todo = [i for i in range(200) if i % 50 != 7 or seed % 2] + [10_000, -3, 5, 5]
    rng.shuffle(todo)
    while todo:
        batch, todo = todo[:45], todo[45:]
        pdfs = [pd.DataFrame({"index": batch[k : k + 10], "ts": pd.Timestamp(1, unit="s")}) for k in range(0, len(batch), 10)]
        got = [(r.sequence, r.index_, r.flushed) for pdf in p.handleInputRows((3,), iter(pdfs), None) for r in pdf.rename(columns={"index": "index_"}).itertuples()]
        held |= {i for i in batch if i >= at}
        want = []
        while at in held:
            held.remove(at)
            want.append((3, at, False))
            at += 1
        assert got == want and bool(store.timers) == bool(held)
    got = [(r.sequence, r.index_, r.flushed) for pdf in p.handleExpiredTimer((3,), None, None) for r in pdf.rename(columns={"index": "index_"}).itertuples()]
    assert got == [(3, i, True) for i in sorted(held)] and not store.map


def test_a_long_sequence_waits_in_little_memory():
    """A million and a half indices behind a gap: the worker may not hold them as Python objects, nor as one frame."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    n, step = 1_500_000, 10_000
    p = processor(Store())
    pdfs = (pd.DataFrame({"index": np.arange(k, k + step)[::-1], "ts": pd.Timestamp(1, unit="s")}) for k in range(n - step, -1, -step))
    tracemalloc.start()
    longest = total = 0
    for frames in (p.handleInputRows((0,), (d[d["index"] != 7] for d in pdfs), None), p.handleExpiredTimer((0,), None, None)):
        for pdf in frames:
            longest, total = max(longest, len(pdf)), total + len(pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == n - 1 and longest <= 1 << 16 and peak < 50e6
