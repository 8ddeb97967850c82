"""Operators on hand-made fixtures, against plain Python twins and invariants."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import components, graph, learn, linking, measure, ordering, planes, predicate, raster, seams, stats, topology, volume
from gridloom.operators.predicate import Gate, PixelRule, Query
from gridloom.plans import spec, workflow
from gridloom.sources import files, raw, tiff


def pixels(spark, grids, value="v"):
    rows = [(z, y, x, float(v)) for z, g in enumerate(grids) for y, r in enumerate(g) for x, v in enumerate(r) if v is not None]
    return spark.createDataFrame(rows, f"z int, y int, x int, {value} double")


def random_grid(seed, h=8, w=8, top=30):
    r = random.Random(seed)
    return [[r.randrange(top) for _ in range(w)] for _ in range(h)]


# predicates -----------------------------------------------------------------


def test_nan_never_passes(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 5.0), (3, None), (4, 1e301)], "label int, f double")
    keep = lambda q: sorted(r.label for r in predicate.select_rows(df, [q]).collect())
    assert keep(Query("f", "gt", 1e300)) == [4]
    assert keep(Query("f", "between", 5, 5)) == [2]
    assert keep(Query("f", "nonsense", 5)) == []
    assert keep(Query("g", "ge", 0)) == []
    with pytest.raises(ValueError):
        predicate.select_rows(df, [Query("g", "ge", 0)], strict=True)


def test_nan_survives_omission(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 5.0), (3, 7.0)], "label int, f double")
    assert [r.label for r in predicate.trim_pixels(df, [PixelRule(Query("f", "gt", 6), keep=False)]).orderBy("label").collect()] == [1, 2]
    assert predicate.trim_pixels(df, [PixelRule(Query("f", "gt", 6))]).count() == 1


def test_gate_and_textual_rule(spark):
    df = spark.createDataFrame([(k, k * 10, 0.0, 9.0, float(k)) for k in range(6)], "label int, area int, min_value double, max_value double, mean_value double")
    assert [r.label for r in predicate.gate(df, Gate(min_area=20, max_area=40, deny=(3,))).orderBy("label").collect()] == [2, 4]
    assert predicate.gate(df, Gate(allow=())).count() == 0
    assert predicate.drop_matching(df, "area >= 30").count() == 3
    assert predicate.drop_matching(df, " area != 30 ").count() == 1
    with pytest.raises(ValueError):
        predicate.parse_rule("area >= x; drop")
    with pytest.raises(ValueError):
        predicate.crop(df, 3, 3, 0, 1)


# statistics -----------------------------------------------------------------


def test_merge_of_partials_is_whole(spark):
    df = pixels(spark, [random_grid(1), random_grid(2)]).withColumn("label", F.expr("x div 4"))
    whole = stats.moments(df, ["label"], ["v"])
    parts = stats.merge_moments(stats.moments(df, ["z", "y", "label"], ["v"]), ["label"], ["v"])
    key = lambda t: sorted(map(tuple, t.select("label", "area", "sum_v", "sumsq_v", "min_v", "max_v").collect()))
    assert key(whole) == key(parts)


def test_moments_ignore_nan_in_extremes_and_empty_is_zero(spark):
    df = spark.createDataFrame([(0, float("nan")), (0, 3.0)], "label int, v double")
    row = stats.moments(df, ["label"], ["v"]).first()
    assert (row.min_v, row.max_v) == (3.0, 3.0) and math.isnan(row.sum_v)
    empty = spark.createDataFrame([(0, 0.0, 0.0)], "area int, sum_v double, sumsq_v double")
    assert empty.select(stats.mean_of("v"), stats.std_of("v")).first() == (0.0, 0.0)


def test_extremum_is_first_in_raster_order(spark):
    df = pixels(spark, [[[5, 1, 9], [1, 9, 1]]]).withColumn("label", F.lit(1))
    low, high = stats.extremum(df, ["label"], "v").first(), stats.extremum(df, ["label"], "v", largest=True).first()
    assert (low.ext_y, low.ext_x, high.ext_y, high.ext_x) == (0, 1, 0, 2)


def test_histogram_shares_sum_to_one(spark):
    df = pixels(spark, [random_grid(3)]).withColumn("label", F.expr("y div 4"))
    for r in stats.histogram_shares(df, ["label"], "v", 5, 20, 5).collect():
        assert abs(sum(r[f"hist{k:02d}_v"] for k in range(5)) - 1) < 1e-12


def test_relevance_limits(spark):
    one = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (-1.0, 2.0, 0.0, 1.0), (1.0, 3.0, 0.0, 3.0)], "lo double, hi double, f double, c double")
    got = [r[0] for r in one.select(stats.relevance(F.col("lo"), F.col("hi"), F.col("f"), F.col("c"))).collect()]
    assert got[0] == 0.0 and got[1] == math.inf and got[2] == 0.5


# components and linking -------------------------------------------------------


def twin_components(edges, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)] + [(7, 7)]
    df = spark.createDataFrame(edges + [(None, 3)], "u long, v long")
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    want = twin_components([e for e in edges if e[0] != e[1]], nodes)
    assert {x.node: x.component for x in components.connected_components(df).collect()} == want


def test_components_of_nothing_and_of_a_hub(spark):
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    star = spark.range(1, 400).selectExpr("id AS u", "0L AS v")
    assert {r.component for r in components.connected_components(star).collect()} == {0}


def test_bridge_joins_components_and_ids_are_first_seen(spark):
    grid = [[[1, None, 1, None, 1]], [[1, 1, 1, None, 1]]]
    linked = linking.assign_global(linking.slice_components(pixels(spark, grid), 6), 6)
    ids = {(r.z, r.x): r.global_id for r in linked.collect()}
    assert ids[0, 0] == ids[0, 2] == ids[1, 1] == 1 and ids[0, 4] == ids[1, 4] == 2


@pytest.mark.parametrize("connectivity", [6, 18, 26])
def test_linking_matches_brute_force(spark, connectivity):
    grids = [[[1 if v > 17 else None for v in r] for r in random_grid(50 + k, 6, 6)] for k in range(3)]
    cells = {(z, y, x) for z, g in enumerate(grids) for y, r in enumerate(g) for x, v in enumerate(r) if v}
    steps = set(linking.STEPS[connectivity])
    near = lambda a, b: (
        (a[0] == b[0] and (abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 if connectivity == 6 else max(abs(a[1] - b[1]), abs(a[2] - b[2])) == 1)) or (b[0] - a[0] == 1 and (b[1] - a[1], b[2] - a[2]) in steps)
    )
    want = twin_components([(a, b) for a in cells for b in cells if near(a, b)], cells)
    linked = linking.assign_global(linking.slice_components(pixels(spark, grids), connectivity), connectivity)
    got = {(r.z, r.y, r.x): r.global_id for r in linked.collect()}
    for a in cells:
        for b in cells:
            assert (got[a] == got[b]) == (want[a] == want[b])


# rasters ----------------------------------------------------------------------


def test_blur_keeps_constants_and_derivative_finds_slopes(spark):
    flat = pixels(spark, [[[4] * 9] * 9])
    assert all(abs(r.blur - 4) < 1e-9 for r in raster.gaussian(flat, "v", 1.5).collect())
    ramp = pixels(spark, [[[3 * x for x in range(15)] for _ in range(15)]])
    mid = raster.derivatives(ramp, "v", 1.0).filter("x = 7 AND y = 7").first()
    assert abs(mid.dx - 3) < 1e-9 and abs(mid.dy) < 1e-9 and abs(mid.dxx) < 1e-9


def test_bank_equals_single_filters(spark):
    df = pixels(spark, [random_grid(9, 7, 7)])
    bank = {(r.y, r.x): r for r in raster.measurement_bank(df, "v", [1.0, 2.0]).collect()}
    for r in raster.laplacian(df, "v", 2.0).collect():
        assert abs(bank[r.y, r.x]["laplacian_s2"] - r.laplacian) < 1e-9
    for r in raster.gradient_magnitude(df, "v", 1.0).collect():
        assert abs(bank[r.y, r.x]["gradmag_s1"] - r.gradmag) < 1e-9


def test_open_is_below_and_close_above(spark):
    df = pixels(spark, [random_grid(4)])
    both = raster.morphology(raster.morphology(df, "v", "open", 1, "o"), "v", "close", 1, "c")
    assert both.filter("o > v OR c < v").count() == 0


def test_moving_average_repeats_the_ends(spark):
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([1, 5, 3, 8])], "i int, v double")
    want = np.convolve(np.pad([1.0, 5, 3, 8], 1, mode="edge"), np.ones(3) / 3, "valid")
    assert np.allclose([r.smooth for r in raster.moving_average(df, "i", "v", 3).orderBy("i").collect()], want)
    with pytest.raises(ValueError):
        raster.moving_average(df, "i", "v", 4)


def test_filter_chain_refuses_unknown(spark):
    df = pixels(spark, [random_grid(5, 4, 4)])
    assert raster.filter_chain(df, "v", []).filter("out <> v").count() == 0
    with pytest.raises(ValueError):
        raster.filter_chain(df, "v", [("sharpen", {})])


# topology -----------------------------------------------------------------------


def twin_basins(grid):
    h, w = len(grid), len(grid[0])
    key = lambda y, x: (grid[y][x], y * w + x)

    def down(y, x):
        near = [(y, x), *[(y + a, x + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= y + a < h and 0 <= x + b < w]]
        return min(near, key=lambda p: key(*p))

    out = {}
    for y in range(h):
        for x in range(w):
            at = (y, x)
            while down(*at) != at:
                at = down(*at)
            out[y, x] = at
    return out


@pytest.mark.parametrize("seed", range(3))
def test_basins_match_descent(spark, seed):
    grid = random_grid(seed, 9, 9, 12)
    want = twin_basins(grid)
    for tile in (2, 4, 512):
        got = {(r.y, r.x): (r.basin // topology.SIDE, r.basin % topology.SIDE) for r in topology.basins(pixels(spark, [grid]), tile=tile).collect()}
        assert got == want


def test_persistence_is_monotone_and_keeps_area(spark):
    labelled = topology.basins(pixels(spark, [random_grid(11, 12, 12), random_grid(12, 12, 12)])).cache()
    table, arcs = topology.basin_table(labelled), topology.basin_arcs(labelled)
    deaths = topology.persistence(table, arcs).cache()
    for r in topology.sweep(deaths, [0, 2, 5, 10, 100]).collect():
        assert [r[f"n_{k}"] for k in range(5)] == sorted((r[f"n_{k}"] for k in range(5)), reverse=True) and r.n_4 == 1
    rolled = topology.roll_up(table, topology.living(deaths, 5.0))
    assert {r[0]: r[1] for r in rolled.groupBy("z").agg(F.sum("area")).collect()} == {0: 144, 1: 144}
    assert rolled.count() == sum(r.n_2 for r in topology.sweep(deaths, [0, 2, 5]).collect())


def test_elder_rule():
    ends = topology.merge_order([(1, 0.0), (2, 3.0), (3, 1.0)], [(5.0, 1, 2), (4.0, 2, 3), (9.0, 1, 3)])
    assert ends == [(2, 3, 4.0, 1.0), (3, 1, 5.0, 4.0)]


def test_volume_basins_reach_a_minimum(spark):
    df = pixels(spark, [random_grid(k, 5, 5) for k in range(4)])
    out = volume.basins(df)
    assert out.count() == 100
    lows = {r.basin: r.low for r in out.groupBy("basin").agg(F.min("v").alias("low")).collect()}
    at = {(r.z * topology.SIDE + r.y) * topology.SIDE + r.x: r.v for r in df.collect()}
    assert all(at[b] == low for b, low in lows.items())


def test_affine_values_keep_labels(spark):
    grid = random_grid(21, 8, 8)
    a = topology.basins(pixels(spark, [grid])).select("y", "x", "basin")
    b = topology.basins(pixels(spark, [[[2.5 * v + 7 for v in r] for r in grid]])).select("y", "x", "basin")
    assert a.exceptAll(b).count() == 0


# graphs ---------------------------------------------------------------------------


def grid_graph(n=3):
    ids = lambda y, x: y * n + x
    return [(0, ids(y, x), ids(y + a, x + b)) for y in range(n) for x in range(n) for a, b in ((0, 1), (1, 0)) if y + a < n and x + b < n]


def test_ring_of_a_constant_has_no_contrast_and_isolated_take_their_own(spark):
    arcs = spark.createDataFrame([(*e, 2) for e in grid_graph()], "z int, a int, b int, length int")
    table = spark.createDataFrame([(0, k, 1, 7.0) for k in range(9)] + [(0, 99, 1, 4.0)], "z int, label int, area int, m double")
    for how in ("uniform", "area", "contact"):
        for r in graph.ring(table, arcs, ["m"], how).collect():
            assert r.ring_contrast_m == 0 and r.ring_std_m == 0 and r.ring_mean_m == r.m


def test_bottleneck_costs_match_brute_force(spark):
    r = random.Random(5)
    arcs = [(0, a, b, float(r.randrange(50))) for _, a, b in grid_graph(4)]
    cost = {k: math.inf for k in range(16)} | {0: -math.inf}
    for _ in range(16):
        for _, a, b, w in arcs:
            cost[b], cost[a] = min(cost[b], max(cost[a], w)), min(cost[a], max(cost[b], w))
    df = spark.createDataFrame(arcs, "z int, a int, b int, saddle double")
    got = graph.join_costs(df, spark.createDataFrame([(0, 0)], "z int, node int"))
    assert {x.node: x.cost for x in got.collect()} == cost


def test_vote_without_strength_is_argmax_and_with_it_smooths(spark):
    p = spark.createDataFrame([(0, k, [0.9, 0.1]) for k in range(9) if k != 4] + [(0, 4, [0.45, 0.55])], "z int, label int, p array<double>")
    arcs = spark.createDataFrame([(*e, 0.05) for e in grid_graph()], "z int, a int, b int, p_diff double")
    get = lambda s: {r.label: r["class"] for r in graph.vote(p, arcs, 2, strength=s).collect()}
    assert get(0.0)[4] == 1 and set(get(1.0).values()) == {0}


def test_walks_stay_on_arcs(spark):
    arcs = spark.createDataFrame(grid_graph(), "z int, a int, b int")
    ends = graph.walk_ends(arcs, spark.createDataFrame([(0, k) for k in [*range(9), 50]], "z int, node int"), 1)
    near = {(a, b) for _, a, b in grid_graph()} | {(b, a) for _, a, b in grid_graph()} | {(50, 50)}
    got = ends.collect()
    assert len(got) == 10 and all((r.start, r.node) in near for r in got)


# seams ------------------------------------------------------------------------------


def test_four_blocks_meet_in_one_junction(spark):
    grid = [[1, 1, 2, 2], [1, 1, 2, 2], [3, 3, 4, 4], [3, 3, 4, 4]]
    c = seams.cracks(pixels(spark, [grid], "label").withColumn("label", F.col("label").cast("int")), 4)
    inner = [r for r in seams.corners(c).collect() if r.degree == 4]
    assert c.count() == 8 and len(inner) == 1 and inner[0].corner == 2 * 5 + 2
    table = seams.seam_table(seams.seams(c)).collect()
    assert len(table) == 4 and all(r.length == 2 for r in table)


def test_island_is_one_closed_seam(spark):
    grid = [[1] * 4, [1, 2, 2, 1], [1, 2, 2, 1], [1] * 4]
    table = seams.seam_table(seams.seams(seams.cracks(pixels(spark, [grid], "label").withColumn("label", F.col("label").cast("int")), 4))).collect()
    assert len(table) == 1 and table[0].closed and table[0].length == 8


# measures and models -----------------------------------------------------------------


def test_mixture_finds_two_normals(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(10, 1, 600), rng.normal(20, 2, 400)])
    df = spark.createDataFrame([(0, float(v)) for v in values], "z int, v double")
    r = measure.gmm(df, "v", ["z"], rounds=30).first()
    assert abs(r.mu_1 - 10) < 0.3 and abs(r.mu_2 - 20) < 0.4 and abs(r.w_1 - 0.6) < 0.05
    peaks = measure.two_peaks(df, "v", ["z"]).first()
    assert abs(peaks.peak_low - 10) < 1.5 and abs(peaks.peak_high - 20) < 3


def test_metrics_match_hand_counts(spark):
    rows = [(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1), (1, 0.6), (0, 0.7)]
    r = learn.metrics(spark.createDataFrame(rows, "y int, p double")).first()
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for ya, a in rows if ya for yb, b in rows if not yb]
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 2) and abs(r.auc - sum(pairs) / 9) < 1e-12


def test_folds_are_stratified_and_need_two_classes(spark):
    rows = spark.createDataFrame([(k, 1 + (k % 4 == 0)) for k in range(40)], "key int, class int")
    counts = learn.assign_folds(rows, "key", "class", 5).groupBy("fold", "class").count().collect()
    assert {r["count"] for r in counts if r["class"] == 2} == {2} and {r["count"] for r in counts if r["class"] == 1} == {6}
    with pytest.raises(ValueError):
        learn.labeled_set(rows.withColumn("class", F.lit(1)))


# order and scalars ---------------------------------------------------------------------


def test_natural_order(spark):
    names = ["img10", "img9", "IMG1", "img010b", "a2"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.name for r in df.orderBy(ordering.natural_key(F.col("name"))).collect()] == ["a2", "IMG1", "img9", "img10", "img010b"]


def test_runs_and_axis(spark):
    df = spark.createDataFrame([(k,) for k in (3, 4, 5, 9, 9, 10)], "i int")
    assert sorted((r.start, r.stop, r.n) for r in ordering.runs(df, "i").collect()) == [(3, 5, 3), (9, 10, 2)]
    assert [r.position for r in ordering.compressed_axis(df, "i", gap=2).orderBy("i").collect()] == [0, 1, 2, 5, 6]


def test_parsers_are_tolerant(spark):
    df = spark.createDataFrame([("1:5",), ("5:1",), ("x",), (None,)], "t string")
    assert [r.r for r in df.select(scalars.parse_range(F.col("t")).alias("r")).collect()][1:] == [None, None, None]
    assert scalars.channel_name("hessian", 2.0, 1, "smooth", "largest") == "smooth_hessian_largest_s2_c1"


# plans and files ------------------------------------------------------------------------


def test_schema_order_is_fixed():
    s = spec.schema_2d([spec.Channel("base", "v", ("mean", "std"), bins=2), spec.Channel("g", "g", ("min",))], relevance=True, extremum=True)
    assert s.names == [
        "feature_id", "area", "bbox_w", "bbox_h", "min_x", "max_x", "min_y", "max_y", "mean_base", "std_base", "relevance_base", "min_g",
        "ext_x", "ext_y", "ext_base", "ext_g", "hist00_base", "hist01_base",
    ]
    assert spec.split_field("std_base", s) == ("base", "std") and spec.split_field("area", s) is None
    assert spec.expand([spec.Request("hessian", (1.0, 2.0), (0,))], planes=1)[-1] == "hessian_smallest_s2_c0"
    with pytest.raises(ValueError):
        spec.expand([spec.Request("blur", (1.0, 1.0))])


def test_chain_plans():
    blur, pick = spec.Stage("blur"), spec.Stage("pick", "planes", "scalar")
    assert spec.plan_chain([blur], 3) == [("luminance", "convert"), ("blur", "scalar")]
    assert spec.plan_chain([blur], 3, "end") == [("blur", "lifted"), ("luminance", "convert")]
    assert spec.plan_chain([blur, pick, blur], 3) == [("blur", "lifted"), ("pick", "planes"), ("blur", "scalar")]
    with pytest.raises(ValueError):
        spec.plan_chain([blur], 3, "none")
    with pytest.raises(ValueError):
        spec.plan_chain([pick, pick], 3)


def test_workflow_refuses_what_it_does_not_know():
    assert "segment basin" in workflow.explain(workflow.parse({}))
    for bad in ({"filters": [{"op": "sharpen"}]}, {"segmentation": "magic"}, {"queries": [{"field": "nothing", "op": "ge", "value": 1}]}, {"connectivity": 7}):
        with pytest.raises(ValueError):
            workflow.parse(bad)


@pytest.mark.parametrize("kind", ["u1", "i4", "f4"])
def test_tiff_round_trip(kind):
    planes_ = np.arange(24).reshape(2, 3, 4).astype(kind)
    assert np.array_equal(tiff.decode(tiff.encode(planes_)), planes_.astype(np.float32))
    with pytest.raises(ValueError):
        tiff.decode(b"nothing")


def test_tiff_and_raw_readers(spark, tmp_path):
    rgba = np.arange(48, dtype="u1").reshape(4, 3, 4)
    (tmp_path / "a.tif").write_bytes(tiff.encode(rgba))
    got = tiff.read_planes(spark, str(tmp_path)).collect()
    assert len(got) == 12 and all(len(r.planes) == 3 for r in got)
    with pytest.raises(Exception, match="several samples"):
        tiff.read_single(spark, str(tmp_path)).collect()
    (tmp_path / "v_4x3x2.raw").write_bytes(np.arange(24, dtype="<f4").tobytes())
    vol = {(r.z, r.y, r.x): r.v for r in raw.read_volumes(spark, str(tmp_path)).collect()}
    assert len(vol) == 24 and vol[1, 2, 3] == 23.0
    (tmp_path / "s_4x3x9.raw").write_bytes(b"short")
    with pytest.raises(Exception, match="too short"):
        raw.read_volumes(spark, str(tmp_path)).collect()


def test_shards_are_written_once(spark, tmp_path):
    rows = spark.range(10).selectExpr("'s' AS slide", "cast(id % 2 AS int) AS tile", "1 AS factor", "id")
    for _ in range(2):
        files.write_shards(rows, str(tmp_path / "x"))
    assert files.read_shards(spark, str(tmp_path / "x")).count() == 10
    assert files.read_shards(spark, str(tmp_path / "x"), budget=5).count() == 5


def test_a_shard_of_all_rows_is_written_by_several_tasks(spark, tmp_path):
    """One key holds nearly all rows; a job that is run again may not send them to one task."""
    rows = spark.range(200_000).select(F.when(F.col("id") < 5, "a").otherwise("b").alias("slide"), F.lit(0).alias("tile"), F.lit(1).alias("factor"), F.rand(1).alias("v"))
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}
    before = {k: spark.conf.get(k, None) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        files.write_shards(rows.filter("slide = 'a'"), str(tmp_path / "x"))
        files.write_shards(rows, str(tmp_path / "x"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {r.slide: r["count"] for r in files.read_shards(spark, str(tmp_path / "x")).groupBy("slide").count().collect()} == {"a": 5, "b": 199_995}
    assert len(list((tmp_path / "x" / "slide=b").rglob("*.parquet"))) > 1


def test_planes_follow_their_rules(spark):
    df = spark.createDataFrame([([3.0, 4.0, 5.0],)], "p array<double>")
    r = df.select(planes.reduce_planes(F.col("p"), "mean", [2, 0, 0]).alias("m"), planes.hsv(F.lit(0.0), F.lit(0.0), F.lit(0.0), "saturation").alias("s"), planes.two_point(F.lit(5.0), F.lit(2.0), F.lit(2.0)).alias("t")).first()
    assert (r.m, r.s, r.t) == (2.0, 0.0, 5.0)
    assert np.allclose(np.linalg.norm(planes.stain_matrix("he"), axis=1), 1)


def test_formats_match_their_sql_beyond_a_megabyte(spark, tmp_path):
    import duckdb

    from gridloom.queries import oracle_sql, queries

    keys = [0, 1, 1023, 1024, 1075, 1076, 1280, 1792, 1024**2 - 1, 1024**2, 1024**2 + 768, 8_999_999, 600_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(oracle_sql()["scl23_formats"]).fetchall()
    assert sorted(map(tuple, queries()["scl23_formats"](spark, str(tmp_path)).collect())) == sorted(want)
    whole = spark.createDataFrame([(1024**2,), (3 * 1024**3,)], "n long").select(scalars.human_bytes(F.col("n")).alias("s"))
    assert [r.s for r in whole.collect()] == ["1.0 MB", "3.0 GB"]


def test_command_line_runs_a_workflow(spark, tmp_path):
    import json

    from gridloom.__main__ import main

    pixels(spark, [random_grid(1, 6, 6), random_grid(2, 6, 6)]).write.parquet(str(tmp_path / "px"))
    (tmp_path / "w.json").write_text(json.dumps({"segmentation": "null", "queries": [{"field": "area", "op": "ge", "value": 1}]}))
    args = ["--config", str(tmp_path / "w.json"), "--input", str(tmp_path / "px"), "--output", str(tmp_path / "out")]
    assert main([*args, "--dry-run"]) == 0 and not (tmp_path / "out").exists()
    assert main(args) == 0
    got = spark.read.option("header", True).csv(str(tmp_path / "out/features")).collect()
    assert sum(int(r.voxel_count) for r in got) == 72
    assert spark.read.option("header", True).csv(str(tmp_path / "out/timing")).count() == 3


def test_global_rank_follows_the_order(spark):
    from gridloom.plans.ranking import global_rank

    df = spark.range(200).selectExpr("(id * 37) % 200 AS k").repartition(7)
    assert all(r.rank == r.k + 1 for r in global_rank(df, "k").collect())
    assert global_rank(df.limit(0), "k").count() == 0


def test_run_components_match_cells(spark):
    for seed in range(3):
        grid = [[1 if v > 12 else None for v in r] for r in random_grid(seed + 70, 10, 10)]
        cells = {(y, x) for y, r in enumerate(grid) for x, v in enumerate(r) if v}
        for connectivity in (4, 8):
            near = (lambda a, b: abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1) if connectivity == 4 else (lambda a, b: max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1)
            want = twin_components([(a, b) for a in cells for b in cells if near(a, b)], cells)
            order = {root: k + 1 for k, root in enumerate(sorted(set(want.values())))}
            got = {(r.y, r.x): r.component for r in raster.label_components(pixels(spark, [grid]), "z", connectivity).collect()}
            assert got == {c: order[want[c]] for c in cells}


def test_context_names_and_order(spark):
    from gridloom.operators import context

    t = spark.createDataFrame([(0, k, 1, float(k), 2.0) for k in range(4)], "z int, label int, area int, mean_a double, ext_b double")
    arcs = spark.createDataFrame([(0, 0, 1, 2), (0, 1, 2, 1)], "z int, a int, b int, length int")
    out = context.augment(t, arcs, ["ring_mean", "slice_mean"], how=("uniform", "area"), sources=["mean_a"])
    assert out.columns[5:] == ["ring_mean__mean_a", "ring_mean[area]__mean_a", "slice_mean__mean_a", "slice_mean[area]__mean_a"]
    assert context.augment(t, arcs, []) is t and context.sources_of(t, "ext") == ["ext_b"]
    with pytest.raises(ValueError):
        context.augment(t, arcs, ["nonsense"])


def test_ranks_and_minima_within_hot_groups(spark):
    from gridloom.plans.ranking import least_before, rank_within

    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), k, rng.randrange(1000)) for k in range(600)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    ranked = {(r.g, r.k): r.rank for r in rank_within(df, ["g"], ["k"]).collect()}
    least = {(r.g, r.k): r.least for r in least_before(df, ["g"], ["k"], "v").collect()}
    for g in ("hot", "a", None):
        own = sorted((k, v) for h, k, v in rows if h == g)
        for at, (k, _) in enumerate(own):
            assert ranked[g, k] == at + 1 and least[g, k] == min((v for _, v in own[:at]), default=None)


@pytest.mark.parametrize("seed", [1, 2])
def test_contraction_gives_the_merge_order(spark, seed):
    """Random graphs with many ties, a star, a long path of falling minima and a lone basin, no item in one task."""
    rng = random.Random(seed)
    nodes, arcs = [], []
    for z in range(4):
        n = rng.randrange(20, 60)
        nodes += [(z, k, float(rng.randrange(15))) for k in range(n)]
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(n * 2)}
        arcs += [(z, a, b, float(rng.randrange(10, 30))) for a, b in pairs]
    nodes += [(4, k, float(100 - k)) for k in range(40)] + [(5, k, float(k)) for k in range(40)] + [(6, 0, 1.0)]
    arcs += [(4, k, k + 1, float(200 + k)) for k in range(39)] + [(5, 0, k, float(300 - k)) for k in range(1, 40)]
    table = spark.createDataFrame(nodes, "z int, basin long, low double")
    edges = spark.createDataFrame(arcs, "z int, a long, b long, saddle double")
    want = set()
    for z in range(7):
        order = topology.merge_order([(k, v) for i, k, v in nodes if i == z], [(w, a, b) for i, a, b, w in arcs if i == z])
        ended = {r[0]: r for r in order}
        want |= {(z, k, *ended.get(k, (k, None, None, None))[1:]) for i, k, _ in nodes if i == z}
    for small in (0, 50, 10**6):
        assert {tuple(r) for r in topology.persistence(table, edges, small=small).collect()} == want
    assert topology.persistence(table, edges.limit(0), small=0).filter("into IS NOT NULL").count() == 0


def plain_mixture(x, k, start, rounds=200):
    """Expectation and maximisation over single values, in plain Python."""
    w, mu, var = [1 / k] * k, list(start), [1.0] * k
    for _ in range(rounds):
        share = []
        for v in x:
            p = [w[c] * math.exp(-((v - mu[c]) ** 2) / (2 * var[c])) / math.sqrt(2 * math.pi * var[c]) for c in range(k)]
            share.append([q / sum(p) for q in p])
        mass = [sum(s[c] for s in share) for c in range(k)]
        w = [m / len(x) for m in mass]
        mu = [sum(s[c] * v for s, v in zip(share, x)) / mass[c] for c in range(k)]
        var = [sum(s[c] * (v - mu[c]) ** 2 for s, v in zip(share, x)) / mass[c] + 1e-6 for c in range(k)]
    return w, mu, [math.sqrt(v) for v in var]


def test_mixture_over_bins_equals_that_over_values(spark):
    rng = random.Random(6)
    groups = {"two": (2, [(-5.0, 1.0, 150), (4.0, 2.0, 250)]), "three": (3, [(0.0, 1.0, 120), (20.0, 1.5, 120), (50.0, 2.0, 60)])}
    for name, (k, parts) in groups.items():
        x = [rng.gauss(m, s) + 1e6 * (name == "three") for m, s, n in parts for _ in range(n)]
        w, mu, sd = plain_mixture(x, k, [m + 1e6 * (name == "three") for m, _, _ in parts])
        df = spark.createDataFrame([(name, v) for v in x] + [(None, 7.0), (None, 7.0), ("void", float("nan")), ("void", None)], "g string, v double")
        got = {r.g: r for r in measure.gmm(df, "v", ["g"], trim=0.0, k=k, rounds=500, tol=1e-10).collect()}
        assert set(got) == {name, None} and got[None].n == 2 and abs(got[None].mu_1 - 7) < 1e-9
        for c in range(k):
            for have, want in ((got[name][f"w_{c + 1}"], w[c]), (got[name][f"mu_{c + 1}"], mu[c]), (got[name][f"sd_{c + 1}"], sd[c])):
                assert abs(have - want) <= 2e-3 * max(1, abs(want) % 1e6), (name, c)
        again = measure.gmm(df.repartition(5), "v", ["g"], trim=0.0, k=k, rounds=500, tol=1e-10)
        assert [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in again.filter("g IS NOT NULL").collect()] == [tuple(round(v, 6) if isinstance(v, float) else v for v in got[name])]


@pytest.mark.parametrize("seed", [3, 4])
def test_rounds_choose_what_the_sequence_does(spark, seed):
    rng = random.Random(seed)
    rows = [(z, k, r, float(rng.randrange(20)), float(rng.randrange(20))) for z in range(3) for k, r in enumerate(rng.sample(range(1000), 80))]
    df = spark.createDataFrame(rows, "z int, label int, rank int, ext_y double, ext_x double")
    want = set()
    for z in range(3):
        taken = []
        for _, k, _, y, x in sorted((r for r in rows if r[0] == z), key=lambda r: r[2]):
            if len(taken) < 9 and all((y - b) ** 2 + (x - a) ** 2 >= 16 for _, b, a in taken):
                taken.append((k, y, x))
        want |= {(z, k, n) for n, (k, _, _) in enumerate(taken, 1)}
    for small in (0, 1000):
        assert {tuple(r) for r in ordering.spaced(df, 4.0, 9, small=small).collect()} == want
    assert ordering.spaced(df.limit(0), 4.0, 9, small=0).count() == 0
