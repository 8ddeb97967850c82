"""GRF, linking, topology and seams: components, neighbourhoods, floods, basins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import views
from gridloom.catalog import query, rounded
from gridloom.catalog.rasters import CC, EIGHT, FOUR
from gridloom.operators import graph, linking, raster, seams, stats, topology
from gridloom.plans.durable import durable
from gridloom.views import sql

MASK = CC.format(src="mask", near=FOUR)
LINK = """nodes AS (SELECT *, z * 10000 + component AS node FROM num),
  le AS (SELECT DISTINCT a.node AS a, b.node AS b FROM nodes a JOIN nodes b ON abs(b.z - a.z) = 1 AND {near}),
  lr(node, root) AS (SELECT DISTINCT node, node FROM nodes UNION SELECT le.b, r.root FROM lr r JOIN le ON le.a = r.node),
  lc AS (SELECT node, min(root) AS root FROM lr GROUP BY node),
  linked AS (SELECT nodes.*, dense_rank() OVER (ORDER BY root) AS global_id FROM nodes JOIN lc USING (node))"""
LINK6, LINK26 = LINK.format(near="b.y = a.y AND b.x = a.x"), LINK.format(near="abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1")


def _mask(spark, d):
    return views.mask(spark, d)


def _linked(spark, d, connectivity=6):
    return linking.assign_global(linking.slice_components(_mask(spark, d), connectivity), connectivity)


def entry_global_table(spark, d):
    """Slices to regions, selection, components, linking and the global feature table."""
    from gridloom.operators.predicate import Query, select_rows

    pixels = views.blocks(spark, d)
    table = pixels.groupBy("z", "label").agg(F.count("*").alias("area"), F.avg("v").alias("mean_base"))
    keep = select_rows(table, [Query("area", "ge", 4), Query("mean_base", "ge", 20.0)], strict=True).select("z", "label")
    chosen = pixels.filter("v % 2 <> 0").join(keep, ["z", "label"], "left_semi").select("z", "y", "x", "v")
    return rounded(linking.global_table(linking.assign_global(linking.slice_components(chosen, 6), 6)))


@query("grf01_components_4", sql(f"{MASK} SELECT z, y, x, component FROM num"))
def grf01(spark, d):
    return raster.label_components(_mask(spark, d), "z", 4)


@query("grf01_components_8", sql(f"{CC.format(src='mask', near=EIGHT)} SELECT z, y, x, component FROM num"))
def grf01_8(spark, d):
    return raster.label_components(_mask(spark, d), "z", 8)


@query("grf02_linked_features", sql(f"{MASK}, {LINK6} SELECT z, y, x, global_id::INT AS global_id FROM linked"))
def grf02(spark, d):
    return _linked(spark, d).select("z", "y", "x", "global_id")


@query("grf02_feature_map_26", sql(f"{CC.format(src='mask', near=EIGHT)}, {LINK26} SELECT DISTINCT z AS slice_index, component AS segment_id, global_id::INT AS global_id FROM linked"))
def grf02_map(spark, d):
    return linking.feature_map(_linked(spark, d, 26))


@query("agg11_component_nodes", sql(f"{MASK} SELECT num.z, component, count(*) AS area, sum(v) AS sum_base, min(v) AS min_base, max(v) AS max_base, max(num.x) - min(num.x) + 1 AS bbox_w, max(num.y) - min(num.y) + 1 AS bbox_h FROM num JOIN mask USING (z, y, x) GROUP BY num.z, component"))
def agg11(spark, d):
    return linking.component_nodes(linking.slice_components(_mask(spark, d), 6))


@query("agg13_global_features", sql(f"""{MASK}, {LINK6} SELECT global_id::INT AS global_id, count(*) AS voxel_count, count(DISTINCT linked.z) AS num_slices, min(linked.z) AS first_slice, max(linked.z) AS last_slice,
  min(linked.x) AS min_x, min(linked.y) AS min_y, min(linked.z) AS min_z, max(linked.x) AS max_x, max(linked.y) AS max_y, max(linked.z) AS max_z, round(avg(v), 6) AS mean_base, min(v) AS min_base, max(v) AS max_base, round(stddev_pop(v), 6) AS std_base,
  first(linked.x ORDER BY v DESC, node, linked.y, linked.x) AS ext_x, first(linked.y ORDER BY v DESC, node, linked.y, linked.x) AS ext_y, first(linked.z ORDER BY v DESC, node, linked.y, linked.x) AS ext_z, max(v) AS ext_base
  FROM linked JOIN mask USING (z, y, x) GROUP BY global_id"""))
def agg13(spark, d):
    return rounded(linking.global_table(_linked(spark, d)), "mean_base", "std_base")


@query("agg16_component_stats_3d", sql(f"{MASK}, {LINK6} SELECT global_id::INT AS global_id, count(*) AS pixel_count, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, median(v) AS median FROM linked JOIN mask USING (z, y, x) GROUP BY global_id"))
def agg16(spark, d):
    return rounded(stats.label_summary(_linked(spark, d), ["global_id"]), "mean")


@query("grf04_reachability", sql("""two AS (SELECT z, a AS s, b AS t FROM arcs WHERE saddle >= 150 UNION SELECT z, b, a FROM arcs WHERE saddle >= 150),
  r(z, node, hops) AS (SELECT z, 0, 0 FROM (SELECT DISTINCT z FROM px) UNION SELECT r.z, t, hops + 1 FROM r JOIN two ON two.z = r.z AND two.s = r.node WHERE hops < 70)
  SELECT z, node, min(hops)::INT AS hops FROM r GROUP BY z, node"""))
def grf04(spark, d):
    arcs = views.arcs(spark, d)
    seeds = arcs.select("z").distinct().withColumn("node", F.lit(0))
    return graph.reachable(arcs, seeds, 150)


@query("grf06_join_costs", sql("""two AS (SELECT z, a AS s, b AS t, saddle FROM arcs UNION ALL SELECT z, b, a, saddle FROM arcs),
  r(z, node, cost) AS (SELECT z, 27, -1.0::DOUBLE FROM (SELECT DISTINCT z FROM px) UNION SELECT r.z, t, greatest(cost, saddle) FROM r JOIN two ON two.z = r.z AND two.s = r.node)
  SELECT z, node, min(cost) AS cost FROM r GROUP BY z, node"""))
def grf06(spark, d):
    arcs = views.arcs(spark, d)
    seeds = arcs.select("z").distinct().withColumn("node", F.lit(27))
    return graph.join_costs(arcs, seeds).withColumn("cost", F.greatest("cost", F.lit(-1.0)))


@query("grf07_gain_flood", None)
def grf07(spark, d):
    arcs = views.arcs(spark, d)
    return rounded(graph.flood_order(graph.join_costs(arcs, arcs.select("z").distinct().withColumn("node", F.lit(27)), gain=1.01)))


def _ranked(spark, d):
    arcs = views.arcs(spark, d)
    return arcs, graph.flood_order(graph.join_costs(arcs, arcs.select("z").distinct().withColumn("node", F.lit(27))))


@query("grf08_first_ring", None)
def grf08(spark, d):
    arcs, ranked = _ranked(spark, d)
    return graph.first_ring(ranked, arcs, 5)


@query("win14_initial_rank", None)
def win14(spark, d):
    return graph.initial_rank(_ranked(spark, d)[1])


def _table(spark, d):
    return views.blocks(spark, d).groupBy("z", "label").agg(F.count("*").alias("area"), F.avg("v").alias("m")).withColumn("class", F.expr("cast(label % 5 AS int)"))


TWO = "two AS (SELECT z, a AS s, b AS t, length FROM arcs UNION ALL SELECT z, b, a, length FROM arcs), t AS (SELECT z, label, area, mean_v AS m, label % 5 AS class FROM regions)"


@query("grf11_arc_weights", sql(f"{TWO} SELECT two.z, s AS src, two.t AS dst, area::DOUBLE AS weight FROM two JOIN t ON t.z = two.z AND t.label = two.t"))
def grf11(spark, d):
    return graph.weighted(views.arcs(spark, d), _table(spark, d), "area").select("z", "src", "dst", "weight")


def _ring_sql(w: str) -> str:
    return sql(f"""{TWO}, r AS (SELECT two.z, s AS label, sum(w) AS w, sum(w * m) / sum(w) AS mu, sum(w * m * m) / sum(w) AS sq, min(m) AS lo, max(m) AS hi FROM (SELECT two.*, {w} AS w, n.m FROM two JOIN t n ON n.z = two.z AND n.label = two.t) two GROUP BY 1, 2)
  SELECT t.z, t.label, round(coalesce(mu, t.m), 6) AS ring_mean_m, round(coalesce(lo, t.m), 6) AS ring_min_m, round(coalesce(hi, t.m), 6) AS ring_max_m,
  round(coalesce(sqrt(greatest(sq - mu * mu, 0)), 0), 3) AS ring_std_m, round(t.m - coalesce(mu, t.m), 6) AS ring_contrast_m FROM t LEFT JOIN r ON r.z = t.z AND r.label = t.label""")


def _ring(spark, d, how):
    r = rounded(graph.ring(_table(spark, d), views.arcs(spark, d), ["m"], how))
    return r.select("z", "label", "ring_mean_m", "ring_min_m", "ring_max_m", F.round("ring_std_m", 3).alias("ring_std_m"), "ring_contrast_m")


@query("grf12_ring_uniform", _ring_sql("1"))
def grf12(spark, d):
    return _ring(spark, d, "uniform")


@query("grf12_ring_area", _ring_sql("n.area"))
def grf12_area(spark, d):
    return _ring(spark, d, "area")


@query("grf12_ring_contact", _ring_sql("two.length"))
def grf12_contact(spark, d):
    return _ring(spark, d, "contact")


@query("grf13_hop2", sql(f"""{TWO}, r AS (SELECT t.z, t.label, coalesce(avg(n.m), any_value(t.m)) AS mu FROM t LEFT JOIN two ON two.z = t.z AND two.s = t.label LEFT JOIN t n ON n.z = two.z AND n.label = two.t GROUP BY 1, 2)
  SELECT t.z, t.label, round(coalesce(avg(n.mu), any_value(o.mu)), 6) AS hop2_mean_m FROM t JOIN r o ON o.z = t.z AND o.label = t.label LEFT JOIN two ON two.z = t.z AND two.s = t.label LEFT JOIN r n ON n.z = two.z AND n.label = two.t GROUP BY 1, 2"""))
def grf13(spark, d):
    return rounded(graph.hop2(_table(spark, d), views.arcs(spark, d), ["m"]).select("z", "label", "hop2_mean_m"))


@query("grf14_slice_context", sql(f"{TWO} SELECT z, label, round(sum(m * area) OVER (PARTITION BY z) / sum(area) OVER (PARTITION BY z), 6) AS slice_mean_m, round(m - sum(m * area) OVER (PARTITION BY z) / sum(area) OVER (PARTITION BY z), 6) AS slice_contrast_m FROM t"))
def grf14(spark, d):
    return rounded(graph.slice_context(_table(spark, d), ["m"], area=True).select("z", "label", "slice_mean_m", "slice_contrast_m"))


@query("grf15_class_fractions", sql(f"""{TWO} SELECT t.z, t.label, round(coalesce(count(*) FILTER (n.class = 1) / nullif(count(n.class), 0), 0), 6) AS frac_c1, round(coalesce(count(*) FILTER (n.class = 2) / nullif(count(n.class), 0), 0), 6) AS frac_c2, round(coalesce(count(*) FILTER (n.class = 3) / nullif(count(n.class), 0), 0), 6) AS frac_c3, round(coalesce(count(*) FILTER (n.class = 4) / nullif(count(n.class), 0), 0), 6) AS frac_c4, round(coalesce(count(*) FILTER (n.class > 0) / nullif(count(n.class), 0), 0), 6) AS frac_any
  FROM t LEFT JOIN two ON two.z = t.z AND two.s = t.label LEFT JOIN t n ON n.z = two.z AND n.label = two.t GROUP BY 1, 2"""))
def grf15(spark, d):
    return rounded(graph.class_fractions(_table(spark, d), views.arcs(spark, d)).drop("area", "m", "class"))


def _latent(spark, d):
    e = views.table(spark, d, "embeddings").select(F.lit(0).alias("z"), F.col("vec_id").alias("label"), F.col("embedding").cast("array<double>").alias("latent"))
    ids = e.select("label")
    a1 = ids.select(F.lit(0).alias("z"), F.col("label").alias("a"), (F.col("label") + 1).alias("b"))
    a7 = ids.select(F.lit(0).alias("z"), F.col("label").alias("a"), (F.col("label") + 7).alias("b"))
    return e, a1.union(a7)


@query("grf17_latent_ring", None)
def grf17(spark, d):
    e, arcs = _latent(spark, d)
    got = graph.latent_ring(e, arcs)
    return rounded(got.select("z", "label", F.get("ring_latent", F.lit(0)).alias("first"), "ring_distance"))


@query("grf17_linkage_shape", None)
def grf17_shape(spark, d):
    return rounded(graph.neighbour_shapes(*_latent(spark, d)))


@query("grf19_random_walk", None)
def grf19(spark, d):
    arcs = views.arcs(spark, d)
    return graph.walk_ends(arcs, arcs.select("z", F.col("a").alias("node")).distinct(), 3, seed=5)


@query("grf20_vote", None)
def grf20(spark, d):
    p = views.blocks(spark, d).groupBy("z", "label").agg(F.array(F.count_if(F.col("v") < 190) / F.count("*"), F.count_if(F.col("v") >= 190) / F.count("*")).alias("p"))
    arcs = views.arcs(spark, d).withColumn("p_diff", F.col("length") / 16.0)
    return graph.vote(p, arcs, 2)


@query("grf20_vote_off", sql("""p AS (SELECT z, label, count(*) FILTER (v < 190) / count(*) AS p0 FROM blocks GROUP BY z, label) SELECT z, label, CASE WHEN p0 >= 0.5 THEN 0 ELSE 1 END AS class FROM p"""))
def grf20_off(spark, d):
    p = views.blocks(spark, d).groupBy("z", "label").agg(F.array(F.count_if(F.col("v") < 190) / F.count("*"), F.count_if(F.col("v") >= 190) / F.count("*")).alias("p"))
    return graph.vote(p, views.arcs(spark, d).withColumn("p_diff", F.lit(0.5)), 2, strength=0.0)


@query("grf37_boundary_score", sql("""two AS (SELECT z, a AS s, length FROM arcs UNION ALL SELECT z, b, length FROM arcs) SELECT r.z, r.label, round(coalesce(avg(two.length / 16.0), 0), 6) AS boundary FROM regions r LEFT JOIN two ON two.z = r.z AND two.s = r.label GROUP BY 1, 2"""))
def grf37(spark, d):
    arcs = views.arcs(spark, d).withColumn("p_diff", F.col("length") / 16.0)
    return rounded(graph.boundary_scores(_table(spark, d), arcs).select("z", "label", "boundary"))


@query("grf38_tile_grid", sql("""e AS (SELECT z, max(y) + 1 AS h, max(x) + 1 AS w FROM px GROUP BY z)
  SELECT z, (i * 10)::INT AS y0, least(i * 10 + 10, h)::INT AS y1, (j * 10)::INT AS x0, least(j * 10 + 10, w)::INT AS x1 FROM e, range(4) a(i), range(4) b(j) WHERE i * 10 < h AND j * 10 < w"""))
def grf38(spark, d):
    extents = views.px(spark, d).groupBy("z").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    return graph.tiles_of(extents, 10)


_DESCENT = """p AS (SELECT z, y, x, v, y * 1048576 + x AS id FROM px), near AS (SELECT a.z, a.id, b.id AS other, b.v FROM p a JOIN p b ON b.z = a.z AND abs(b.y - a.y) + abs(b.x - a.x) <= 1),
  ptr AS (SELECT z, id, first(other ORDER BY v, other) AS t FROM near GROUP BY z, id),
  walk(z, id, cur) AS (SELECT z, id, id FROM ptr UNION SELECT w.z, w.id, ptr.t FROM walk w JOIN ptr ON ptr.z = w.z AND ptr.id = w.cur),
  root AS (SELECT w.z, w.id, w.cur AS basin FROM walk w JOIN ptr ON ptr.z = w.z AND ptr.id = w.cur AND ptr.t = ptr.id),
  bl AS (SELECT p.*, basin FROM p JOIN root USING (z, id)),
  bt AS (SELECT z, basin, count(*) AS area, min(v) AS low, sum(v) AS sum_base FROM bl GROUP BY z, basin),
  bp AS (SELECT a.z, least(a.basin, b.basin) AS a, greatest(a.basin, b.basin) AS b, greatest(a.v, b.v) AS w FROM bl a JOIN bl b ON b.z = a.z AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) WHERE a.basin <> b.basin),
  ba AS (SELECT z, a, b, min(w) AS saddle, count(*) AS cnt FROM bp GROUP BY z, a, b)"""


@query("grf28_basins", sql(f"{_DESCENT} SELECT z, y, x, basin FROM bl"))
def grf28(spark, d):
    return topology.basins(views.px(spark, d).select("z", "y", "x", "v")).select("z", "y", "x", "basin")


@query("grf28_basin_table", sql(f"{_DESCENT} SELECT z, basin, area, low, sum_base FROM bt"))
def grf28_table(spark, d):
    return topology.basin_table(topology.basins(views.px(spark, d).select("z", "y", "x", "v")))


@query("grf28_basin_arcs", sql(f"{_DESCENT} SELECT z, a, b, saddle, cnt FROM ba"))
def grf28_arcs(spark, d):
    return topology.basin_arcs(topology.basins(views.px(spark, d).select("z", "y", "x", "v")))


#: Arc by arc in the order of the saddles: who stands for each basin, and where it ended.
_KRUSKAL = f"""{_DESCENT.replace(' bt AS (', ' bt AS MATERIALIZED (').replace(' ba AS (', ' ba AS MATERIALIZED (')},
  ar AS MATERIALIZED (SELECT z, a, b, saddle::DOUBLE AS saddle, row_number() OVER (PARTITION BY z ORDER BY saddle, a, b) AS r FROM ba),
  kr(z, node, r, rep, into_, height) AS MATERIALIZED (
    SELECT z, basin, 0::BIGINT, basin, NULL::BIGINT, NULL::DOUBLE FROM bt
    UNION ALL
    SELECT n.z, n.node, n.r + 1, CASE WHEN n.rep = m.young THEN m.old ELSE n.rep END, CASE WHEN n.node = m.young THEN m.old ELSE n.into_ END, CASE WHEN n.node = m.young THEN m.saddle ELSE n.height END
    FROM kr n JOIN (
      SELECT ar.z, saddle, CASE WHEN pa.rep = pb.rep THEN NULL WHEN row(la.low, la.basin) > row(lb.low, lb.basin) THEN pa.rep ELSE pb.rep END AS young,
             CASE WHEN row(la.low, la.basin) > row(lb.low, lb.basin) THEN pb.rep ELSE pa.rep END AS old
      FROM ar JOIN kr pa ON pa.z = ar.z AND pa.node = ar.a AND pa.r = ar.r - 1 JOIN kr pb ON pb.z = ar.z AND pb.node = ar.b AND pb.r = ar.r - 1
      JOIN bt la ON la.z = ar.z AND la.basin = pa.rep JOIN bt lb ON lb.z = ar.z AND lb.basin = pb.rep
    ) m ON m.z = n.z),
  dt AS MATERIALIZED (SELECT kr.z, node AS basin, into_ AS "into", height, height - low AS persistence, low, area, sum_base FROM kr JOIN (SELECT z, max(r) AS r FROM kr GROUP BY z) USING (z, r) JOIN bt ON bt.z = kr.z AND bt.basin = kr.node),
  al(z, basin, cur) AS (SELECT z, basin, basin FROM dt UNION SELECT al.z, al.basin, dt."into" FROM al JOIN dt ON dt.z = al.z AND dt.basin = al.cur AND dt.persistence < 60),
  living AS (SELECT al.z, al.basin, al.cur AS living FROM al JOIN dt ON dt.z = al.z AND dt.basin = al.cur WHERE dt.persistence IS NULL OR dt.persistence >= 60)"""


def _tree(spark, d, **how):
    labelled = durable(topology.basins(views.px(spark, d).select("z", "y", "x", "v")), "basins")
    table, arcs = topology.basin_table(labelled), topology.basin_arcs(labelled)
    return table, arcs, durable(topology.persistence(table, arcs, **how), "deaths")


@query("grf21_merge_tree", sql(f'{_KRUSKAL} SELECT z, basin, "into", height, persistence FROM dt'))
def grf21(spark, d):
    """By contraction over all tasks, no item in one of them."""
    return _tree(spark, d, small=0)[2]


@query("grf21_merge_heights", sql(f"{_KRUSKAL} SELECT z, count(height) AS n_merges, min(height) AS first_height, max(height) AS last_height, sum(persistence) AS total FROM dt GROUP BY z"))
def grf21_heights(spark, d):
    _, _, deaths = _tree(spark, d)
    return deaths.groupBy("z").agg(F.count("persistence").alias("n_merges"), F.min("height").alias("first_height"), F.max("height").alias("last_height"), F.sum("persistence").alias("total"))


@query("grf22_branch_survivors", sql(f"{_KRUSKAL} SELECT z, basin, row_number() OVER (PARTITION BY z ORDER BY basin) AS region FROM dt WHERE (persistence IS NULL OR persistence >= 20) AND low <= 200"))
def grf22(spark, d):
    table, _, deaths = _tree(spark, d)
    return topology.cut_tree(deaths, table, 20.0, 200.0).select("z", "basin", "region")


@query("grf23_persistence_sweep", sql(f"{_KRUSKAL} SELECT z, {', '.join(f'count(*) FILTER (persistence IS NULL OR persistence >= {t}) AS n_{k}' for k, t in enumerate((0, 10, 50, 100, 200)))} FROM dt GROUP BY z"))
def grf23(spark, d):
    return topology.sweep(_tree(spark, d)[2], [0, 10, 50, 100, 200])


def _absorbed(spark, d):
    table, arcs, deaths = _tree(spark, d)
    return topology.absorb(topology.cut_tree(deaths, table, 60.0, 1e9).select("z", F.col("basin").alias("node")), arcs)


@query("grf24_absorb", None)
def grf24(spark, d):
    return _absorbed(spark, d)


@query("grf24_absorb_costs", sql(f"""{_KRUSKAL}, seeds AS (SELECT z, basin AS node FROM dt WHERE persistence IS NULL OR persistence >= 60),
  level AS (SELECT z, saddle, max(r) AS r FROM ar GROUP BY z, saddle UNION ALL SELECT DISTINCT z, '-Infinity'::DOUBLE, 0 FROM bt),
  held AS (SELECT DISTINCT z, r, rep FROM kr JOIN seeds USING (z, node))
  SELECT kr.z, kr.node, min(saddle) AS cost FROM kr JOIN level USING (z, r) JOIN held USING (z, r, rep) GROUP BY kr.z, kr.node"""))
def grf24_costs(spark, d):
    return _absorbed(spark, d).select("z", "node", "cost")


@query("grf27_never_cancelled", sql(f"{_DESCENT} SELECT z, basin FROM (SELECT z, basin, row_number() OVER (PARTITION BY z ORDER BY low, basin) AS r FROM bt) WHERE r = 1"))
def grf27(spark, d):
    return _tree(spark, d)[2].filter("persistence IS NULL").select("z", "basin")


@query("agg12_roll_up", sql(f"{_KRUSKAL} SELECT z, living, sum(area)::BIGINT AS area, sum(sum_base) AS sum_base, min(low) AS low, count(*) AS n_base FROM dt JOIN living USING (z, basin) GROUP BY z, living"))
def agg12(spark, d):
    table, _, deaths = _tree(spark, d)
    return topology.roll_up(table, topology.living(deaths, 60.0))


@query("jn06_living_lut", sql(f"{_KRUSKAL} SELECT bl.z, y, x, living FROM bl JOIN living USING (z, basin)"))
def jn06(spark, d):
    """Every cell's living region, through the table of basins."""
    labelled = topology.basins(views.px(spark, d).select("z", "y", "x", "v"))
    lut = topology.living(topology.persistence(topology.basin_table(labelled), topology.basin_arcs(labelled)), 60.0)
    return labelled.join(lut, ["z", "basin"]).select("z", "y", "x", "living")


@query("scl20_tree_document", None)
def scl20(spark, d):
    table, _, deaths = _tree(spark, d)
    return topology.tree_document(deaths, table)


_CRACKS = """cr AS (SELECT p.z, 2 * (p.y * 33 + p.x + 1) + 1 AS crack, p.y * 33 + p.x + 1 AS c0, (p.y + 1) * 33 + p.x + 1 AS c1, least(p.label, q.label) AS a, greatest(p.label, q.label) AS b FROM lab p JOIN lab q ON q.z = p.z AND q.y = p.y AND q.x = p.x + 1 WHERE p.label <> q.label
  UNION ALL SELECT p.z, 2 * ((p.y + 1) * 33 + p.x), (p.y + 1) * 33 + p.x, (p.y + 1) * 33 + p.x + 1, least(p.label, q.label), greatest(p.label, q.label) FROM lab p JOIN lab q ON q.z = p.z AND q.x = p.x AND q.y = p.y + 1 WHERE p.label <> q.label),
  ends AS (SELECT z, c0 AS corner, a, b FROM cr UNION ALL SELECT z, c1, a, b FROM cr),
  cn AS (SELECT z, corner, count(*) AS degree, count(*) <> 2 OR count(DISTINCT a * 1000 + b) > 1 AS junction FROM ends GROUP BY z, corner),
  cl AS (SELECT DISTINCT x.z, x.crack AS s, y.crack AS t FROM (SELECT z, crack, unnest([c0, c1]) AS corner FROM cr) x JOIN (SELECT z, crack, unnest([c0, c1]) AS corner FROM cr) y ON y.z = x.z AND y.corner = x.corner JOIN cn ON cn.z = x.z AND cn.corner = x.corner AND NOT cn.junction),
  sr(z, crack, seam) AS (SELECT z, crack, crack FROM cr UNION SELECT sr.z, t, seam FROM sr JOIN cl ON cl.z = sr.z AND cl.s = sr.crack),
  sm AS (SELECT cr.*, seam FROM cr JOIN (SELECT z, crack, min(seam) AS seam FROM sr GROUP BY z, crack) m USING (z, crack))"""


@query("grf31_cracks", sql(f"{_CRACKS} SELECT z, crack::BIGINT AS crack, c0::BIGINT AS c0, c1::BIGINT AS c1, a, b FROM cr"))
def grf31(spark, d):
    return seams.cracks(views.lab(spark, d), 32)


@query("grf31_junctions", sql(f"{_CRACKS} SELECT z, corner::BIGINT AS corner, degree, junction FROM cn"))
def grf31_junctions(spark, d):
    return seams.corners(seams.cracks(views.lab(spark, d), 32))


@query("grf31_seams", sql(f"{_CRACKS} SELECT z, crack::BIGINT AS crack, seam::BIGINT AS seam FROM sm"))
def grf31_seams(spark, d):
    return seams.seams(seams.cracks(views.lab(spark, d), 32)).select("z", "crack", "seam")


def _seams(spark, d):
    return durable(seams.seams(seams.cracks(views.blocks(spark, d), 32)), "seams")


@query("grf32_junction_seams", None)
def grf32(spark, d):
    return seams.junction_seams(seams.seam_table(_seams(spark, d)))


@query("grf33_affinity_tolls", None)
def grf33(spark, d):
    return rounded(seams.tolls(seams.affinity(seams.seam_table(_seams(spark, d)), views.arcs(spark, d))))


@query("grf34_cheapest_paths", None)
def grf34(spark, d):
    t = seams.tolls(seams.affinity(seams.seam_table(_seams(spark, d)), views.arcs(spark, d)))
    seeds = t.filter("NOT closed").groupBy("z").agg(F.min("j0").alias("node"))
    return rounded(seams.cheapest_paths(t, seeds))


@query("grf34_livewire", None)
def grf34_livewire(spark, d):
    """In every slice a trace from one seam of its busiest junction to another, on to the dearest and the cheapest seam; one point is dropped."""
    t = durable(seams.tolls(seams.affinity(seams.seam_table(_seams(spark, d)), views.arcs(spark, d))), "tolls")
    busy = seams.junction_seams(t).groupBy("z").agg(F.max_by("seams", F.struct(F.size("seams"), "junction")).alias("s"))
    spots = t.groupBy("z").agg(F.max_by("seam", F.struct("toll", "seam")).alias("dear"), F.min_by("seam", F.struct("toll", "seam")).alias("cheap")).join(busy, "z")
    way = ((F.array_min("s"), 0), (F.array_max("s"), 1), (F.array_min("s"), 1), (F.lit(None).cast("long"), 0), (F.col("dear"), 1), (F.col("cheap"), 0))
    events = F.array(*[F.struct(F.lit(k).alias("ordinal"), seam.alias("seam"), F.lit(idx).alias("idx")) for k, (seam, idx) in enumerate(way)])
    return rounded(seams.livewire(spots.select("z", F.lit(0).alias("trace"), F.inline(events)), t))


@query("grf35_seam_gestures", None)
def grf35(spark, d):
    s = _seams(spark, d)
    scopes = spark.sql("SELECT * FROM VALUES (0, 1, 1, 0, 16, 0, 16), (0, 3, 2, 8, 32, 8, 32) t(z, uid, class, y0s, y1s, x0s, x1s)")
    scoped = seams.in_scope(seams.seam_boxes(s, 32), scopes)
    traces = s.filter("seam % 3 = 0").select("z", F.lit(2).alias("uid"), "crack")
    traced = seams.coverage(s, traces).withColumn("class", F.lit(2))
    return seams.resolve(scoped, traced)


@query("jn16_scope_containment", None)
def jn16(spark, d):
    scopes = spark.sql("SELECT * FROM VALUES (0, 1, 1, 0, 16, 0, 16), (1, 3, 2, 8, 32, 8, 32) t(z, uid, class, y0s, y1s, x0s, x1s)")
    return seams.in_scope(seams.seam_boxes(_seams(spark, d), 32), scopes)


@query("jn15_trace_coverage", None)
def jn15(spark, d):
    s = _seams(spark, d)
    return rounded(seams.coverage(s, s.filter("crack % 3 <> 0").select("z", F.lit(1).alias("uid"), "crack")))


@query("scl08_crack_ids", sql("SELECT z, y, x, (2 * (y * 33 + x))::BIGINT AS right_crack, (2 * (y * 33 + x) + 1)::BIGINT AS down_crack FROM px"))
def scl08(spark, d):
    corner = (F.col("y") * 33 + F.col("x")).cast("long")
    return views.px(spark, d).select("z", "y", "x", (corner * 2).alias("right_crack"), (corner * 2 + 1).alias("down_crack"))


@query("scl09_pair_keys", sql("SELECT z, a, b, (a * 64 + b)::BIGINT AS key FROM arcs"))
def scl09(spark, d):
    from gridloom.functions.scalars import pair_key

    return views.arcs(spark, d).select("z", "a", "b", pair_key(F.col("b"), F.col("a"), 64).alias("key"))
