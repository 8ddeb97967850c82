"""The remaining operators: registries, cards, lookups, context, seams' models, sinks."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom import views
from gridloom.catalog import query, rounded
from gridloom.catalog.graphs import LINK6, MASK
from gridloom.functions import scalars
from gridloom.operators import context, gestures, graph, learn, linking, measure, predicate, raster, seams, stats, topology
from gridloom.operators.predicate import PixelRule, Query
from gridloom.plans import cards, spec, workflow
from gridloom.plans.durable import durable, fresh_path
from gridloom.sources import files, tiff
from gridloom.views import sql, table


def _regions(spark, d):
    return views.blocks(spark, d).groupBy("z", "label").agg(F.count("*").alias("area"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.max("v").alias("hi"), F.min("y").alias("ext_y"), F.min("x").alias("ext_x"))


@query("prj03_schema_fields", "SELECT * FROM (VALUES (0, 'mean_base', 'base', 'mean'), (1, 'std_base', 'base', 'std'), (2, 'min_green', 'green', 'min'), (3, 'hist00_green', 'green', 'hist00'), (4, 'hist01_green', 'green', 'hist01')) t(i, name, channel, reduction)")
def prj03(spark, d):
    s = spec.schema_2d([spec.Channel("base", "v", ("mean", "std")), spec.Channel("green", "g", ("min",), bins=2)])
    named = [f for f in s.fields if spec.split_field(f.name, s)]
    return spark.createDataFrame([(k, f.name, *spec.split_field(f.name, s)) for k, f in enumerate(named)], "i int, name string, channel string, reduction string")


@query("prj22_slide_coordinates", sql("SELECT z, label, min(x) * 2.0 + 10 AS min_x, max(x) * 2.0 + 10 AS max_x, min(y) * 2.0 + 20 AS min_y, max(y) * 2.0 + 20 AS max_y, count(*) AS area FROM blocks GROUP BY z, label"))
def prj22(spark, d):
    from gridloom.operators.planes import placed

    t = views.blocks(spark, d).groupBy("z", "label").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xy"], F.count("*").alias("area"))
    return t.select("z", "label", *[placed(F.col(f"{n}_{c}"), 10.0 if c == "x" else 20.0, 2.0).alias(f"{n}_{c}") for c in "xy" for n in ("min", "max")], "area")


@query("flt07_selection_mask", sql("SELECT p.z, p.y, p.x FROM blocks p JOIN regions r ON r.z = p.z AND r.label = p.label WHERE r.area >= 12 AND r.hi > 300"))
def flt07(spark, d):
    chosen = predicate.select_rows(_regions(spark, d), [Query("area", "ge", 12), Query("hi", "gt", 300)], strict=True)
    return views.blocks(spark, d).join(chosen.select("z", "label"), ["z", "label"], "left_semi").select("z", "y", "x")


@query("flt15_query_cards", sql("SELECT z, label FROM regions WHERE area >= 12 AND mean_v BETWEEN 180 AND 220"))
def flt15(spark, d):
    document = cards.queries_to_json([Query("area", "ge", 12), Query("m", "between", 180, 220)])
    return predicate.select_rows(_regions(spark, d), cards.queries_from_json(document), strict=True).select("z", "label")


@query("ras01_identity", sql("SELECT z, y, x, v AS out FROM px"))
def ras01(spark, d):
    return raster.FILTERS["none"](views.px(spark, d), "v").select("z", "y", "x", "out")


@query("ras13_chain_plan", "SELECT * FROM (VALUES (0, 'blur', 'lifted'), (1, 'pick', 'planes'), (2, 'blur', 'scalar')) t(i, op, how)")
def ras13(spark, d):
    blur = spec.Stage("blur")
    plan = spec.plan_chain([blur, spec.Stage("pick", "planes", "scalar"), blur], 3)
    return spark.createDataFrame([(k, *p) for k, p in enumerate(plan)], "i int, op string, how string")


@query("ras14_color_chain_plan", "SELECT * FROM (VALUES (0, 'luminance', 'convert'), (1, 'blur', 'scalar')) t(i, op, how)")
def ras14(spark, d):
    return spark.createDataFrame([(k, *p) for k, p in enumerate(spec.plan_chain([spec.Stage("blur")], 3))], "i int, op string, how string")


@query("ras17_named_source", sql("lo AS (SELECT p.z, p.y, p.x, any_value(p.label) AS label, max(q.v) AS hi FROM blocks p JOIN px q ON q.z = p.z AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY 1, 2, 3) SELECT z, label, round(avg(hi), 6) AS mean_dilated FROM lo GROUP BY z, label"))
def ras17(spark, d):
    source = raster.filter_chain(views.blocks(spark, d), "v", [("dilate", {"radius": 1})], "dilated")
    return rounded(source.groupBy("z", "label").agg(F.avg("dilated").alias("mean_dilated")))


@query("jn09_seam_flank_rows", sql("""f AS (SELECT z, a, b, length FROM arcs) SELECT f.z, f.a, f.b, x.area AS area_a, y.area AS area_b FROM f JOIN regions x ON x.z = f.z AND x.label = f.a JOIN regions y ON y.z = f.z AND y.label = f.b"""))
def jn09(spark, d):
    c = seams.cracks(views.blocks(spark, d), 32).select("z", "a", "b").distinct()
    return graph.attach(c, _regions(spark, d), ["area"]).select("z", "a", "b", "area_a", "area_b")


@query("jn11_minimum_pairs", sql("""two AS (SELECT z, saddle, a AS m FROM arcs UNION SELECT z, saddle, b FROM arcs) SELECT p.z, p.saddle, p.m AS lower, q.m AS upper FROM two p JOIN two q ON q.z = p.z AND q.saddle = p.saddle AND q.m > p.m """))
def jn11(spark, d):
    arcs = views.arcs(spark, d)
    two = arcs.select("z", "saddle", F.col("a").alias("m")).union(arcs.select("z", "saddle", "b")).distinct()
    return two.withColumnRenamed("m", "lower").join(two.withColumnRenamed("m", "upper"), ["z", "saddle"]).filter("upper > lower")


@query("jn10_saddle_minima", sql("""t AS (SELECT z, label, lo FROM regions) SELECT arcs.z, a, b, x.lo AS low_a, y.lo AS low_b FROM arcs JOIN t x ON x.z = arcs.z AND x.label = a JOIN t y ON y.z = arcs.z AND y.label = b WHERE saddle > greatest(x.lo, y.lo)"""))
def jn10(spark, d):
    t = views.blocks(spark, d).groupBy("z", "label").agg(F.min("v").alias("low"))
    return graph.attach(views.arcs(spark, d), t, ["low"]).filter("saddle > greatest(low_a, low_b)").select("z", "a", "b", "low_a", "low_b")


@query("jn14_boxed_gestures", sql("SELECT DISTINCT p.z, label, 1 AS uid, 2 AS class FROM lab p WHERE z = 2 AND y BETWEEN 3 AND 9 AND x BETWEEN 20 AND 25 AND label >= 0"))
def jn14(spark, d):
    g = spark.sql("SELECT 1 AS uid, 2 AS class, 2 AS z, 3 AS y0, 9 AS y1, 20 AS x0, 25 AS x1")
    near = views.lab(spark, d).filter("z = 2 AND y BETWEEN 3 AND 9 AND x BETWEEN 20 AND 25")  # the box of all gestures, pushed down
    return gestures.touched(gestures.box_cells(g), near)


@query("jn21_nearest_within", sql("""c AS (SELECT z, label, min(y) AS y, min(x) AS x FROM blocks GROUP BY z, label), q AS (SELECT z, y, x FROM px)
  SELECT z, y, x, label, d2 FROM (SELECT q.z, q.y, q.x, c.label, (q.y - c.y) * (q.y - c.y) + (q.x - c.x) * (q.x - c.x) AS d2, row_number() OVER (PARTITION BY q.z, q.y, q.x ORDER BY (q.y - c.y) * (q.y - c.y) + (q.x - c.x) * (q.x - c.x), c.label) AS r
  FROM q JOIN c ON c.z = q.z WHERE (q.y - c.y) * (q.y - c.y) + (q.x - c.x) * (q.x - c.x) <= 9) WHERE r = 1"""))
def jn21(spark, d):
    points = views.blocks(spark, d).groupBy("z", "label").agg(F.min("y").alias("py"), F.min("x").alias("px"))
    asked = views.px(spark, d).select("z", "y", "x")
    return graph.nearest_within(asked, points, 3)


@query("win05_preorder_numbers", sql("SELECT z, label, row_number() OVER (PARTITION BY z ORDER BY label // 8, label) AS region FROM regions"))
def win05(spark, d):
    paths = _regions(spark, d).withColumn("path", F.concat(F.lpad(F.expr("cast(label div 8 AS string)"), 4, "0"), F.lit("/"), F.lpad(F.col("label").cast("string"), 4, "0")))
    return paths.select("z", "label", F.row_number().over(Window.partitionBy("z").orderBy("path")).cast("long").alias("region"))


@query("win04_dense_rows", sql("SELECT label % 5 AS living, dense_rank() OVER (ORDER BY min(label)) - 1 AS row FROM regions GROUP BY label % 5"))
def win04(spark, d):
    from gridloom.operators.ordering import first_seen

    t = _regions(spark, d).select((F.col("label") % 5).alias("living"), "label")
    return first_seen(t, "living", "label", out="row").select("living", F.col("row").cast("long").alias("row")).distinct()


@query("win13_flood_rank", sql("SELECT z, label AS node, row_number() OVER (PARTITION BY z ORDER BY hi, label) AS rank FROM regions"))
def win13(spark, d):
    t = _regions(spark, d).select("z", F.col("label").alias("node"), F.col("hi").alias("cost"))
    return graph.flood_order(t).select("z", "node", F.col("rank").cast("long").alias("rank"))


@query("scl02_channel_names", "SELECT * FROM (VALUES (0, 'blur_s1.5'), (1, 'raw_hessian_largest_s2_c1'), (2, 'gradmag_s0.5_c0')) t(i, name)")
def scl02(spark, d):
    names = [scalars.channel_name("blur", 1.5), scalars.channel_name("hessian", 2.0, 1, "raw", "largest"), scalars.channel_name("gradmag", 0.5, 0)]
    return spark.createDataFrame(list(enumerate(names)), "i int, name string")


@query("scl21_class_colours", sql("SELECT z, label, CASE label % 5 WHEN 0 THEN '#000000' WHEN 1 THEN '#e6194b' WHEN 2 THEN '#3cb44b' WHEN 3 THEN '#4363d8' ELSE '#ffe119' END AS colour FROM regions"))
def scl21(spark, d):
    colours = F.create_map(*[F.lit(v) for pair in {0: "#000000", 1: "#e6194b", 2: "#3cb44b", 3: "#4363d8", 4: "#ffe119"}.items() for v in pair])
    return _regions(spark, d).select("z", "label", F.element_at(colours, F.expr("label % 5")).alias("colour"))


@query("scl22_display_window", sql("q AS (SELECT z, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM px GROUP BY z) SELECT z, y, x, round(least(greatest((v - lo) / (hi - lo), 0), 1), 6) AS shown FROM px JOIN q USING (z)"))
def scl22(spark, d):
    from gridloom.operators.planes import two_point

    p = views.px(spark, d)
    q = stats.slice_range(p, "v", 0.02)
    return rounded(p.join(q, "z").select("z", "y", "x", two_point(F.col("v"), F.col("floor"), F.col("ceiling"), clamp=True).alias("shown")))


@query("grf03_equal_sizes_only", sql("s AS (SELECT z, CASE WHEN z = 3 THEN 31 ELSE 32 END AS w FROM (SELECT DISTINCT z FROM px)) SELECT a.z, b.z AS next FROM s a JOIN s b ON b.z = a.z + 1 AND b.w = a.w"))
def grf03(spark, d):
    sizes = views.px(spark, d).select("z").distinct().withColumn("w", F.expr("CASE WHEN z = 3 THEN 31 ELSE 32 END"))
    return linking.linkable(sizes, ["w"])


@query("grf05_nodes_by_index", sql("SELECT z, label FROM regions WHERE label % 3 = 1"))
def grf05(spark, d):
    return _regions(spark, d).withColumn("index", F.expr("label % 3")).filter("index = 1").select("z", "label")


@query("grf09_arc_weights", sql("""t AS (SELECT z, label, mean_v AS m FROM regions) SELECT arcs.z, a, b, round(abs(x.m - y.m), 6) AS chain, saddle AS barrier, round(greatest(abs(x.m - s.m), abs(y.m - s.m)), 6) AS anchor
  FROM arcs JOIN t x ON x.z = arcs.z AND x.label = a JOIN t y ON y.z = arcs.z AND y.label = b JOIN t s ON s.z = arcs.z AND s.label = 27"""))
def grf09(spark, d):
    return rounded(graph.distance_weights(views.arcs(spark, d), _regions(spark, d), "m", 27).select("z", "a", "b", "chain", "barrier", "anchor"))


@query("grf10_pixel_adjacency", sql("SELECT DISTINCT z, a, b FROM touching"))
def grf10(spark, d):
    return graph.label_pairs(views.blocks(spark, d), "z", "label", "v").select("z", "a", "b").distinct()


@query("grf16_context_columns", sql("""two AS (SELECT z, a AS s, b AS t FROM arcs UNION ALL SELECT z, b, a FROM arcs), t AS (SELECT z, label, mean_v AS m FROM regions),
  r AS (SELECT o.z, o.label, avg(n.m) AS mu FROM t o JOIN two ON two.z = o.z AND two.s = o.label JOIN t n ON n.z = two.z AND n.label = two.t GROUP BY 1, 2)
  SELECT t.z, t.label, round(coalesce(mu, m), 6) AS "ring_mean__mean_v", round(m - avg(m) OVER (PARTITION BY t.z), 6) AS "slice_contrast__mean_v" FROM t LEFT JOIN r USING (z, label)"""))
def grf16(spark, d):
    t = _regions(spark, d).select("z", "label", "area", F.col("m").alias("mean_v"))
    out = context.augment(t, views.arcs(spark, d), ["ring_mean", "slice_contrast"], sources=["mean_v"])
    return rounded(out.select("z", "label", "ring_mean__mean_v", "slice_contrast__mean_v"))


@query("grf18_latent_head", None)
def grf18(spark, d):
    e = table(spark, d, "embeddings").select(F.lit(0).alias("z"), F.col("vec_id").alias("label"), F.col("embedding").cast("array<double>").alias("latent"), (F.col("label") > 4).cast("int").alias("y"))
    arcs = e.select("z", F.col("label").alias("a"), (F.col("label") + 1).alias("b"))
    ring = graph.latent_ring(e, arcs).select("z", "label", "ring_latent")
    # Sums of eight dimensions each, so that all 64 count in a model of sixteen features.
    block = lambda c, k: F.aggregate(F.slice(c, 8 * k + 1, 8), F.lit(0.0), lambda t, v: t + v)
    wide = e.join(ring, ["z", "label"]).select("label", "y", *[block("latent", k).alias(f"l{k}") for k in range(8)], *[block("ring_latent", k).alias(f"r{k}") for k in range(8)])
    # The fit reads it several times.
    wide = durable(wide, "latent-head")
    return learn.predict(learn.fit_classifier(wide, [f"{p}{k}" for p in "lr" for k in range(8)], "y"), wide, ["label"]).select("label", "predicted")


@query("grf30_strategies", "SELECT * FROM (VALUES ('basin'), ('null')) t(name)")
def grf30(spark, d):
    return spark.createDataFrame([(k,) for k in sorted(workflow.STRATEGIES)], "name string")


@query("mea08_fit_study", """WITH f AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1), s AS (SELECT event_type, k, avg(value) AS m FROM events, (VALUES (2), (4)) t(k) WHERE event_id % k = 0 GROUP BY 1, 2)
  SELECT k AS factor, count(*) AS n, round(avg(s.m - f.m), 4) AS mean_error, round(avg(abs(s.m - f.m)), 4) AS mae FROM s JOIN f USING (event_type) GROUP BY k""")
def mea08(spark, d):
    e = table(spark, d, "events")
    full = e.groupBy("event_type").agg(F.avg("value").alias("reference"))
    sub = e.withColumn("factor", F.explode(F.array(F.lit(2), F.lit(4)))).filter("event_id % factor = 0").groupBy("event_type", "factor").agg(F.avg("value").alias("m"))
    errors = sub.join(full, "event_type").withColumn("error", F.col("m") - F.col("reference"))
    return rounded(stats.error_summary(errors, ["factor"]).select("factor", "n", "mean_error", "mae"), digits=4)


@query("mod09_region_prediction", None)
def mod09(spark, d):
    rows = _regions(spark, d).withColumn("y", (F.col("hi") > 330).cast("int"))
    p = learn.predict(learn.fit_classifier(rows, ["area", "m", "s"], "y"), rows, ["z", "label"])
    return graph.vote(p.select("z", "label", "p"), views.arcs(spark, d).withColumn("p_diff", F.col("length") / 16.0), 2)


@query("mod11_seam_model", None)
def mod11(spark, d):
    described = seams.affinity(seams.seam_table(seams.seams(seams.cracks(views.blocks(spark, d), 32))), views.arcs(spark, d))
    rows = graph.attach(described, _regions(spark, d), ["m", "s"]).withColumn("dm", F.abs(F.col("m_a") - F.col("m_b"))).withColumn("y", (F.col("dm") > 25).cast("int"))
    rows = rows.withColumn("db", graph.bhattacharyya(F.col("m_a"), F.col("s_a"), F.col("m_b"), F.col("s_b"))).withColumn("len", F.col("length").cast("double"))
    return learn.predict(learn.fit_classifier(rows, ["db", "len", "affinity"], "y"), rows, ["z", "seam"]).select("z", "seam", "predicted")


@query("snk02_raster_tiff", sql("SELECT z, sum(label)::DOUBLE AS total FROM lab GROUP BY z"))
def snk02(spark, d):
    encoded = tiff.encode_slices(views.lab(spark, d), "label", "i4", 32, 32)
    total = F.udf(lambda raw: float(tiff.decode(bytes(raw)).sum()), "double")
    return encoded.select("z", total("content").alias("total"))


@query("snk04_feature_map_csv", sql("SELECT z::VARCHAR AS slice_index, count(*) AS n FROM (SELECT DISTINCT z, label FROM lab WHERE label >= 0) GROUP BY 1"))
def snk04(spark, d):
    path = fresh_path(spark, "map")
    files.write_table(views.lab(spark, d).filter("label >= 0").select(F.col("z").alias("slice_index"), F.col("label").alias("segment_id")).distinct(), path)
    return spark.read.option("header", True).csv(path).groupBy("slice_index").agg(F.count("*").alias("n"))


@query("snk06_raw_labels", sql("SELECT z, 4096::BIGINT AS bytes, sum(label * (y * 32 + x + 1))::BIGINT AS placed FROM lab GROUP BY z"))
def snk06(spark, d):
    """The labels are read back from the bytes and weighed with their places."""
    import numpy as np

    from gridloom.sources.raw import encode_slices

    def weigh(raw):
        labels = np.frombuffer(bytes(raw), "<i4").astype("i8")
        return int(labels @ np.arange(1, len(labels) + 1))

    return encode_slices(views.lab(spark, d), "label", 32, 32).select("z", F.length("content").cast("long").alias("bytes"), F.udf(weigh, "long")("content").alias("placed"))


@query("snk10_labeled_regions", sql("SELECT z, label, label % 5 AS class, area FROM regions WHERE label % 5 > 0"))
def snk10(spark, d):
    path = fresh_path(spark, "labeled")
    files.write_table(_regions(spark, d).withColumn("class", F.expr("label % 5")).filter("class > 0").select("z", "label", "class", "area"), path)
    return spark.read.schema("z int, label int, class int, area bigint").option("header", True).csv(path)


@query("snk11_training_pixels", sql("SELECT z, y, x, CASE WHEN label % 7 = 1 THEN 3 ELSE (v > 200)::INT END AS class FROM blocks"))
def snk11(spark, d):
    p = views.blocks(spark, d)
    annotated = p.select("z", "label").distinct().filter("label % 7 = 1").withColumn("annotated", F.lit(3))
    return p.join(annotated, ["z", "label"], "left").select("z", "y", "x", F.coalesce("annotated", (F.col("v") > 200).cast("int")).alias("class"))


@query("snk14_model_bundle", "SELECT 'a,b' AS names, true AS fits, false AS other_fits")
def snk14(spark, d):
    bundle = cards.bundle(["a", "b"], "regions")
    return spark.createDataFrame([(",".join(json.loads(bundle)["names"]), not cards.mismatch(bundle, ["b", "a"], "regions"), not cards.mismatch(bundle, ["a"], "regions"))], "names string, fits boolean, other_fits boolean")


@query("str05_snapshot_versions", "SELECT user_id, max(event_id) AS commit FROM events GROUP BY user_id")
def str05(spark, d):
    e = table(spark, d, "events")
    latest = e.groupBy("user_id").agg(F.max("event_id").alias("commit"))
    return e.select("user_id", F.col("event_id").alias("commit")).join(latest, ["user_id", "commit"], "left_semi")


@query("str06_append_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def str06(spark, d):
    from gridloom.streaming.ordered import append_batches

    source, out = fresh_path(spark, "stream"), fresh_path(spark, "appended")
    table(spark, d, "events").select("event_id", "event_type").repartition(3).write.parquet(source)
    stream = spark.readStream.schema("event_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(source)
    append_batches(stream, out, fresh_path(spark, "checkpoint")).awaitTermination()
    return spark.read.option("header", True).csv(f"{out}/batch=*").groupBy("event_type").agg(F.count("*").alias("n"))


@query("str02_incremental_linking", sql(f"{MASK}, {LINK6} SELECT DISTINCT z AS slice_index, component AS segment_id, global_id::INT AS global_id FROM linked"))
def str02(spark, d):
    """Slices arrive one file a trigger; ids are final once the last is in."""
    from gridloom.streaming.stateful import final_ids, link_stream, to_parquet

    path = fresh_path(spark, "slices")
    labelled = durable(linking.slice_components(views.mask(spark, d), 6).select(F.lit(0).cast("long").alias("volume"), "z", "y", "x", "component"), "slices")
    for z in range(7):
        labelled.filter(F.col("z") == z).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(labelled.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return final_ids(to_parquet(link_stream(stream, 6, tile=16), "linked")).drop("volume")


@query("udf01_filter_registry", "SELECT * FROM (VALUES ('blur'), ('close'), ('derivative'), ('dilate'), ('erode'), ('gradmag'), ('laplacian'), ('none'), ('open'), ('zero_crossings')) t(name)")
def udf01(spark, d):
    return spark.createDataFrame([(k,) for k in sorted(raster.FILTERS)], "name string")


@query("udf08_measures_in_sql", sql("SELECT z, round(quantile_cont(v, 0.5), 6) AS median_v, max(v) - min(v) AS range_v FROM px GROUP BY z"))
def udf08(spark, d):
    return rounded(stats.percentile_ladder(views.px(spark, d), "v", ["z"], (50,)).select("z", F.col("p50").alias("median_v"), (F.col("max") - F.col("min")).alias("range_v")))


@query("flt06_pixel_cards", sql("SELECT z, count(*) AS n FROM px WHERE v >= 150 GROUP BY z"))
def flt06_cards(spark, d):
    rules = cards.pixel_rules_from_json(cards.pixel_rules_to_json([PixelRule(Query("v", "ge", 150))]))
    return predicate.trim_pixels(views.px(spark, d), rules).groupBy("z").agg(F.count("*").alias("n"))


@query("mea02_quantile_start", sql("q AS (SELECT z, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM px GROUP BY z), t AS (SELECT px.z, v FROM px JOIN q ON q.z = px.z WHERE v BETWEEN lo AND hi) SELECT z, count(*) AS n, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75 FROM t GROUP BY z"))
def mea02(spark, d):
    kept = predicate.percentile_trim(views.px(spark, d), "v", 0.5, ["z"])
    return kept.groupBy("z").agg(F.count("*").alias("n"), F.percentile("v", F.lit(0.25)).alias("p25"), F.percentile("v", F.lit(0.75)).alias("p75"))


@query("grf29_volume_arcs", None)
def grf29_arcs(spark, d):
    from gridloom.operators import volume

    return volume.basin_arcs(volume.basins(views.px(spark, d).select("z", "y", "x", "v")))


@query("topology_threshold_percent", sql("SELECT round((max(v) - min(v)) * 0.1, 6) AS level FROM px"))
def threshold(spark, d):
    return spark.createDataFrame([(round(topology.threshold(views.px(spark, d), percent=10), 6),)], "level double")


@query("mea07_histogram_landmarks", None)
def mea07_histogram(spark, d):
    return rounded(measure.landmarks(views.px(spark, d), "v", ["z"], "histogram", (150, 250)), digits=4)
