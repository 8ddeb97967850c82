"""Round trips through files, the table functions, and the remaining listings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gridloom import views
from gridloom.catalog import query, rounded
from gridloom.functions import udtfs
from gridloom.operators import gestures, measure
from gridloom.plans.durable import fresh_path
from gridloom.sources import codecs, files, raw, tiff
from gridloom.views import sql, table


@query("src02_name_predicate", "SELECT p_partkey, p_brand LIKE '%1%' AS holds, regexp_matches(p_brand, '#[12]') AS matches, true AS always FROM part")
def src02(spark, d):
    name = F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", files.name_matches(name, "1").alias("holds"), files.name_matches(name, "#[12]", regex=True).alias("matches"), files.name_matches(name).alias("always"))


def _tiffs(spark, d, value, kind, **layout):
    folder = fresh_path(spark, "tiff")
    encoded = tiff.encode_slices(views.px(spark, d).withColumn("opaque", F.lit(255)), value, kind, 32, 32, **layout)
    files.write_binaries(encoded.select(F.format_string("s_%02d.tif", "z").alias("name"), "content"), folder)
    return folder


@query("src03_single_plane_tiff", sql("SELECT z, y, x, v FROM px"))
def src03(spark, d):
    """Tiles that don't divide the slice, deflated."""
    got = tiff.read_single(spark, _tiffs(spark, d, "v", "f4", tile=(16, 48), compression=codecs.DEFLATE))
    return got.select("z", "y", "x", F.col("v").cast("double").alias("v"))


@query("src03_tiff_box", sql("SELECT z, y, x, v FROM px WHERE z >= 2 AND z < 5 AND y >= 7 AND y < 21 AND x >= 18"))
def src03_box(spark, d):
    """A box reads the tiles that it meets."""
    folder = _tiffs(spark, d, "v", "i4", tile=(16, 16), compression=codecs.LZW, predictor=2)
    got = tiff.read_single(spark, folder, {"z": (2, 5), "y": (7, 21), "x": (18, 32)})
    return got.select("z", "y", "x", F.col("v").cast("double").alias("v"))


@query("src04_tiff_planes", sql("SELECT z, y, x, 3 AS n_planes, v AS first, g AS second, b AS third FROM px"))
def src04(spark, d):
    """Colour and alpha, chunky and tiled; alpha goes."""
    got = tiff.read_planes(spark, _tiffs(spark, d, ["v", "g", "b", "opaque"], "i4", tile=(16, 16), compression=codecs.LZW, predictor=2, planar=False))
    plane = lambda k: F.get("planes", F.lit(k)).cast("double")
    return got.select("z", "y", "x", F.size("planes").alias("n_planes"), plane(0).alias("first"), plane(1).alias("second"), plane(2).alias("third"))


@query("src05_raw_volume", sql("SELECT z, y, x, v FROM px"))
def src05(spark, d):
    """A volume of one slice a file, so that no group holds more than a slice."""
    folder = fresh_path(spark, "raw")
    slices = raw.encode_slices(views.px(spark, d), "v", 32, 32, kind="<f4")
    files.write_binaries(slices.select(F.format_string("%02d_32x32x1.raw", "z").alias("name"), "content"), folder)
    return raw.read_volumes(spark, folder).select(F.regexp_extract("path", r"(\d+)_32x32x1", 1).cast("int").alias("z"), "y", "x", F.col("v").cast("double").alias("v"))


@query("src07_volume_channels", sql("SELECT z, y, x, greatest(v, g, b) AS reduced, 0.25 AS sx, 0.25 AS sy, 1.5 AS sz FROM px"))
def src07(spark, d):
    """Colour slices as a volume of their largest sample, with the spacing that the tags tell."""
    folder = _tiffs(spark, d, ["v", "g", "b"], "i4", compression=codecs.PACKBITS, resolution=(4, 1), description="ImageJ=1.0\nspacing=1.5\n")
    volume = tiff.load_volume(spark, folder, "max").join(tiff.read_spacing(spark, folder), "path")
    return volume.select("z", "y", "x", F.col("v").cast("double").alias("reduced"), "sx", "sy", "sz")


@query("src08_stack_slices", sql("SELECT z, count(*) AS cells FROM px GROUP BY z"))
def src08(spark, d):
    return tiff.read_single(spark, _tiffs(spark, d, "n", "i4")).groupBy("z").agg(F.count("*").alias("cells"))


@query("src10_level_labels", sql("SELECT DISTINCT z, (y // 4)::INT AS y, (x // 4)::INT AS x, label FROM blocks"))
def src10(spark, d):
    return views.blocks(spark, d).select("z", F.expr("cast(y div 4 AS int)").alias("y"), F.expr("cast(x div 4 AS int)").alias("x"), "label").distinct()


@query("snk05_global_table_csv", sql("SELECT label::VARCHAR AS global_id, count(*)::VARCHAR AS voxel_count FROM blocks GROUP BY label"))
def snk05(spark, d):
    path = fresh_path(spark, "global")
    files.write_table(views.blocks(spark, d).groupBy(F.col("label").alias("global_id")).agg(F.count("*").alias("voxel_count")), path)
    return spark.read.option("header", True).csv(path)


@query("snk07_timing_report", "SELECT event_type AS step, count(*) AS n FROM events GROUP BY 1")
def snk07(spark, d):
    path = fresh_path(spark, "timing")
    table(spark, d, "events").groupBy(F.col("event_type").alias("step")).agg(F.count("*").alias("n")).write.json(path)
    return spark.read.schema("step string, n long").json(path)


@query("snk13_resumed_shards", "SELECT l_returnflag AS slide, count(*) AS n FROM lineitem GROUP BY 1")
def snk13(spark, d):
    path = fresh_path(spark, "resumed")
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("slide"), F.lit(0).alias("tile"), F.lit(1).alias("factor"), "l_orderkey")
    files.write_shards(rows.filter("slide = 'A'"), path)  # a job that stopped half way
    files.write_shards(rows, path)
    return files.read_shards(spark, path).groupBy("slide").agg(F.count("*").alias("n"))


@query("scl12_polygon_fill", sql("SELECT z, y, x FROM px WHERE y >= 5 AND y < 20 AND x < 25 AND x >= 4"))
def scl12(spark, d):
    box = F.expr("array(named_struct('x', 3.5, 'y', 4.5), named_struct('x', 24.5, 'y', 4.5), named_struct('x', 24.5, 'y', 19.5), named_struct('x', 3.5, 'y', 19.5))")
    return views.px(spark, d).filter(gestures.in_polygon(F.col("y"), F.col("x"), box)).select("z", "y", "x")


@query("win09_two_strongest", None)
def win09(spark, d):
    return rounded(measure.two_peaks(table(spark, d, "events"), "value", ["event_type"], bins=48, smooth=3, radius=2, apart=6), digits=4)


@query("win17_in_order", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events")
def win17(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("position"))


@query("udf03_protocols", "SELECT * FROM (VALUES ('catalogue', 'items'), ('images', 'read_region'), ('labels', 'label_at'), ('records', 'record')) t(protocol, method)")
def udf03(spark, d):
    from gridloom.plans.protocols import PROTOCOLS

    return spark.createDataFrame(sorted(PROTOCOLS.items()), "protocol string, method string")


@query("udf07_dry_run", "SELECT * FROM (VALUES (0, 'segment null'), (1, 'keep area ge 5'), (2, 'link 26'), (3, 'global table')) t(i, step)")
def udf07(spark, d):
    from gridloom.plans import workflow

    plan = workflow.parse(json.loads('{"segmentation": "null", "connectivity": 26, "queries": [{"field": "area", "op": "ge", "value": 5}]}'))
    return spark.createDataFrame(list(enumerate(workflow.explain(plan))), "i int, step string")


@query("udf09_regions_of_image", sql("SELECT z, label, count(*) AS area, sum(v) AS total FROM blocks GROUP BY z, label"))
def udf09(spark, d):
    """One image in, many region rows out, as a table function."""
    rows = views.blocks(spark, d).groupBy("z").agg(F.collect_list(F.struct("label", "v")).alias("cells"))
    rows.createOrReplaceTempView("udf09_images")
    spark.udtf.register("image_regions", udtfs.image_regions())
    return spark.sql("SELECT i.z, r.label, r.area, r.total FROM udf09_images i, LATERAL image_regions(i.cells) r")
