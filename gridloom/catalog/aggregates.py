"""AGG and PRJ01-05: grouped statistics and feature projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import views
from gridloom.catalog import query, rounded
from gridloom.operators import stats
from gridloom.views import sql


@query("agg01_segment_table", sql("""SELECT z, label, count(*) AS area, min(v) AS min_value, max(v) AS max_value, round(avg(v), 6) AS mean_value,
  min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM lab GROUP BY z, label"""))
def agg01(spark, d):
    return rounded(stats.segment_table(views.lab(spark, d)), "mean_value")


@query("agg02_region_moments", sql("""SELECT z, label, count(*) AS area, sum(v) AS sum_v, sum(v * v) AS sumsq_v, min(v) AS min_v, max(v) AS max_v,
  sum(g) AS sum_g, sum(g * g) AS sumsq_g, min(g) AS min_g, max(g) AS max_g FROM lab WHERE label >= 0 GROUP BY z, label"""))
def agg02(spark, d):
    return stats.moments(views.lab(spark, d).filter("label >= 0"), ["z", "label"], ["v", "g"])


@query("agg03_merge_moments", sql("""SELECT label, count(*) AS area, sum(v) AS sum_v, sum(v * v) AS sumsq_v, min(v) AS min_v, max(v) AS max_v FROM lab WHERE label >= 0 GROUP BY label"""))
def agg03(spark, d):
    parts = stats.moments(views.lab(spark, d).filter("label >= 0"), ["z", "label"], ["v"])
    return stats.merge_moments(parts, ["label"], ["v"])


@query("agg04_reductions", sql("""SELECT z, label, count(*) AS area, min(v) AS min_v, max(v) AS max_v, round(avg(v), 6) AS mean_v, round(stddev_pop(v), 6) AS std_v FROM lab GROUP BY z, label"""))
def agg04(spark, d):
    return rounded(stats.reductions(stats.moments(views.lab(spark, d), ["z", "label"], ["v"]), ["v"]), "mean_v", "std_v")


@query("agg05_extremum", sql("""SELECT z, label, y AS ext_y, x AS ext_x, v AS ext_value, g AS ext_g, b AS ext_b FROM (
  SELECT *, row_number() OVER (PARTITION BY z, label ORDER BY v, y, x) AS r FROM lab) WHERE r = 1"""))
def agg05(spark, d):
    return stats.extremum(views.lab(spark, d), ["z", "label"], "v", ["g", "b"])


@query("agg05_extremum_max", sql("""SELECT z, label, y AS ext_y, x AS ext_x, v AS ext_value FROM (
  SELECT *, row_number() OVER (PARTITION BY z, label ORDER BY v DESC, y, x) AS r FROM lab) WHERE r = 1"""))
def agg05_max(spark, d):
    return stats.extremum(views.lab(spark, d), ["z", "label"], "v", largest=True)


@query("agg06_window_sample", sql("""e AS (SELECT z, label, y AS ey, x AS ex FROM (SELECT *, row_number() OVER (PARTITION BY z, label ORDER BY v, y, x) AS r FROM blocks) WHERE r = 1)
  SELECT e.z, e.label, ey AS ext_y, ex AS ext_x, round(avg(p.v), 6) AS win_v FROM e JOIN px p ON p.z = e.z AND abs(p.y - ey) <= 1 AND abs(p.x - ex) <= 1 GROUP BY 1, 2, 3, 4"""))
def agg06(spark, d):
    pixels = views.blocks(spark, d)
    points = stats.extremum(pixels, ["z", "label"], "v").drop("ext_value")
    return rounded(stats.window_sample(pixels, points, ["v"], 1))


@query("agg07_histogram_shares", sql("""SELECT z, label, round(count(*) FILTER (k = 0) / count(*), 6) AS hist00_v, round(count(*) FILTER (k = 1) / count(*), 6) AS hist01_v,
  round(count(*) FILTER (k = 2) / count(*), 6) AS hist02_v, round(count(*) FILTER (k = 3) / count(*), 6) AS hist03_v
  FROM (SELECT z, label, least(greatest(floor((v - 50) * 4 / 400), 0), 3) AS k FROM blocks) GROUP BY z, label"""))
def agg07(spark, d):
    return rounded(stats.histogram_shares(views.blocks(spark, d), ["z", "label"], "v", 50, 450, 4))


@query("agg07_histogram_counts", sql("""SELECT z, least(greatest(floor((v - 50) * 16 / 400), 0), 15)::INT AS bin, count(*) AS n FROM px GROUP BY 1, 2"""))
def agg07_counts(spark, d):
    return stats.histogram_counts(views.px(spark, d), ["z"], "v", 50, 450, 16)


@query("agg08_relevance", sql("""f AS (SELECT z, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM px GROUP BY z)
  SELECT z, label, round((max_v - min_v) / (min_v + hi - lo), 6) AS relevance_base FROM (SELECT z, label, min(v) AS min_v, max(v) AS max_v FROM blocks GROUP BY z, label) JOIN f USING (z)"""))
def agg08(spark, d):
    pixels = views.blocks(spark, d)
    table = pixels.groupBy("z", "label").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).join(stats.slice_range(pixels, "v", 0.05), "z")
    return rounded(table.select("z", "label", stats.relevance(F.col("lo"), F.col("hi"), F.col("floor"), F.col("ceiling")).alias("relevance_base")))


@query("agg09_slice_range", sql("SELECT z, round(quantile_cont(v, 0.05), 6) AS floor, round(quantile_cont(v, 0.95), 6) AS ceiling FROM px GROUP BY z"))
def agg09(spark, d):
    return rounded(stats.slice_range(views.px(spark, d), "v", 0.05))


@query("agg10_percentile", sql("SELECT z, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.333), 6) AS p33, round(quantile_cont(v, 0.9), 6) AS p90 FROM px GROUP BY z"))
def agg10(spark, d):
    p = views.px(spark, d).groupBy("z").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.333), F.lit(0.9))).alias("p"))
    return rounded(p.select("z", F.col("p")[0].alias("p10"), F.col("p")[1].alias("p33"), F.col("p")[2].alias("p90")))


@query("agg14_per_slice_reductions", sql("""c AS (SELECT z, label, count(*) AS area, max(x) - min(x) + 1 AS bbox_w FROM lab WHERE label >= 0 GROUP BY z, label)
  SELECT label, round(avg(area), 6) AS area_mean, min(area) AS area_min, max(area) AS area_max, round(stddev_pop(area), 6) AS area_std,
  round(avg(bbox_w), 6) AS bbox_w_mean, min(bbox_w) AS bbox_w_min, max(bbox_w) AS bbox_w_max, round(stddev_pop(bbox_w), 6) AS bbox_w_std FROM c GROUP BY label"""))
def agg14(spark, d):
    parts = views.lab(spark, d).filter("label >= 0").groupBy("z", "label").agg(F.count("*").alias("area"), (F.max("x") - F.min("x") + 1).alias("bbox_w"))
    return rounded(stats.per_slice_reductions(parts, ["label"], ["area", "bbox_w"]))


@query("agg15_label_median", sql("SELECT z, label, count(*) AS pixel_count, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, median(v) AS median FROM lab GROUP BY z, label"))
def agg15(spark, d):
    return rounded(stats.label_summary(views.lab(spark, d), ["z", "label"]), "mean")


@query("agg17_percentile_ladder", sql("""SELECT event_type, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
  round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.999), 6) AS p99_9 FROM events GROUP BY event_type"""))
def agg17(spark, d):
    return rounded(stats.percentile_ladder(views.table(spark, d, "events"), "value", ["event_type"], (1, 25, 50, 99.9)), "mean", "std", "p1", "p25", "p50", "p99_9")


@query("agg18_parameter_summary", sql("""l AS (SELECT l_returnflag, unnest(['discount', 'quantity']) AS parameter, unnest([l_discount, l_quantity]) AS value FROM lineitem)
  SELECT l_returnflag, parameter, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(median(value), 6) AS median, min(value) AS min,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM l GROUP BY 1, 2"""))
def agg18(spark, d):
    items = views.table(spark, d, "lineitem").select("l_returnflag", F.col("l_discount").alias("discount"), F.col("l_quantity").alias("quantity"))
    return rounded(stats.parameter_summary(items, "l_returnflag", ["discount", "quantity"]))


@query("agg19_error_summary", sql("""e AS (SELECT l_returnflag AS factor, l_extendedprice * (1 - l_discount) - l_extendedprice AS error, l_extendedprice AS reference FROM lineitem)
  SELECT factor, count(*) AS n, round(avg(error), 4) AS mean_error, round(stddev_samp(error), 4) AS sd_error, round(median(error), 4) AS median_error, round(avg(abs(error)), 4) AS mae,
  round(sqrt(avg(error * error)), 4) AS rmse, round(100 * avg(abs(error) / abs(reference)), 4) AS relative_percent, round(quantile_cont(error, 0.025), 4) AS q025, round(quantile_cont(error, 0.25), 4) AS q25,
  round(quantile_cont(error, 0.75), 4) AS q75, round(quantile_cont(error, 0.975), 4) AS q975, round(max(abs(error)), 4) AS worst FROM e GROUP BY factor"""))
def agg19(spark, d):
    e = views.table(spark, d, "lineitem").selectExpr("l_returnflag AS factor", "l_extendedprice * (1 - l_discount) - l_extendedprice AS error", "l_extendedprice AS reference")
    return rounded(stats.error_summary(e, ["factor"]), digits=4)


@query("agg20_fold_summary", sql("""f AS (SELECT l_returnflag AS model, l_linenumber AS fold, avg(l_discount) AS score, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS tp FROM lineitem GROUP BY 1, 2)
  SELECT model, round(avg(score), 6) AS score_mean, round(stddev_samp(score), 6) AS score_std, sum(tp)::BIGINT AS tp FROM f GROUP BY model"""))
def agg20(spark, d):
    folds = views.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("fold")).agg(F.avg("l_discount").alias("score"), F.count_if(F.col("l_discount") > 0.05).alias("tp"))
    return rounded(stats.fold_summary(folds, ["score"], ["tp"]))


@query("agg21_pivot_disagreement", sql("""p AS (SELECT l_orderkey % 500 AS item, avg(CASE WHEN l_linestatus = 'F' THEN l_discount END) AS f, avg(CASE WHEN l_linestatus = 'O' THEN l_discount END) AS o FROM lineitem GROUP BY 1)
  SELECT item, round(f, 6) AS "F", round(o, 6) AS "O", round(abs(f - o), 6) AS disagreement, round(1 - abs((f + o) / 2 - 0.05), 6) AS hardness FROM p"""))
def agg21(spark, d):
    items = views.table(spark, d, "lineitem").withColumn("item", F.expr("l_orderkey % 500"))
    p = items.groupBy("item").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_discount"))
    return rounded(p.select("item", "F", "O", F.abs(F.col("F") - F.col("O")).alias("disagreement"), (1 - F.abs((F.col("F") + F.col("O")) / 2 - 0.05)).alias("hardness")))


@query("agg22_hard_set", sql("""t AS (SELECT event_type, quantile_cont(value, 0.9) AS cut FROM events GROUP BY event_type)
  SELECT event_type, count(*) AS n, round(median(value), 6) AS median_value FROM events JOIN t USING (event_type) WHERE value >= cut GROUP BY event_type"""))
def agg22(spark, d):
    events = views.table(spark, d, "events")
    cut = events.groupBy("event_type").agg(F.percentile("value", F.lit(0.9)).alias("cut"))
    return rounded(events.join(cut, "event_type").filter("value >= cut").groupBy("event_type").agg(F.count("*").alias("n"), F.median("value").alias("median_value")))


@query("agg23_contact_lengths", sql("SELECT z, a, b, saddle, length FROM arcs"))
def agg23(spark, d):
    return views.arcs(spark, d)


@query("agg24_unique_arcs", sql("""r AS (SELECT l_suppkey % 50 AS a, l_partkey % 50 AS b, l_quantity AS saddle FROM lineitem)
  SELECT least(a, b) AS a, greatest(a, b) AS b, min(saddle) AS saddle, count(*) AS cnt FROM r WHERE a <> b GROUP BY 1, 2"""))
def agg24(spark, d):
    from gridloom.operators.graph import unique_arcs

    raw = views.table(spark, d, "lineitem").selectExpr("l_suppkey % 50 AS a", "l_partkey % 50 AS b", "l_quantity AS saddle")
    return unique_arcs(raw, ())


@query("agg25_heaviest", sql("SELECT z, label, voxels FROM (SELECT z, label, count(*) AS voxels, row_number() OVER (PARTITION BY z ORDER BY count(*) DESC, label) AS r FROM lab GROUP BY z, label) WHERE r = 1"))
def agg25(spark, d):
    return stats.heaviest(views.lab(spark, d), ["z"])


@query("agg26_tissue_fraction", sql("""m AS (SELECT z * 32 + y AS y, x, CASE WHEN v % 2 = 0 THEN 1.0 ELSE 0.0 END AS tissue FROM px),
  t AS (SELECT a.i * 8 + b.i AS tile, a.i * 40 AS y0, a.i * 40 + 40 AS y1, b.i * 40 AS x0, b.i * 40 + 40 AS x1 FROM range(56) a(i), range(8) b(i))
  SELECT tile, round(avg(tissue), 6) AS fraction, count(*) AS n_cells FROM t JOIN m ON y >= y0 // 10 AND y < y1 // 10 AND x >= x0 // 10 AND x < x1 // 10 GROUP BY tile"""))
def agg26(spark, d):
    cells = views.px(spark, d).select((F.col("z") * 32 + F.col("y")).cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.expr("CASE WHEN v % 2 = 0 THEN 1.0D ELSE 0.0D END").alias("tissue"))
    tiles = spark.range(448).selectExpr("id AS tile", "(id div 8) * 40 AS y0", "(id div 8) * 40 + 40 AS y1", "(id % 8) * 40 AS x0", "(id % 8) * 40 + 40 AS x1")
    return rounded(stats.tissue_fractions(cells, tiles, 10))


@query("agg27_value_range", sql("SELECT z, max(v) - min(v) AS value_range FROM px GROUP BY z"))
def agg27(spark, d):
    return views.px(spark, d).groupBy("z").agg((F.max("v") - F.min("v")).alias("value_range"))


@query("agg28_zscores", sql("SELECT z, label, round((mean_v - avg(mean_v) OVER (PARTITION BY z)) / greatest(stddev_pop(mean_v) OVER (PARTITION BY z), 1e-12), 6) AS z_mean_v FROM regions"))
def agg28(spark, d):
    rows = views.blocks(spark, d).groupBy("z", "label").agg(F.avg("v").alias("mean_v"))
    return rounded(stats.zscores(rows, ["mean_v"]).select("z", "label", "z_mean_v"))


@query("agg29_phase_timings", sql("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(value) AS worst FROM events GROUP BY event_type"))
def agg29(spark, d):
    e = views.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.avg("value").alias("mean"), F.max("value").alias("worst"))
    return rounded(e, "mean")


@query("prj01_feature_table", sql("""SELECT z, label AS feature_id, count(*) AS area, max(x) - min(x) + 1 AS bbox_w, max(y) - min(y) + 1 AS bbox_h, round(avg(v), 6) AS mean_base, min(v) AS min_base, max(v) AS max_base,
  round(stddev_pop(v), 6) AS std_base, round(avg(g), 6) AS mean_green FROM blocks GROUP BY z, label"""))
def prj01(spark, d):
    from gridloom.plans.spec import Channel, feature_table

    pixels = views.blocks(spark, d).withColumnRenamed("label", "feature_id")
    return rounded(feature_table(pixels, [Channel("base", "v", ("mean", "min", "max", "std")), Channel("green", "g", ("mean",))], ["z", "feature_id"], boxes=("bbox_w", "bbox_h")))


@query("prj02_global_projection", sql("SELECT label AS global_id, count(*) AS voxel_count, count(DISTINCT z) AS num_slices, round(avg(v), 6) AS mean_base, round(stddev_pop(v), 6) AS std_base FROM blocks GROUP BY label"))
def prj02(spark, d):
    per_slice = stats.moments(views.blocks(spark, d), ["z", "label"], ["v"])
    pooled = stats.merge_moments(per_slice, ["label"], ["v"]).join(per_slice.groupBy("label").agg(F.countDistinct("z").alias("num_slices")), "label")
    return rounded(pooled.select(F.col("label").alias("global_id"), F.col("area").alias("voxel_count"), "num_slices", stats.mean_of("v").alias("mean_base"), stats.std_of("v").alias("std_base")))


@query("prj04_row_map", sql("SELECT z, label, 'area=' || count(*) || ',max=' || max(v)::BIGINT AS fields FROM blocks GROUP BY z, label"))
def prj04(spark, d):
    t = views.blocks(spark, d).groupBy("z", "label").agg(F.count("*").alias("area"), F.max("v").cast("long").alias("max"))
    entries = F.map_entries(F.create_map(F.lit("area"), F.col("area"), F.lit("max"), F.col("max")))
    return t.select("z", "label", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("fields"))


@query("prj05_feature_matrix", sql("SELECT z, label, round(area, 6)::VARCHAR || '|' || round(hi - lo, 6)::VARCHAR AS vector FROM regions"))
def prj05(spark, d):
    t = views.blocks(spark, d).groupBy("z", "label").agg(F.count("*").cast("double").alias("area"), (F.max("v") - F.min("v")).alias("span"))
    return t.select("z", "label", F.concat_ws("|", F.col("area").cast("long").cast("string"), F.col("span").cast("string")).alias("vector"))
