"""PRJ06-23, RAS and MEA: plane algebra, stencils and intensity measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import views
from gridloom.catalog import query, rounded
from gridloom.operators import measure, planes, raster
from gridloom.views import sql

P = "SELECT z, y, x, v, g / 100 AS g, b FROM px"


def _planes(spark, d):
    p = views.px(spark, d).select("z", "y", "x", "v", (F.col("g") / 100).alias("g"), "b")
    return p.withColumn("p", F.array("v", "g", "b"))


@query("prj06_pick_plane", sql("SELECT z, y, x, round(g / 100, 6) AS out FROM px"))
def prj06(spark, d):
    return rounded(_planes(spark, d).select("z", "y", "x", planes.pick(F.col("p"), 1).alias("out")))


@query("prj07_luminance", sql(f"SELECT z, y, x, round(0.2126 * v + 0.7152 * g + 0.0722 * b, 4) AS out FROM ({P})"))
def prj07(spark, d):
    return rounded(_planes(spark, d).select("z", "y", "x", planes.luminance(F.col("p")).alias("out")), digits=4)


@query("prj08_weighted_sum", sql(f"SELECT z, y, x, round(0.5 * v - 0.25 * g + 2 * b, 4) AS out FROM ({P})"))
def prj08(spark, d):
    return rounded(_planes(spark, d).select("z", "y", "x", planes.weighted_sum(F.col("p"), [0.5, -0.25, 2]).alias("out")), digits=4)


@query("prj09_plane_extremes", sql(f"SELECT z, y, x, round((v + g + b) / 3, 4) AS mean, round(greatest(v, g, b), 4) AS max, round(least(v, g, b), 4) AS min FROM ({P})"))
def prj09(spark, d):
    r = lambda h: planes.reduce_planes(F.col("p"), h).alias(h)
    return rounded(_planes(spark, d).select("z", "y", "x", r("mean"), r("max"), r("min")), digits=4)


@query("prj10_hsv", sql(f"""c AS (SELECT *, greatest(v, g, b) AS hi, least(v, g, b) AS lo FROM ({P}))
  SELECT z, y, x, round(CASE WHEN hi = lo THEN 0 WHEN hi = v THEN CASE WHEN (g - b) / (hi - lo) < 0 THEN 60 * (g - b) / (hi - lo) + 360 ELSE 60 * (g - b) / (hi - lo) END
    WHEN hi = g THEN 60 * ((b - v) / (hi - lo) + 2) ELSE 60 * ((v - g) / (hi - lo) + 4) END, 6) AS hue, round(CASE WHEN hi > 0 THEN (hi - lo) / hi ELSE 0 END, 6) AS saturation, round(hi, 4) AS value FROM c"""))
def prj10(spark, d):
    c = [F.col(k) for k in "vgb"]
    out = _planes(spark, d).select("z", "y", "x", planes.hsv(*c, "hue").alias("hue"), planes.hsv(*c, "saturation").alias("saturation"), planes.hsv(*c, "value").alias("value"))
    return out.select("z", "y", "x", F.round("hue", 6).alias("hue"), F.round("saturation", 6).alias("saturation"), F.round("value", 4).alias("value"))


@query("prj11_optical_density", sql("SELECT z, y, x, round(-log10(greatest(v, 1) / greatest(max(v) OVER (PARTITION BY z), 1)), 6) + 0 AS od_v FROM px"))
def prj11(spark, d):
    return rounded(planes.with_density(views.px(spark, d), ["v"]).select("z", "y", "x", "od_v"))


@query("prj12_density_planes", sql("""SELECT z, y, x, round(-log10(greatest(v, 1) / greatest(max(v) OVER (PARTITION BY z), 1)), 6) + 0 AS od_v, round(-log10(greatest(g, 1) / greatest(max(g) OVER (PARTITION BY z), 1)), 6) + 0 AS od_g FROM px"""))
def prj12(spark, d):
    return rounded(planes.with_density(views.px(spark, d), ["v", "g"]).select("z", "y", "x", "od_v", "od_g"))


@query("prj14_select_planes", sql(f"SELECT z, y, x, round(b, 4) AS p0, round(v, 4) AS p1 FROM ({P})"))
def prj14(spark, d):
    s = planes.select_planes(F.col("p"), [2, 0])
    return rounded(_planes(spark, d).select("z", "y", "x", F.get(s, F.lit(0)).alias("p0"), F.get(s, F.lit(1)).alias("p1")), digits=4)


@query("prj15_project_planes", sql(f"SELECT z, y, x, round(v + g, 4) AS p0, round(v - 0.5 * b, 4) AS p1 FROM ({P})"))
def prj15(spark, d):
    s = planes.project_planes(F.col("p"), [[1, 1, 0], [1, 0, -0.5]])
    return rounded(_planes(spark, d).select("z", "y", "x", F.get(s, F.lit(0)).alias("p0"), F.get(s, F.lit(1)).alias("p1")), digits=4)


@query("prj16_reduce_planes", sql(f"SELECT z, y, x, round((2 * v + 3 * g + b) / 3, 4) AS weighted_mean, round(sqrt(v * v + g * g + b * b), 4) AS norm, round(v + g + b, 4) AS sum FROM ({P})"))
def prj16(spark, d):
    p = F.col("p")
    return rounded(_planes(spark, d).select("z", "y", "x", planes.reduce_planes(p, "mean", [2, 3, 1]).alias("weighted_mean"), planes.reduce_planes(p, "norm").alias("norm"), planes.reduce_planes(p, "sum").alias("sum")), digits=4)


def _unmix_sql() -> str:
    import numpy as np

    m = np.linalg.inv(planes.stain_matrix("he")).T.tolist()
    od = [f"(-log10(greatest({c}, 1) / 1000))" for c in ("v", "g", "b")]
    return ", ".join(f"round({' + '.join(f'({w!r}) * {o}' for w, o in zip(row, od))}, 4) AS s{k}" for k, row in enumerate(m))


@query("prj17_stain_unmix", sql(f"SELECT z, y, x, {_unmix_sql()} FROM ({P})"))
def prj17(spark, d):
    od = F.transform("p", lambda v: planes.optical_density(v, F.lit(1000.0)))
    s = planes.unmix(od, "he")
    return rounded(_planes(spark, d).select("z", "y", "x", *[F.get(s, F.lit(k)).alias(f"s{k}") for k in range(3)]), digits=4)


@query("prj18_two_point", sql("SELECT z, y, x, round(least(greatest((v - 100) / 200, 0), 1), 6) AS out FROM px"))
def prj18(spark, d):
    return rounded(views.px(spark, d).select("z", "y", "x", planes.two_point(F.col("v"), F.lit(100.0), F.lit(300.0), clamp=True).alias("out")))


@query("prj19_void_posterior", sql("SELECT z, y, x, round(1 / (1 + exp(-((power(v - 220, 2) - power(v - 150, 2)) / (2 * 900)))), 6) AS p_void FROM px"))
def prj19(spark, d):
    return rounded(views.px(spark, d).select("z", "y", "x", planes.void_posterior(F.col("v"), 150, 220, 900).alias("p_void")))


@query("prj20_mask_raster", sql("SELECT p.z, p.y, p.x, CASE WHEN mean_v > 195 THEN 255 ELSE 0 END AS m FROM blocks p JOIN regions r ON r.z = p.z AND r.label = p.label"))
def prj20(spark, d):
    pixels = views.blocks(spark, d)
    kept = pixels.groupBy("z", "label").agg(F.avg("v").alias("m")).filter("m > 195").select("z", "label", F.lit(255).alias("m"))
    return pixels.join(kept, ["z", "label"], "left").select("z", "y", "x", F.coalesce("m", F.lit(0)).alias("m"))


@query("prj21_placement", sql("SELECT z, label, min(x) * 4.0 + 100 AS slide_x, min(y) * 4.0 - 50 AS slide_y FROM blocks GROUP BY z, label"))
def prj21(spark, d):
    t = views.blocks(spark, d).groupBy("z", "label").agg(F.min("x").alias("mx"), F.min("y").alias("my"))
    return t.select("z", "label", planes.placed(F.col("mx"), 100.0, 4.0).alias("slide_x"), planes.placed(F.col("my"), -50.0, 4.0).alias("slide_y"))


@query("prj23_smallest_integer", "SELECT 'l_linenumber' AS name, 'byte' AS type UNION ALL SELECT 'l_discount', 'double'")
def prj23(spark, d):
    items = views.table(spark, d, "lineitem")
    rows = [(c, planes.smallest_integer(items, c)) for c in ("l_linenumber", "l_discount")]
    return spark.createDataFrame(rows, "name string, type string")


def _conv_sql(axis: str, column: str, k: list[float], smooth: bool, src: str = "px") -> str:
    r = len(k) // 2
    on = f"q.z = p.z AND q.y = p.y AND q.x = p.x + d" if axis == "x" else f"q.z = p.z AND q.x = p.x AND q.y = p.y + d"
    values = ", ".join(f"({i - r}, {w!r}::DOUBLE)" for i, w in enumerate(k))
    return f"SELECT p.z, p.y, p.x, sum(w * (coalesce(q.{column}, p.{column}) - p.{column})) + {'any_value(p.' + column + ')' if smooth else '0'} AS s FROM {src} p CROSS JOIN (VALUES {values}) k(d, w) LEFT JOIN {src} q ON {on} GROUP BY p.z, p.y, p.x"


def _both_sql(ox: int, oy: int, sigma: float, name: str) -> str:
    kx, ky = raster.kernel(sigma, ox), raster.kernel(sigma, oy)
    return f"{name}x AS ({_conv_sql('x', 'v', kx, ox == 0)}), {name} AS ({_conv_sql('y', 's', ky, oy == 0, name + 'x')})"


@query("ras02_gaussian_blur", sql(f"{_both_sql(0, 0, 1.0, 'f')} SELECT z, y, x, round(s, 4) AS blur FROM f"))
def ras02(spark, d):
    return rounded(raster.gaussian(views.px(spark, d), "v", 1.0).select("z", "y", "x", "blur"), digits=4)


@query("ras03_gaussian_derivative", sql(f"{_both_sql(1, 0, 1.0, 'f')} SELECT z, y, x, round(s, 4) AS dx FROM f"))
def ras03(spark, d):
    return rounded(raster.gaussian(views.px(spark, d), "v", 1.0, "dx", (1, 0)).select("z", "y", "x", "dx"), digits=4)


@query("ras04_laplacian", sql(f"{_both_sql(2, 0, 1.0, 'f')}, {_both_sql(0, 2, 1.0, 'h')} SELECT f.z, f.y, f.x, round(f.s + h.s, 4) AS laplacian FROM f JOIN h USING (z, y, x)"))
def ras04(spark, d):
    return rounded(raster.laplacian(views.px(spark, d), "v", 1.0).select("z", "y", "x", "laplacian"), digits=4)


@query("ras05_zero_crossings", sql(f"""{_both_sql(2, 0, 1.0, 'f')}, {_both_sql(0, 2, 1.0, 'h')}, l AS (SELECT f.z, f.y, f.x, f.s + h.s AS s FROM f JOIN h USING (z, y, x))
  SELECT z, y, x, (coalesce(sign(s) * sign((SELECT q.s FROM l q WHERE q.z = l.z AND q.y = l.y AND q.x = l.x + 1)) < 0, false) OR coalesce(sign(s) * sign((SELECT q.s FROM l q WHERE q.z = l.z AND q.y = l.y + 1 AND q.x = l.x)) < 0, false))::INT AS crossing FROM l"""))
def ras05(spark, d):
    return raster.zero_crossings(views.px(spark, d), "v", 1.0).select("z", "y", "x", "crossing")


@query("ras06_hessian_eigenvalues", sql(f"""{_both_sql(2, 0, 1.0, 'f')}, {_both_sql(0, 2, 1.0, 'h')}, {_both_sql(1, 1, 1.0, 'm')}
  SELECT f.z, f.y, f.x, round((f.s + h.s) / 2 + sqrt(power((f.s - h.s) / 2, 2) + m.s * m.s), 4) AS hessian_largest, round((f.s + h.s) / 2 - sqrt(power((f.s - h.s) / 2, 2) + m.s * m.s), 4) AS hessian_smallest
  FROM f JOIN h USING (z, y, x) JOIN m USING (z, y, x)"""))
def ras06(spark, d):
    return rounded(raster.hessian_eigenvalues(views.px(spark, d), "v", 1.0).select("z", "y", "x", "hessian_largest", "hessian_smallest"), digits=4)


@query("ras07_structure_tensor", None)
def ras07(spark, d):
    return rounded(raster.structure_eigenvalues(views.px(spark, d), "v", 1.0, 1.0).select("z", "y", "x", "tensor_largest", "tensor_smallest"), digits=3)


@query("ras08_gradient_magnitude", sql(f"{_both_sql(1, 0, 1.0, 'f')}, {_both_sql(0, 1, 1.0, 'h')} SELECT f.z, f.y, f.x, round(sqrt(f.s * f.s + h.s * h.s), 4) AS gradmag FROM f JOIN h USING (z, y, x)"))
def ras08(spark, d):
    return rounded(raster.gradient_magnitude(views.px(spark, d), "v", 1.0).select("z", "y", "x", "gradmag"), digits=4)


@query("ras08_edge_hysteresis", None)
def ras08_edges(spark, d):
    return raster.edge_mask(views.px(spark, d), "v", 1.0, 15.0, 30.0)


def _across_sql(name, sx, sy):
    """Magnitude along the gradient on one side, between the main neighbour and the diagonal one."""
    return f"""{name} AS (SELECT g.z, g.y, g.x, coalesce(a.m, 0) * (1 - g.lean) + coalesce(b.m, 0) * g.lean AS m FROM g
      LEFT JOIN g a ON a.z = g.z AND a.x = g.x + CASE WHEN g.flat THEN {sx} ELSE 0 END AND a.y = g.y + CASE WHEN g.flat THEN 0 ELSE {sy} END
      LEFT JOIN g b ON b.z = g.z AND b.x = g.x + {sx} AND b.y = g.y + {sy})"""


@query("ras08_thin_edges", sql(f"""{_both_sql(1, 0, 1.0, 'f')}, {_both_sql(0, 1, 1.0, 'h')},
  g AS (SELECT f.z, f.y, f.x, sqrt(f.s * f.s + h.s * h.s) AS m, f.s AS dx, h.s AS dy, abs(f.s) >= abs(h.s) AS flat, least(abs(f.s), abs(h.s)) / greatest(abs(f.s), abs(h.s)) AS lean FROM f JOIN h USING (z, y, x) WHERE f.s <> 0 OR h.s <> 0),
  {_across_sql('ahead', 'CASE WHEN g.dx > 0 THEN 1 ELSE -1 END', 'CASE WHEN g.dy > 0 THEN 1 ELSE -1 END')}, {_across_sql('behind', 'CASE WHEN -g.dx > 0 THEN 1 ELSE -1 END', 'CASE WHEN -g.dy > 0 THEN 1 ELSE -1 END')}
  SELECT z, y, x, round(g.m, 4) AS gradmag FROM g JOIN ahead USING (z, y, x) JOIN behind USING (z, y, x) WHERE g.m > ahead.m AND g.m >= behind.m"""))
def ras08_thin(spark, d):
    return rounded(raster.ridge_cells(views.px(spark, d), "v", 1.0).select("z", "y", "x", "gradmag"), digits=4)


_MORPH = """lo AS (SELECT p.z, p.y, p.x, min(q.v) AS lo, max(q.v) AS hi FROM px p JOIN px q ON q.z = p.z AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY 1, 2, 3)"""


@query("ras09_erode_dilate", sql(f"{_MORPH} SELECT z, y, x, lo AS eroded, hi AS dilated FROM lo"))
def ras09(spark, d):
    out = raster.morphology(views.px(spark, d), "v", "erode", 1, "eroded")
    return raster.morphology(out, "v", "dilate", 1, "dilated").select("z", "y", "x", "eroded", "dilated")


@query("ras09_open_close", sql(f"""{_MORPH} SELECT p.z, p.y, p.x, max(q.lo) AS opened, min(q.hi) AS closed FROM lo p JOIN lo q ON q.z = p.z AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY 1, 2, 3"""))
def ras09_open_close(spark, d):
    out = raster.morphology(views.px(spark, d), "v", "open", 1, "opened")
    return raster.morphology(out, "v", "close", 1, "closed").select("z", "y", "x", "opened", "closed")


CC = """cells AS (SELECT z, y, x, z * 1024 + y * 32 + x AS id FROM {src}),
  e AS (SELECT a.id AS a, b.id AS b FROM cells a JOIN cells b ON b.z = a.z AND {near}),
  reach(id, root) AS (SELECT id, id FROM cells UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.id AND r.root <= e.b),
  cc AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
  num AS (SELECT z, y, x, cells.id, dense_rank() OVER (PARTITION BY z ORDER BY root)::INT AS component FROM cells JOIN cc ON cc.id = cells.id)"""
FOUR, EIGHT = "abs(b.y - a.y) + abs(b.x - a.x) = 1", "abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND a.id <> b.id"


@query("ras10_label_components", sql(f"{CC.format(src='(SELECT * FROM px WHERE v > 230)', near=FOUR)} SELECT z, y, x, component FROM num"))
def ras10(spark, d):
    return raster.label_components(views.px(spark, d).filter("v > 230"), "z", 4)


@query("ras11_filter_chain", None)
def ras11(spark, d):
    return rounded(raster.filter_chain(views.px(spark, d).select("z", "y", "x", "v"), "v", [("blur", {"sigma": 1.0}), ("dilate", {"radius": 1}), ("gradmag", {"sigma": 1.0})]).select("z", "y", "x", "out"), digits=4)


@query("ras12_plane_chain", sql(f"{_both_sql(0, 0, 1.0, 'f')}, gx AS ({_conv_sql('x', 'g', raster.kernel(1.0), True)}), gg AS ({_conv_sql('y', 's', raster.kernel(1.0), True, 'gx')}) SELECT f.z, f.y, f.x, round(f.s + 0.01 * gg.s, 4) AS out FROM f JOIN gg USING (z, y, x)"))
def ras12(spark, d):
    p = views.px(spark, d).select("z", "y", "x", "v", "g")
    lifted = raster.gaussian(raster.gaussian(p, "v", 1.0, "bv"), "g", 1.0, "bg")
    return rounded(lifted.select("z", "y", "x", planes.weighted_sum(F.array("bv", "bg"), [1, 0.01]).alias("out")), digits=4)


@query("ras16_measurement_bank", sql(f"{_both_sql(0, 0, 1.0, 'f')}, {_both_sql(2, 0, 2.0, 'h')}, {_both_sql(0, 2, 2.0, 'm')} SELECT f.z, f.y, f.x, round(f.s, 4) AS \"blur_s1\", round(h.s + m.s, 4) AS \"laplacian_s2\" FROM f JOIN h USING (z, y, x) JOIN m USING (z, y, x)"))
def ras16(spark, d):
    return rounded(raster.measurement_bank(views.px(spark, d), "v", [1.0, 2.0]).select("z", "y", "x", "blur_s1", "laplacian_s2"), digits=4)


@query("ras18_halve", sql("SELECT z, (y // 2)::INT AS y, (x // 2)::INT AS x, round(avg(v), 6) AS v FROM px GROUP BY 1, 2, 3 HAVING count(*) = 4"))
def ras18(spark, d):
    return rounded(raster.halve(views.px(spark, d), "v"))


@query("ras19_moving_average", """WITH h AS (SELECT floor(value / 10)::INT AS bin, count(*) AS n FROM events GROUP BY 1), r AS (SELECT bin, n, row_number() OVER (ORDER BY bin) AS i, count(*) OVER () AS k FROM h)
  SELECT r.bin, round(sum(q.n) / 5.0, 6) AS smooth FROM r JOIN (VALUES (-2), (-1), (0), (1), (2)) o(d) ON true JOIN r q ON q.i = least(greatest(r.i + d, 1), r.k) GROUP BY r.bin""")
def ras19(spark, d):
    h = views.table(spark, d, "events").groupBy(F.floor(F.col("value") / 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return rounded(raster.moving_average(h, "bin", "n", 5).select("bin", "smooth"))


@query("mea01_gaussian_mixture", None)
def mea01(spark, d):
    return rounded(measure.gmm(views.px(spark, d), "v", ["z"]), digits=4)


@query("mea03_hard_assignment", None)
def mea03(spark, d):
    p = views.px(spark, d)
    return rounded(measure.hard_stats(p, measure.gmm(p, "v", ["z"]), "v", ["z"]), digits=4)



@query("mea04_empirical_mode", None)
def mea04(spark, d):
    return rounded(measure.empirical_mode(views.table(spark, d, "events"), "value", ["event_type"]), digits=4)


@query("mea05_histogram", """WITH q AS (SELECT event_type, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM events GROUP BY 1),
  c AS (SELECT event_type, least(floor((value - low) * 32 / (high - low)), 31)::INT AS bin, count(*) AS n FROM events JOIN q USING (event_type) WHERE value BETWEEN low AND high GROUP BY 1, 2)
  SELECT q.event_type, r.b::INT AS bin, coalesce(c.n, 0) AS n FROM q CROSS JOIN range(0, 32) r(b) LEFT JOIN c ON c.event_type = q.event_type AND c.bin = r.b""")
def mea05(spark, d):
    return measure.histogram(views.table(spark, d, "events"), "value", ["event_type"], 32).select("event_type", "bin", "n")


@query("mea05_two_peaks", None)
def mea05_peaks(spark, d):
    return rounded(measure.two_peaks(views.px(spark, d), "v", ["z"]), digits=4)


@query("mea06_region_measures", sql("""SELECT z, count(*) FILTER (y < 8 AND x < 8) AS air_n, round(avg(v) FILTER (y < 8 AND x < 8), 6) AS air_mean, median(v) FILTER (y < 8 AND x < 8) AS air_median, round(stddev_pop(v) FILTER (y < 8 AND x < 8), 6) AS air_std,
  count(*) FILTER (y >= 20 AND x >= 10) AS metal_n, round(avg(v) FILTER (y >= 20 AND x >= 10), 6) AS metal_mean, median(v) FILTER (y >= 20 AND x >= 10) AS metal_median, round(stddev_pop(v) FILTER (y >= 20 AND x >= 10), 6) AS metal_std FROM px GROUP BY z"""))
def mea06(spark, d):
    return rounded(measure.region_measures(views.px(spark, d), {"air": (0, 8, 0, 8), "metal": (20, 32, 10, 32)}))


@query("mea07_landmarks", sql("""m AS (SELECT z, median(v) FILTER (y < 8 AND x < 8) AS a, median(v) FILTER (y >= 20 AND x >= 10) AS b FROM px GROUP BY z)
  SELECT z, CASE WHEN a < b THEN a ELSE 150 END AS low, CASE WHEN a < b THEN b ELSE 250 END AS high, CASE WHEN a < b THEN 'regions' ELSE 'manual' END AS method FROM m"""))
def mea07(spark, d):
    return measure.landmarks(views.px(spark, d), "v", ["z"], "regions", (150, 250), rectangles={"air": (0, 8, 0, 8), "metal": (20, 32, 10, 32)})


@query("ras15_normalize_step", sql("""m AS (SELECT z, median(v) FILTER (y < 8 AND x < 8) AS a, median(v) FILTER (y >= 20 AND x >= 10) AS b FROM px GROUP BY z)
  SELECT z, y, x, round(CASE WHEN m.a < m.b THEN (v - m.a) / (m.b - m.a) ELSE (v - 150) / 100 END, 6) AS normalized FROM px JOIN m USING (z)"""))
def ras15(spark, d):
    p = views.px(spark, d)
    marks = measure.landmarks(p, "v", ["z"], "regions", (150, 250), rectangles={"air": (0, 8, 0, 8), "metal": (20, 32, 10, 32)})
    return rounded(measure.normalize(p, marks, "v", ["z"]).select("z", "y", "x", "normalized"))


@query("win08_local_maxima", """WITH h AS (SELECT floor(value / 5)::INT AS bin, count(*) AS n FROM events GROUP BY 1), w AS (SELECT bin, n, max(n) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top, max(n) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS prior FROM h)
  SELECT bin, n FROM w WHERE n = top AND coalesce(prior, -1) < n""")
def win08(spark, d):
    h = views.table(spark, d, "events").groupBy(F.floor(F.col("value") / 5).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return measure.local_maxima(h, "n", "bin", 2, [])


@query("win10_parabola", """WITH h AS (SELECT floor(value / 20)::INT AS bin, count(*)::DOUBLE AS n FROM events GROUP BY 1), w AS (SELECT bin, n, lag(n) OVER (ORDER BY bin) AS l, lead(n) OVER (ORDER BY bin) AS r FROM h)
  SELECT bin, round(CASE WHEN l IS NULL OR r IS NULL OR l - 2 * n + r = 0 THEN 0 ELSE least(greatest((l - r) * 0.5 / (l - 2 * n + r), -1), 1) END, 6) AS off FROM w""")
def win10(spark, d):
    from pyspark.sql import Window

    w = Window.orderBy("bin")
    h = views.table(spark, d, "events").groupBy(F.floor(F.col("value") / 20).cast("int").alias("bin")).agg(F.count("*").cast("double").alias("n"))
    return rounded(h.select("bin", measure.parabola_offset(F.lag("n").over(w), F.col("n"), F.lead("n").over(w)).alias("off")))
