"""Tiled pyramids: levels of tiles, region reads, slide placement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiles(pixels: DataFrame, side: int = 8, by: str = "z") -> DataFrame:
    """``by, level, ty, tx, cells``: cells of a tile as an array of ``(y, x, v)``."""
    return pixels.groupBy(by, F.lit(0).alias("level"), F.floor(F.col("y") / side).cast("int").alias("ty"), F.floor(F.col("x") / side).cast("int").alias("tx")).agg(
        F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("cells")
    )


def build_levels(pixels: DataFrame, levels: int, by: str = "z") -> DataFrame:
    """``by, level, y, x, v``: each level is the mean of 2x2 boxes of the one before."""
    from gridloom.operators.raster import halve

    current = pixels.select(by, "y", "x", F.col("v").cast("double").alias("v"))
    out = current.withColumn("level", F.lit(0))
    for k in range(1, levels):
        current = halve(current, "v", (by,))
        out = out.unionByName(current.withColumn("level", F.lit(k)))
    return out


def best_level(scales: list[float], wanted: float) -> int:
    """Coarsest level that is still at least as fine as wanted; the finest if none is."""
    fine = [k for k, s in enumerate(scales) if s <= wanted]
    return max(fine, key=lambda k: scales[k]) if fine else 0


def read_region(tiled: DataFrame, level: int, y: int, x: int, h: int, w: int, side: int = 8) -> DataFrame:
    """Cells of a rectangle, clamped to what there is; only tiles that it meets are read."""
    met = tiled.filter((F.col("level") == level) & F.col("ty").between(y // side, (y + h - 1) // side) & F.col("tx").between(x // side, (x + w - 1) // side))
    cells = met.select(*[c for c in tiled.columns if c not in ("cells", "ty", "tx")], F.explode("cells").alias("c")).select("*", "c.*").drop("c")
    return cells.filter((F.col("y") >= y) & (F.col("y") < y + h) & (F.col("x") >= x) & (F.col("x") < x + w))


def place_labels(slide: DataFrame, roi: DataFrame, origin_y: int, origin_x: int, scale: int) -> DataFrame:
    """Labels of a region of interest under slide cells ``y, x``; -1 outside."""
    at = slide.withColumn("__y", F.floor((F.col("y") - origin_y) / scale)).withColumn("__x", F.floor((F.col("x") - origin_x) / scale))
    inner = roi.select(F.col("y").cast("long").alias("__y"), F.col("x").cast("long").alias("__x"), "label")
    return at.join(inner, ["__y", "__x"], "left").drop("__y", "__x").withColumn("label", F.coalesce("label", F.lit(-1)))
