"""Annotation gestures and the regions that they touch; the last gesture wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box_cells(gestures: DataFrame) -> DataFrame:
    """``uid, class, z, y, x`` of the cells in ``y0..y1, x0..x1`` inclusive."""
    rows = gestures.select("uid", "class", "z", F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1")
    return rows.select("uid", "class", "z", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def line_cells(gestures: DataFrame) -> DataFrame:
    """Cells of straight strokes ``y0, x0 -> y1, x1``, one a step of the longer side."""
    n = F.greatest(F.abs(F.col("y1") - F.col("y0")), F.abs(F.col("x1") - F.col("x0")), F.lit(1))
    steps = gestures.select("uid", "class", "z", "y0", "y1", "x0", "x1", n.alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("i"))
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / F.col("n") + 0.5).cast("int")
    return steps.select("uid", "class", "z", at("y0", "y1").alias("y"), at("x0", "x1").alias("x")).distinct()


def in_polygon(y: Column, x: Column, points: Column) -> Column:
    """Even-odd rule over ``ARRAY<STRUCT<x, y>>``."""
    n = F.size(points)
    edge = F.transform(points, lambda p, i: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), F.element_at(points, (i + 1) % n + 1)["x"].alias("x1"), F.element_at(points, (i + 1) % n + 1)["y"].alias("y1")))
    crossed = F.filter(edge, lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * F.try_divide(y - e["y0"], (e["y1"] - e["y0"]).cast("double")) + e["x0"]))
    return F.size(crossed) % 2 == 1


def touched(cells: DataFrame, regions: DataFrame, label: str = "label") -> DataFrame:
    """``z, label, uid, class`` of the regions under gesture cells; background isn't touched."""
    return cells.join(regions.select("z", "y", "x", label).filter(F.col(label) >= 0), ["z", "y", "x"]).select("z", label, "uid", "class").distinct()


def resolve(events: DataFrame, label: str = "label") -> DataFrame:
    return events.groupBy("z", label).agg(F.max_by("class", "uid").alias("class"))
