"""Components in a slice, linked across slices into global features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.components import connected_components
from gridloom.operators.raster import label_components
from gridloom.plans.ranking import global_rank

#: Cross-slice steps (dy, dx) by connectivity.
STEPS = {
    6: [(0, 0)],
    18: [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)],
    26: [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)],
}
NODE = 1 << 32


def node_id(z: str = "z", component: str = "component"):
    """Order of nodes: slice by slice, component by component."""
    return F.col(z).cast("long") * NODE + F.col(component)


def slice_components(cells: DataFrame, connectivity: int = 6) -> DataFrame:
    """4-connected in the plane for 6, else 8-connected."""
    keep = tuple(c for c in cells.columns if c not in ("z", "y", "x"))
    return label_components(cells, "z", 4 if connectivity == 6 else 8, keep)


def links(labelled: DataFrame, connectivity: int = 6) -> DataFrame:
    """``u, v``: nodes of neighbouring slices that touch under the stencil."""
    here = labelled.select((F.col("z") - 1).alias("z"), "y", "x", node_id().alias("v"))
    before = labelled.select("z", "y", "x", node_id().alias("u"))
    parts = [here.select("z", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), "v") for dy, dx in STEPS[connectivity]]
    return reduce(lambda a, b: a.union(b), parts).join(before, ["z", "y", "x"]).select("u", "v").distinct()


def assign_global(labelled: DataFrame, connectivity: int = 6) -> DataFrame:
    """Adds ``global_id``, numbered from 1 by the first node of a feature."""
    nodes = labelled.select(node_id().alias("node")).distinct()
    roots = connected_components(links(labelled, connectivity))
    rooted = nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("root"))
    ids = global_rank(rooted.select("root").distinct(), "root", out="global_id").withColumn("global_id", F.col("global_id").cast("int"))
    mapped = rooted.join(ids, "root").select("node", "global_id")
    return labelled.withColumn("node", node_id()).join(mapped, "node").drop("node")


def feature_map(labelled: DataFrame) -> DataFrame:
    """``slice_index, segment_id, global_id``, one row a component."""
    return labelled.select(F.col("z").alias("slice_index"), F.col("component").alias("segment_id"), "global_id").distinct()


def global_table(labelled: DataFrame, value: str = "v") -> DataFrame:
    """One row a global feature: counts, extents, moments and its extreme, the earliest on ties."""
    v = F.col(value)
    ext = F.struct("x", "y", "z", v.alias("value"))
    first = F.struct(-v, node_id(), F.col("y"), F.col("x"))
    return labelled.groupBy("global_id").agg(
        F.count("*").alias("voxel_count"),
        F.countDistinct("z").alias("num_slices"),
        F.min("z").alias("first_slice"),
        F.max("z").alias("last_slice"),
        *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y", "z")],
        (F.sum(v) / F.count("*")).alias("mean_base"),
        F.min(v).alias("min_base"),
        F.max(v).alias("max_base"),
        F.stddev_pop(v).alias("std_base"),
        F.min_by(ext, first).alias("ext"),
    ).select("*", F.col("ext.x").alias("ext_x"), F.col("ext.y").alias("ext_y"), F.col("ext.z").alias("ext_z"), F.col("ext.value").alias("ext_base")).drop("ext")


def component_nodes(labelled: DataFrame, value: str = "v") -> DataFrame:
    """Statistics of each component of each slice."""
    return labelled.groupBy("z", "component").agg(
        F.count("*").alias("area"), F.sum(value).alias("sum_base"), F.min(value).alias("min_base"), F.max(value).alias("max_base"),
        (F.max("x") - F.min("x") + 1).alias("bbox_w"), (F.max("y") - F.min("y") + 1).alias("bbox_h"),
    )


def linkable(sizes: DataFrame, dims: list[str], item: str = "z") -> DataFrame:
    """``item, next``: neighbouring slices of equal dimensions; others aren't linked."""
    after = sizes.select((F.col(item) - 1).alias(item), F.col(item).alias("next"), *dims)
    return sizes.join(after, [item, *dims]).select(item, "next")
