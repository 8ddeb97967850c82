"""Three-dimensional basins: the topology contract with six neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import topology
from gridloom.operators.raster import cell_id
from gridloom.operators.topology import SIDE, jump_to_roots
from gridloom.plans.durable import durable

#: Axis, the axes across it, and the step of the raster index along it.
LINES = (("x", ("z", "y"), 1), ("y", ("z", "x"), SIDE), ("z", ("y", "x"), SIDE * SIDE))


def basins(voxels: DataFrame, value: str = "v") -> DataFrame:
    """Adds ``basin``: raster index of the minimum that steepest descent reaches over six neighbours."""
    df = voxels.withColumn("id", cell_id(F.col("z"), F.col("y"), F.col("x"), SIDE))
    options = [F.struct(F.col(value).alias("v"), F.col("id").alias("i"))]
    for along, across, step in LINES:
        w = Window.partitionBy(*across).orderBy(along)
        for f, sign in ((F.lag, -1), (F.lead, 1)):
            name = f"__{along}{'p' if sign > 0 else 'm'}"
            df = df.withColumn(name, F.when(f(along).over(w) == F.col(along) + sign, f(value).over(w)))
            options.append(F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("v"), (F.col("id") + sign * step).alias("i"))))
    pointed = df.withColumn("to", F.least(*options)["i"]).select(*voxels.columns, "id", "to")
    return pointed.join(jump_to_roots(pointed).withColumnRenamed("node", "id"), "id").withColumnRenamed("root", "basin").drop("id", "to")


def basin_arcs(labelled: DataFrame, value: str = "v") -> DataFrame:
    """``a, b, saddle, cnt`` between touching basins."""
    parts = []
    for along, across, _ in LINES:
        w = Window.partitionBy(*across).orderBy(along)
        n = labelled.select(along, F.col("basin").alias("p"), F.col(value).alias("pv"), F.lead(along).over(w).alias("__at"), F.lead("basin").over(w).alias("q"), F.lead(value).over(w).alias("qv"))
        parts.append(n.filter((F.col("__at") == F.col(along) + 1) & (F.col("p") != F.col("q"))).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.greatest("pv", "qv").alias("w")))
    return reduce(lambda x, y: x.union(y), parts).groupBy("a", "b").agg(F.min("w").alias("saddle"), F.count("*").alias("cnt"))


def basin_table(labelled: DataFrame, value: str = "v") -> DataFrame:
    """``basin, area, low, sum_base``; the area is in voxels."""
    return topology.basin_table(labelled.withColumn("volume", F.lit(0)), value, "volume").drop("volume")


def persistence(labelled: DataFrame, value: str = "v", small: int = topology.SMALL_ARCS) -> DataFrame:
    """``basin, into, height, persistence`` by the elder rule over the saddles between touching basins."""
    one = lambda df: df.withColumn("volume", F.lit(0))
    return topology.persistence(one(basin_table(labelled, value)), one(basin_arcs(labelled, value)), "volume", small, 1 << 62).drop("volume")


def living(deaths: DataFrame, least: float) -> DataFrame:
    """``basin, living``: where each basin belongs once all below ``least`` have ended."""
    to = F.when(F.col("persistence") < least, F.col("into")).otherwise(F.col("basin"))
    roots = topology.jump_to_roots(deaths.select(F.col("basin").alias("id"), to.alias("to")))
    return roots.select(F.col("node").alias("basin"), F.col("root").alias("living"))


def snapshots(labelled: DataFrame, deaths: DataFrame, levels: Sequence[float], value: str = "v") -> DataFrame:
    """``level, living, voxels, low, n_base`` of the regions that live at each level.

    Voxels meet once, in the table of basins; at a level only basins are
    followed.  The levels are few and given.
    """
    table = durable(basin_table(labelled, value), "volume-basins")
    parts = []
    for level in levels:
        alive = durable(living(deaths, level), "volume-living")
        parts.append(table.join(alive, "basin").groupBy("living").agg(F.sum("area").alias("voxels"), F.min("low").alias("low"), F.count("*").alias("n_base")).select(F.lit(float(level)).alias("level"), "living", "voxels", "low", "n_base"))
    return reduce(lambda a, b: a.union(b), parts)


def living_voxels(labelled: DataFrame, alive: DataFrame) -> DataFrame:
    """``labelled`` with ``living``, the region that each voxel's basin belongs to."""
    return labelled.join(alive, "basin")
