"""Cell assembly from overlapping region decompositions of one volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.durable import durable
from gridloom.plans.relax import relax

#: Bits of the voxel flags.
INSIDE, MEMBRANE, RIDGE, BACKGROUND = 1, 2, 4, 8


def overlap(voxels: DataFrame, region: str = "ridge", cell: str = "cell") -> DataFrame:
    """``region, cell, n``: the cell that a region shares most voxels with, smaller id on ties."""
    counts = voxels.groupBy(region, cell).agg(F.count("*").alias("n"))
    return counts.groupBy(region).agg(F.min_by(F.struct(cell, "n"), F.struct(-F.col("n"), F.col(cell))).alias("m")).select(region, "m.*")


def background_cell(voxels: DataFrame, cell: str = "cell") -> DataFrame:
    """The heaviest cell, as one row ``cell``."""
    counts = voxels.groupBy(cell).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by(cell, F.struct(-F.col("n"), F.col(cell))).alias(cell))


def flags(voxels: DataFrame, membrane_from: float, cell: str = "cell", ridge: str = "ridge") -> DataFrame:
    """Adds ``flags``: inside a cell, membrane by value, ridge of another cell, background."""
    heavy = background_cell(voxels, cell).withColumnRenamed(cell, "__bg")
    owner = overlap(voxels, ridge, cell).select(ridge, F.col(cell).alias("__owner"))
    both = voxels.crossJoin(F.broadcast(heavy)).join(owner, ridge)
    bit = lambda c, b: F.when(c, b).otherwise(0)
    marks = bit(F.col(cell) != F.col("__bg"), INSIDE).bitwiseOR(bit(F.col("v") >= membrane_from, MEMBRANE)).bitwiseOR(bit(F.col("__owner") != F.col(cell), RIDGE)).bitwiseOR(bit(F.col(cell) == F.col("__bg"), BACKGROUND))
    return both.withColumn("flags", marks).drop("__bg", "__owner")


def cell_table(flagged: DataFrame, cell: str = "cell") -> DataFrame:
    """Voxels, extent and the union of flags of each cell."""
    return flagged.groupBy(cell).agg(F.count("*").alias("voxels"), F.bit_or("flags").alias("flags"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.avg("v").alias("mean"))


def nearest_source(arcs: DataFrame, sources: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """``node, owner, cost``: multi-source shortest paths over ``a, b, w``; ties to the smaller owner."""
    used = durable(arcs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(arcs.select("b", "a", "w")), "dijkstra-arcs")

    def offer(front: DataFrame) -> DataFrame:
        met = front.select(F.col("node").alias("src"), "k").join(used, "src")
        return met.select(F.col("dst").alias("node"), F.struct((F.col("k.cost") + F.col("w")).alias("cost"), F.col("k.owner").alias("owner")).alias("k"))

    start = sources.select("node", F.struct(F.lit(0.0).alias("cost"), F.col("node").alias("owner")).alias("k"))
    return relax(start, ["node"], "k", offer, "dijkstra", most_rounds).select("node", "k.owner", "k.cost")
