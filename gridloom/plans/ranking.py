"""Numbering rows of a whole table without bringing them to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.durable import durable


def global_rank(df: DataFrame, *order: str, out: str = "rank") -> DataFrame:
    """Adds ``out``: 1, 2, ... in the order of the columns, which tell all rows apart.

    The rows are dealt out in ranges and numbered within each; only one count a
    range meets in one place.
    """
    ranged = durable(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranked")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__range", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "__range").withColumn(out, F.col("__before") + within).drop("__range", "__before")


def _dealt(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    return durable(df.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()), "ranged")


def _meet(rows: DataFrame, spans: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows with what their group brings along from earlier ranges; groups may be null."""
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group]
    return rows.alias("r").join(spans.alias("s"), [F.col("r.__range") == F.col("s.__range"), *same]).select("r.*", *[f"s.{c}" for c in spans.columns if c not in ("__range", *group)])


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "rank") -> DataFrame:
    """Adds ``out``: 1, 2, ... within each group in the order of the columns.

    A group may hold any share of the rows: it is cut into ranges, and what a
    range brings along is one count a range of the group.
    """
    rows = _dealt(df, group, order)
    counts = rows.groupBy("__range", *group).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    spans = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy("__range", *group).orderBy(*order))
    return _meet(rows, spans, group).withColumn(out, F.col("__before") + local).drop("__range", "__before")


def least_before(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str = "least") -> DataFrame:
    """Adds ``out``: the least ``value`` of the rows before in the group, null for the first; groups as in ``rank_within``."""
    rows = _dealt(df, group, order)
    ends = rows.groupBy("__range", *group).agg(F.min(value).alias("__m"))
    spans = ends.withColumn("__before", F.min("__m").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).drop("__m")
    local = F.min(value).over(Window.partitionBy("__range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return _meet(rows, spans, group).withColumn(out, F.least("__before", local)).drop("__range", "__before")


def median_within(df: DataFrame, group: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """``group, out``: the exact median of the values of each group that aren't null, as ``percentile`` has it.

    A group may hold any share of the rows: equal values are counted together
    and cut into ranges, and what a range brings along is one count a range of
    the group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__k"))
    rows = _dealt(counts, group, [value])
    each = rows.groupBy("__range", *group).agg(F.sum("__k").alias("__n"))
    ahead = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    spans = each.select("__range", *group, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*group)).alias("__all"))
    local = F.sum("__k").over(Window.partitionBy("__range", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = _meet(rows, spans, group).withColumn("__last", F.col("__before") + local)
    # Of n values the places from 1 are the floor of (n + 1) / 2 and that of (n + 2) / 2: one place where n is odd.
    holds = lambda up: ((F.col("__all") + up) / 2).cast("long").between(F.col("__last") - F.col("__k") + 1, F.col("__last"))
    return last.filter(holds(1) | holds(2)).groupBy(*group).agg((F.min(value) * 0.5 + F.max(value) * 0.5).alias(out))
