"""Raster, region and graph views over the star-schema tables.

The operators take any table with grid coordinates; these views give the
registered queries one.  ``VIEWS`` is the same in SQL, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``z, y, x, v, g, b, n``: seven slices of 32 by 32 cells."""
    cell = lambda e: F.expr(e).cast("int")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(cell("l_linenumber - 1").alias("z"), cell("l_orderkey % 32").alias("y"), cell("l_partkey % 32").alias("x"))
        .agg(
            F.sum("l_quantity").alias("v"),
            F.sum(F.round(F.col("l_quantity") * (1 - F.col("l_discount")) * 100)).alias("g"),
            F.sum(F.round(F.col("l_tax") * 100)).alias("b"),
            F.count("*").alias("n"),
        )
    )


def lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``px`` with block labels; -1 is background."""
    return px(spark, sf_dir).withColumn("label", F.expr("CASE WHEN v % 5 = 0 THEN -1 ELSE cast((y div 4) * 8 + x div 4 AS int) END"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``px`` with block labels and no background."""
    return px(spark, sf_dir).withColumn("label", F.expr("cast((y div 4) * 8 + x div 4 AS int)"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of ``px`` whose value isn't divisible by 3 or 2."""
    return px(spark, sf_dir).filter("v % 3 <> 0 AND v % 2 <> 0").select("z", "y", "x", "v")


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``z, a, b, saddle, length`` between touching blocks of a slice."""
    from gridloom.operators.graph import contact_arcs

    return contact_arcs(blocks(spark, sf_dir), "z", "label", "v")


VIEWS = """
px AS (
  SELECT (l_linenumber - 1)::INT AS z, (l_orderkey % 32)::INT AS y, (l_partkey % 32)::INT AS x, sum(l_quantity) AS v,
         sum(round(l_quantity * (1 - l_discount) * 100)) AS g, sum(round(l_tax * 100)) AS b, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3
), lab AS (
  SELECT *, CASE WHEN v % 5 = 0 THEN -1 ELSE ((y // 4) * 8 + x // 4)::INT END AS label FROM px
), blocks AS (
  SELECT *, ((y // 4) * 8 + x // 4)::INT AS label FROM px
), mask AS (
  SELECT z, y, x, v FROM px WHERE v % 3 <> 0 AND v % 2 <> 0
), touching AS (
  SELECT p.z, least(p.label, q.label) AS a, greatest(p.label, q.label) AS b, greatest(p.v, q.v) AS w
  FROM blocks p JOIN blocks q ON q.z = p.z AND ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1)) WHERE p.label <> q.label
), arcs AS (
  SELECT z, a, b, min(w) AS saddle, count(*) AS length FROM touching GROUP BY z, a, b
), regions AS (
  SELECT z, label, count(*) AS area, sum(v) AS s, sum(v * v) AS ss, min(v) AS lo, max(v) AS hi, sum(v) / count(*) AS mean_v, sum(g) / count(*) AS mean_g, sum(b) AS sb, sum(n) AS sn FROM blocks GROUP BY z, label
)"""


def sql(body: str) -> str:
    """``body`` (further CTEs and the final SELECT) over the views."""
    return f"WITH RECURSIVE {VIEWS}{', ' if not body.lstrip().upper().startswith('SELECT') else ' '}{body}"
