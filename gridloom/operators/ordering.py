"""Ranks, runs and spaced selections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.durable import Rounds, durable
from gridloom.plans.ranking import global_rank, rank_within


def natural_key(name: Column, digits: int = 20) -> Column:
    """Sort key in which runs of digits compare as numbers, without regard to case."""
    tokens = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]"), F.lpad(F.regexp_replace(t, "^0+(?=[0-9])", ""), digits, "0")).otherwise(t)), "")


def strided(df: DataFrame, order: Sequence[Column | str], start: int = 0, stride: int = 1, count: int | None = None) -> DataFrame:
    """Every ``stride``-th row from ``start`` of an order, at most ``count`` of them.

    Positions are ranks within ranges of the order, so no task holds all rows.
    """
    keys = {f"__o{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order)}
    ranked = global_rank(df.withColumns(keys), *keys, out="position").drop(*keys)
    kept = ranked.withColumn("position", F.col("position") - 1).filter((F.col("position") >= start) & ((F.col("position") - start) % stride == 0))
    kept = kept.withColumn("position", ((F.col("position") - start) / stride).cast("int"))
    return kept if count is None else kept.filter(F.col("position") < count)


def first_seen(df: DataFrame, key: str, order: str, by: Sequence[str] = (), out: str = "dense_id") -> DataFrame:
    """Numbers groups from 0 by the smallest ``order`` of each."""
    ranks = df.groupBy(*by, key).agg(F.min(order).alias("__first"))
    w = Window.partitionBy(*by).orderBy("__first")
    return df.join(ranks.select(*by, key, (F.dense_rank().over(w) - 1).alias(out)), [*by, key])


def runs(df: DataFrame, index: str, by: Sequence[str] = ()) -> DataFrame:
    """Contiguous runs of an integer index: ``by, start, stop, n``; repeated indices count once."""
    w = Window.partitionBy(*by).orderBy(index)
    one = df.select(*by, index).distinct().withColumn("__g", F.col(index) - F.row_number().over(w))
    return one.groupBy(*by, "__g").agg(F.min(index).alias("start"), F.max(index).alias("stop"), F.count("*").alias("n")).drop("__g")


def compressed_axis(df: DataFrame, index: str, by: Sequence[str] = (), gap: int = 2) -> DataFrame:
    """Plot positions: one step a row, ``gap`` more between runs."""
    w = Window.partitionBy(*by).orderBy(index)
    broke = F.when(F.col(index) - F.lag(index).over(w) > 1, 1).otherwise(0)
    blocks = df.select(*by, index).distinct().withColumn("__b", broke).withColumn("block", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return blocks.select(*by, index, "block", (F.row_number().over(w) - 1 + gap * F.col("block")).alias("position"))


def score_ranked(df: DataFrame, score: str, ident: str, least_area: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Candidates of at least the area, best score first, ties by id."""
    return df.filter(F.col("area") >= least_area).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), ident)))


#: Candidates of an item among which one task chooses.
SMALL_ITEM = 100_000


def _spaced_in_one_task(df: DataFrame, distance: float, item: str) -> DataFrame:
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[float, float]] = []
        rows = []
        for r in pdf.sort_values("rank").itertuples(index=False):
            if all((r.ext_y - y) ** 2 + (r.ext_x - x) ** 2 >= distance**2 for y, x in taken):
                taken.append((r.ext_y, r.ext_x))
                rows.append((getattr(r, item), r.label, r.rank))
        return pd.DataFrame(rows, columns=[item, "label", "rank"]).astype({item: "int32", "label": "int32", "rank": "int64"})

    return df.groupBy(item).applyInPandas(choose, f"{item} int, label int, rank long")


def _spaced_by_rounds(df: DataFrame, distance: float, item: str, most_rounds: int = 10_000) -> DataFrame:
    """Rounds of local winners on a grid of cells as wide as the distance.

    The best that is left among a cell and its eight neighbours has no better
    one within reach, so it stays, and what lies within reach of it goes.  A cell
    has at most one winner a round, so no row meets more than nine.
    """
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    around = lambda rows: rows.withColumn("s", step).withColumns({"cy": F.col("cy") + F.col("s.a"), "cx": F.col("cx") + F.col("s.b")}).drop("s")
    rounds, chosen = Rounds(df.sparkSession, "spaced"), []
    left = rounds.write(df.withColumns({"cy": F.floor(F.col("ext_y") / distance).cast("long"), "cx": F.floor(F.col("ext_x") / distance).cast("long")}))
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        best = around(left.groupBy(item, "cy", "cx").agg(F.min("rank").alias("best"))).groupBy(item, "cy", "cx").agg(F.min("best").alias("best"))
        won = durable(left.join(best, [item, "cy", "cx"]).filter("rank = best").drop("best"), "spaced-won")
        chosen.append(won.select(item, "label", "rank"))
        reach = around(won.select(item, "cy", "cx", F.col("ext_y").alias("wy"), F.col("ext_x").alias("wx"), F.lit(True).alias("won")))
        near = left.join(reach, [item, "cy", "cx"]).filter((F.col("ext_y") - F.col("wy")) ** 2 + (F.col("ext_x") - F.col("wx")) ** 2 < distance**2)
        gone = near.select(item, "rank").union(won.select(item, "rank")).distinct()
        left = rounds.write(left.join(gone, [item, "rank"], "left_anti"))
    else:
        raise RuntimeError(f"candidates are left after {most_rounds} rounds")
    return reduce(DataFrame.union, chosen) if chosen else df.select(item, "label", "rank")


def spaced(df: DataFrame, distance: float, most: int, item: str = "z", small: int = SMALL_ITEM) -> DataFrame:
    """``item, label, pick``: the best ``most`` candidates that keep the distance from all better ones, per item.

    ``df`` has ``item, label, rank, ext_y, ext_x`` with ranks that tell the
    candidates of an item apart.  Items of up to ``small`` candidates are chosen
    from in one task each, larger ones in rounds; both choose the same.
    """
    rows = df.select(item, F.col("label").cast("int").alias("label"), F.col("rank").cast("long").alias("rank"), F.col("ext_y").cast("double").alias("ext_y"), F.col("ext_x").cast("double").alias("ext_x"))
    large = durable(rows.groupBy(item).agg(F.count("*").alias("n")).filter(F.col("n") > small).select(item), "spaced-large")
    if large.isEmpty():
        kept = _spaced_in_one_task(rows, distance, item)
    else:
        kept = _spaced_in_one_task(rows.join(large, item, "left_anti"), distance, item).union(_spaced_by_rounds(rows.join(large, item, "left_semi"), distance, item))
    return rank_within(kept, [item], ["rank"], "pick").filter(F.col("pick") <= most).select(item, "label", F.col("pick").cast("int").alias("pick"))
