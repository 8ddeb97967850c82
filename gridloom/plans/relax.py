"""Rounds of offers and minima until nothing gets smaller."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.durable import Rounds


def relax(start: DataFrame, keys: Sequence[str], value: str, offer: Callable[[DataFrame], DataFrame], label: str = "relax", most_rounds: int = 10_000) -> DataFrame:
    """``keys, value``: least value per key that ``start`` and repeated offers give.

    ``offer`` maps the rows that got smaller in the last round to new rows of
    ``keys, value``.  A round is one grouped minimum, combined map side, and
    one write.
    """
    kind = start.schema[value].dataType
    rounds = Rounds(start.sparkSession, label)
    state = rounds.write(start.groupBy(*keys).agg(F.min(value).alias(value)).withColumn("fresh", F.lit(True)))
    for _ in range(most_rounds):
        offered = offer(state.filter("fresh").drop("fresh")).select(*keys, value, F.lit(None).cast(kind).alias("old"))
        both = state.select(*keys, value, F.col(value).alias("old")).unionByName(offered)
        least = both.groupBy(*keys).agg(F.min(value).alias(value), F.min("old").alias("old"))
        marked = least.select(*keys, value, (F.col("old").isNull() | (F.col(value) < F.col("old"))).alias("fresh"))
        state = rounds.write(marked)
        if state.filter("fresh").isEmpty():
            return state.drop("fresh")
    raise RuntimeError(f"no fixpoint within {most_rounds} rounds")
