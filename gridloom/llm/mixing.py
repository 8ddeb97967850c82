"""Mixing sources to target weights by fitting a subset-sum budget.

Documents are counted by source and exact size.  Each source gets whole epochs
and a remaining budget; the budget is spread over the sizes in proportion, and
a bounded-knapsack dynamic programme over the leftover counts fits what is left
exactly, or as nearly as the sizes allow.  Only counts by size ever meet in one
place.  Which documents of a size are taken follows from a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.durable import durable
from gridloom.plans.ranking import rank_within

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Sizes with which a remaining budget is fitted first.
SMALL = 1 << 12
#: Seeded shards that a size of a source is cut into; ranks are only ever taken within one.
SHARDS = 512


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row a source.

    A target is the smaller of ``most`` times the source and ``rate`` times its
    weight, for the one rate at which the targets add up to the budget: what is
    cut off is reshared by weight until none is above.  Sources by code point,
    null last, weigh ``weights`` in turn.  One row a source meets in one place.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)))
    cap = F.col("source_size") * F.lit(float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rated = (
        ranked.withColumn("cap", cap)
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("rate", (F.col("budget") - F.col("capped")) / F.col("open_w"))
    )
    # The first source, by cap a weight, that its rate doesn't lift over its cap sets the rate of all.
    settled = rated.withColumn("settled", F.min_by("rate", F.when(F.col("rate") * F.col("w") <= F.col("cap"), F.col("cap") / F.col("w"))).over(everything))
    return settled.select("source", "source_size", F.least("cap", F.coalesce(F.col("settled") * F.col("w"), F.col("cap"))).alias("target"))


def _knapsack(size: list[int], left: list[int], rest: int) -> tuple[list[int], int]:
    """Counts of each size, at most ``left``, whose sum is the nearest to ``rest``, and how far it is off.

    Bit ``b`` of ``reach`` is set if the sizes so far reach ``b``, and
    ``first[b]`` is the item that reached it.  It looks past ``rest`` by the
    largest size, for the nearest sum may lie above, and ends once ``rest`` is
    reached.  Sizes are ascending: the small ones come first.
    """
    take = [0] * len(size)
    top = rest + (size[-1] if size else 0)
    mask, reach = (1 << (top + 1)) - 1, 1
    items: list[tuple[int, int]] = []
    first = np.full(top + 1, -1, dtype=np.int32)
    for k, (s, c) in enumerate(zip(size, left)):
        c, step = min(c, top // s), 1
        while c > 0 and not reach >> rest & 1:
            many = min(step, c)
            new = (reach << (s * many)) & mask & ~reach
            raw = np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8)
            for at in range(0, len(raw), 1 << 20):
                bits = np.flatnonzero(np.unpackbits(raw[at : at + (1 << 20)], bitorder="little"))
                first[bits + 8 * at] = len(items)
            reach |= new
            items.append((k, many))
            c -= many
            step *= 2
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    beyond = reach >> (rest + 1)
    above = rest + 1 + ((beyond & -beyond).bit_length() - 1) if beyond else None
    at = reached = below if above is None or rest - below <= above - rest else above
    while at > 0:
        k, many = items[first[at]]
        take[k] += many
        at -= size[k] * many
    return take, abs(reached - rest)


def _spread(size: list[int], have: list[int], budget: int) -> list[int]:
    """Counts in proportion to ``have`` whose sum is at most ``budget``."""
    total, carry = sum(s * c for s, c in zip(size, have)), 0  # the carry is in units of size / total, so that all is exact
    take = [0] * len(size)
    for k, (s, c) in enumerate(zip(size, have)):
        carry += s * c * budget
        take[k] = min(c, carry // (s * total))
        carry -= take[k] * s * total
    return take


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, small: int = SMALL) -> np.ndarray:
    """How many documents of each size to take so that the sizes add up to ``budget``, or to the nearest sum.

    ``lengths`` are distinct and positive.  Nearly all of the budget is spread
    in proportion to the counts; what remains is a bounded knapsack over what is
    left of each size.  It is tried with the sizes of up to ``small`` alone
    first, once larger ones have their share; only where that isn't exact, all
    sizes take part and the table is as long as three of the largest size.
    """
    order = np.argsort(lengths)
    unit = int(np.gcd.reduce(lengths)) if len(lengths) else 1
    size, have = [int(x) // unit for x in lengths[order]], [int(x) for x in counts[order]]
    total = sum(s * c for s, c in zip(size, have))
    goal = max(0, min(round(int(budget) / unit), total))
    out = np.zeros(len(lengths), dtype=np.int64)
    if not goal:
        return out
    if goal == total:
        return counts.astype(np.int64)
    off, few = 1, sum(s <= small for s in size)
    if few:
        # Sizes beyond the small ones, from the largest: their share of the goal, as far as the smaller ones can fill the rest.
        take, rest, below = [0] * len(size), goal, total
        for k in reversed(range(few, len(size))):
            share, below = (2 * have[k] * rest + below) // (2 * below), below - size[k] * have[k]
            take[k] = min(have[k], rest // size[k], max(share, -((below - rest) // size[k])))
            rest -= size[k] * take[k]
        if rest <= below:
            take[:few] = _spread(size[:few], have[:few], max(0, rest - 2 * size[few - 1]))
            rest -= sum(s * t for s, t in zip(size[:few], take))
            fitted, off = _knapsack(size[:few], [h - t for h, t in zip(have, take[:few])], rest)
            take = [t + n for t, n in zip(take, fitted)] + take[few:]
    if off:
        take = _spread(size, have, max(0, goal - 2 * size[-1]))
        fitted, _ = _knapsack(size, [h - t for h, t in zip(have, take)], goal - sum(s * t for s, t in zip(size, take)))
        take = [t + n for t, n in zip(take, fitted)]
    out[order] = take
    return out


def plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts by size of one source to whole epochs and documents of each size that get one more."""
    n, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    goal = round(target)
    epochs = min(goal // n, MAX_EPOCHS) if n else 0
    rows = pdf[pdf["size"] > 0]
    extra = fit_counts(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), goal - epochs * n if epochs < MAX_EPOCHS else 0)
    out = rows[["source", "size"]].assign(epochs=epochs, extra=extra)
    return out.astype({"epochs": "int64", "extra": "int64"})


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every input row.

    ``taken`` is a multiple of ``size`` (at most three times): whole epochs of
    the source, and one more for the documents that the fit selects.  Null and
    empty texts have size 0 and take nothing.  Rows of equal id and size are
    alike, so any of them make up the planned number.  Null is a
    source of its own, the last.  No rows: no rows.
    """
    h = F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h")
    base = durable(
        docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(F.col(text)).alias("size"))
        .select("*", h, F.pmod(h, F.lit(shards)).cast("int").alias("shard"), F.monotonically_increasing_id().alias("row")),
        "mix-sizes",
    )
    by_shard = durable(base.groupBy("source", "size", "shard").agg(F.count("*").alias("n")), "mix-counts")
    by_size = by_shard.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = durable(targets(totals, weights, share), "mix-targets")
    same = lambda a, b, *more: [F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")), *[F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in more]]
    planned = (
        by_size.alias("s").join(goals.alias("g"), same("s", "g"))
        .select("s.source", "s.size", "s.n", "g.source_size", "g.target")
        .groupBy("source").applyInPandas(plan_source, "source string, size long, epochs long, extra long")
    )
    # A shard of a size is taken whole, not at all, or up to a rank.
    running = Window.partitionBy("s.source", "s.size").orderBy("s.shard").rowsBetween(Window.unboundedPreceding, -1)
    cuts = durable(
        by_shard.alias("s").join(planned.alias("p"), same("s", "p", "size"))
        .select("s.source", "s.size", "s.shard", "s.n", "p.epochs", (F.col("p.extra") - F.coalesce(F.sum("s.n").over(running), F.lit(0))).alias("open")),
        "mix-cuts",
    )
    placed = base.alias("b").join(cuts.alias("c"), same("b", "c", "size", "shard"), "left").select(
        "b.*", F.coalesce("c.epochs", F.lit(0)).alias("epochs"), F.coalesce("c.n", F.lit(0)).alias("n"), F.greatest(F.coalesce("c.open", F.lit(0)), F.lit(0)).alias("open")
    )
    split = (F.col("open") > 0) & (F.col("open") < F.col("n"))
    # All rows of one id share a shard, and may be very many: their ranks are taken in ranges.
    ranked = rank_within(placed.filter(split), ["source", "size", "shard"], ["h", "doc_id", "row"]).withColumn("more", (F.col("rank") <= F.col("open")).cast("long")).drop("rank")
    chosen = placed.filter(~split).withColumn("more", (F.col("open") > 0).cast("long")).unionByName(ranked)
    return chosen.alias("c").join(goals.alias("g"), same("c", "g")).select(
        "c.doc_id", "c.size", "g.source_size", "g.target", (F.col("c.size") * (F.col("c.epochs") + F.col("c.more"))).alias("taken")
    )
