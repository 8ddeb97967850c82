"""Connected components by alternating large-star and small-star rounds.

Each round only ever takes a minimum per node (combined map side) and joins it
back, so a hub with very many neighbours never has to fit one task: AQE may
split the join.  Before the first round every task replaces its edges by a
forest.  The rounds stop when the edge set is a forest of stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.durable import Rounds


#: Edges that a task takes up before it passes on their forest.
CHUNK = 1 << 19


def local_forests(edges: DataFrame) -> DataFrame:
    """Edges from every node to the least of its component among the edges of one chunk of a task.

    They join what the edges join.  Where neighbours lie in one task, little
    but the borders between tasks is left to the rounds.
    """

    def forest(parent: dict[int, int]) -> pd.DataFrame:
        for a in sorted(parent):
            parent[a] = parent[parent[a]]  # a parent is smaller, so it is settled already
        out = pd.DataFrame({"u": list(parent.keys()), "v": list(parent.values())}, dtype="int64")
        return out[out["u"] != out["v"]]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}
        seen = 0
        for pdf in batches:
            for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
                while (p := parent.setdefault(a, a)) != a:
                    parent[a] = a = parent[p]
                while (p := parent.setdefault(b, b)) != b:
                    parent[b] = b = parent[p]
                if a > b:
                    parent[a] = b
                elif b > a:
                    parent[b] = a
            seen += len(pdf)
            if seen >= CHUNK:
                yield forest(parent)
                parent, seen = {}, 0
        yield forest(parent)

    return edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).mapInPandas(solve, "u long, v long")


def _written(edges: DataFrame, rounds: Rounds) -> tuple[DataFrame, tuple[int, int]]:
    """The edges on disk, and their number and a sum of hashes."""
    out = rounds.write(edges)
    hashes = F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))
    n, h = out.agg(F.count(F.lit(1)), F.sum(hashes)).first()
    return out, (int(n), int(h or 0))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hops = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hops.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node.

    ``component`` is the smallest node id reachable.  Self loops and repeated
    edges are ignored; edges with a null end are ignored.  Nodes without edges
    don't appear: the caller takes the node itself for them.
    """
    rounds = Rounds(edges.sparkSession, "cc-round")
    given = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    current, seen = _written(local_forests(given).distinct(), rounds)
    if seen[0]:
        for _ in range(max_rounds):
            current, now = _written(_small_star(_large_star(current)), rounds)
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"no fixpoint within {max_rounds} rounds")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(members.select("component", "component").distinct())
