"""Basins, saddles, persistence and merge trees.

A cell's order is ``(value, raster index)``, a total order.  Its basin is the
minimum that steepest descent over the four neighbours reaches.  Two basins
meet at the least, over touching cells, of the larger value.  By the elder rule
the basin with the higher minimum ends where it meets the older one; its
persistence is the height in between.  Descending regions are those of the
negated raster.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.components import connected_components
from gridloom.operators.graph import label_pairs
from gridloom.operators.raster import cell_id, neighbours
from gridloom.plans.durable import durable
from gridloom.plans.ranking import least_before
from gridloom.plans.relax import relax

SIDE = 1 << 20
#: Cells along the side of a tile within which descent is followed in one task.
TILE = 512
#: Arcs of an item whose merge order is found in one task.
SMALL_ARCS = 100_000


def descent(pixels: DataFrame, value: str = "v", item: str = "z") -> DataFrame:
    """Adds ``id`` and ``to``: the least of the cell and its four neighbours by (value, index)."""
    with_id = pixels.withColumn("id", cell_id(F.col(item), F.col("y"), F.col("x"), SIDE))
    near = neighbours(with_id, value, (item,))
    steps = {"left": -1, "right": 1, "up": -SIDE, "down": SIDE}
    options = [F.struct(F.col(value).alias("v"), F.col("id").alias("i")), *[F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("v"), (F.col("id") + d).alias("i"))) for n, d in steps.items()]]
    return near.withColumn("to", F.least(*options)["i"]).drop(*steps)


def jump_to_roots(pointers: DataFrame, node: str = "id", to: str = "to", most_rounds: int = 64) -> DataFrame:
    """Pointer jumping: ``node, root``; the rounds double the distance, so there are few."""
    now = durable(pointers.select(F.col(node).alias("node"), F.col(to).alias("root")), "jump")
    for _ in range(most_rounds):
        nxt = durable(now.alias("a").join(now.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select("node", F.coalesce("further", "root").alias("root")), "jump")
        moved = nxt.join(now, ["node", "root"], "left_anti")
        if moved.isEmpty():
            return nxt
        now = nxt
    raise RuntimeError("the pointers have a cycle")


def _within_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Adds where each cell's descent ends or leaves the tile (``root``), and which of the two it is (``ends``)."""
    pdf = pdf.sort_values("id", ignore_index=True)
    ids, to = pdf["id"].to_numpy(), pdf["to"].to_numpy()
    at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
    step = np.where(ids[at] == to, at, np.arange(len(ids)))
    while not np.array_equal(further := step[step], step):
        step = further
    return pdf.assign(root=to[step], ends=ids[step] == to[step])


def basins(pixels: DataFrame, value: str = "v", item: str = "z", tile: int = TILE) -> DataFrame:
    """Adds ``basin``: the raster index within the item of the minimum that a cell drains to.

    Descent is followed within tiles first.  What leaves a tile enters another
    at one of its border cells; those alone are chased over all tiles, and only
    the cells that left are joined with what was found.  Any tile size gives the
    same basins.
    """
    pointed = descent(pixels, value, item).select("*", F.floor(F.col("y") / tile).cast("long").alias("__ty"), F.floor(F.col("x") / tile).cast("long").alias("__tx"))
    schema = T.StructType([*pointed.schema.fields, T.StructField("root", T.LongType()), T.StructField("ends", T.BooleanType())])
    local = durable(pointed.groupBy(item, "__ty", "__tx").applyInPandas(_within_tile, schema).drop("__ty", "__tx", "to"), "basin-tiles")
    entered = local.filter("NOT ends").select(F.col("root").alias("id")).distinct()
    border = jump_to_roots(local.join(entered, "id", "left_semi").select("id", "root"), "id", "root")
    left = local.filter("NOT ends").join(border.select(F.col("node").alias("root"), F.col("root").alias("__root")), "root").withColumn("root", F.col("__root"))
    return local.filter("ends").unionByName(left.drop("__root")).withColumn("basin", F.col("root") % (SIDE * SIDE)).drop("id", "ends", "root")


def basin_table(labelled: DataFrame, value: str = "v", item: str = "z") -> DataFrame:
    """``item, basin, area, low``."""
    return labelled.groupBy(item, "basin").agg(F.count("*").alias("area"), F.min(value).alias("low"), F.sum(value).alias("sum_base"))


def basin_arcs(labelled: DataFrame, value: str = "v", item: str = "z") -> DataFrame:
    """``item, a, b, saddle, cnt``."""
    return label_pairs(labelled, item, "basin", value).groupBy(item, "a", "b").agg(F.min("w").alias("saddle"), F.count("*").alias("cnt"))


def merge_order(nodes: list[tuple[int, float]], arcs: list[tuple[float, int, int]]) -> list[tuple[int, int, float, float]]:
    """``(node, into, height, persistence)`` of every basin that ends, in order of the saddles.

    The younger minimum, by (value, id), ends; ties of a saddle go by its ends.
    """
    low, parent, ends = dict(nodes), {n: n for n, _ in nodes}, []

    def find(n: int) -> int:
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for saddle, a, b in sorted(arcs):
        a, b = find(a), find(b)
        if a != b:
            old, young = sorted((a, b), key=lambda n: (low[n], n))
            parent[young] = old
            ends.append((young, old, saddle, saddle - low[young]))
    return ends


def _in_one_task(table: DataFrame, arcs: DataFrame, item: str) -> DataFrame:
    """``item, basin, into, height, persistence`` of items whose arcs fit a task, by Kruskal's order."""
    both = table.select(item, F.lit(0).alias("kind"), F.col("low").cast("double").alias("w"), F.col("basin").alias("a"), F.lit(0).cast("long").alias("b")).union(
        arcs.select(item, F.lit(1), F.col("saddle").cast("double"), "a", "b")
    )
    kind = table.schema[item].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, e = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
        rows = merge_order(list(zip(n["a"].tolist(), n["w"].tolist())), list(zip(e["w"].tolist(), e["a"].tolist(), e["b"].tolist())))
        out = pd.DataFrame(rows, columns=["basin", "into", "height", "persistence"]).astype({"basin": "int64", "into": "int64", "height": "float64", "persistence": "float64"})
        out.insert(0, item, pdf[item].iloc[0])
        return out

    return both.groupBy(item).applyInPandas(solve, f"{item} {kind}, basin long, into long, height double, persistence double")


def _by_contraction(table: DataFrame, arcs: DataFrame, item: str, scale: int = SIDE * SIDE, most_rounds: int = 64) -> DataFrame:
    """The same in rounds over all items at once, whatever the size of one.

    Each basin picks its lowest arc; the picks form trees (Boruvka).  A tree's
    arcs below the lowest that leaves it are merged before anything else
    touches them, and each adds a single basin to the tree's core, in order of
    the arcs.  So the one that ends at each arc is the younger of the newcomer
    and the oldest so far: a running minimum over the tree.  Cores shrink to
    their oldest basin.  As the arc that leaves a core is then its lowest, cores
    halve from round to round.
    """
    gid = lambda c: (F.col(item).cast("long") * scale + F.col(c)).alias(c)
    lows = durable(table.select(gid("basin"), F.col("low").cast("double").alias("low")), "merge-lows")
    low = lambda x: lows.select(F.col("basin").alias(x), F.col("low").alias(f"low_{x}"))
    now = arcs.select(F.struct(F.col("saddle").cast("double").alias("saddle"), gid("a").alias("a0"), gid("b").alias("b0")).alias("key"), gid("a"), gid("b")).filter("a <> b")
    now = durable(now.join(low("a"), "a").join(low("b"), "b").select("key", "a", "low_a", "b", "low_b"), "merge-arcs")
    ends = []
    for _ in range(most_rounds):
        if now.isEmpty():
            break
        ways = now.select("key", F.col("a").alias("x"), F.col("low_a").alias("low"), F.col("b").alias("y")).union(now.select("key", "b", "low_b", "a"))
        picks = durable(ways.groupBy("x", "low").agg(F.min(F.struct("key", "y")).alias("pick")).select("x", "low", "pick.*"), "merge-picks")
        trees = durable(connected_components(picks.select(F.col("x").alias("u"), F.col("y").alias("v"))), "merge-trees")
        tree = lambda x: trees.select(F.col("node").alias(x), F.col("component").alias(f"tree_{x}"))  # noqa: E731,B023
        leaving = now.join(tree("a"), "a").join(tree("b"), "b").filter("tree_a <> tree_b")
        first = leaving.select("key", F.explode(F.array("tree_a", "tree_b")).alias("tree")).groupBy("tree").agg(F.min("key").alias("out"))
        core = picks.join(tree("x").withColumnRenamed("tree_x", "tree"), "x").join(first, "tree", "left").filter("out IS NULL OR key < out")
        core = durable(core.select("tree", "key", F.struct("low", "x").alias("age")), "merge-core")
        met = least_before(core, ["tree"], ["key", "age"], "age", "oldest").filter("oldest IS NOT NULL")
        young, old = F.greatest("age", "oldest"), F.least("age", "oldest")
        ends.append(durable(met.select(young["x"].alias("basin"), old["x"].alias("into"), F.col("key.saddle").alias("height"), (F.col("key.saddle") - young["low"]).alias("persistence")), "merge-ends"))
        oldest = core.groupBy("tree").agg(F.min("age").alias("to"))
        moved = durable(core.join(oldest, "tree").select(F.col("age.x").alias("x"), "to"), "merge-moved")
        to = lambda x: moved.select(F.col("x").alias(x), F.col("to").alias(f"to_{x}"))  # noqa: E731,B023
        held = now.join(to("a"), "a", "left").join(to("b"), "b", "left").select(
            "key", *[c.alias(n) for x in "ab" for n, c in ((x, F.coalesce(F.col(f"to_{x}.x"), F.col(x))), (f"low_{x}", F.coalesce(F.col(f"to_{x}.low"), F.col(f"low_{x}"))))]
        )
        # Of arcs between the same two, the lowest alone can merge them.
        side = {x: F.struct(F.col(x).alias("x"), F.col(f"low_{x}").alias("low")) for x in "ab"}
        pair = held.filter("a <> b").groupBy(F.least(*side.values()).alias("p"), F.greatest(*side.values()).alias("q")).agg(F.min("key").alias("key"))
        now = durable(pair.select("key", F.col("p.x").alias("a"), F.col("p.low").alias("low_a"), F.col("q.x").alias("b"), F.col("q.low").alias("low_b")), "merge-arcs")
    else:
        raise RuntimeError(f"arcs are left after {most_rounds} rounds")
    kind = table.schema[item].dataType
    if not ends:
        return table.select(item, "basin", F.lit(None).cast("long").alias("into"), F.lit(None).cast("double").alias("height"), F.lit(None).cast("double").alias("persistence")).limit(0)
    return reduce(DataFrame.union, ends).select(F.floor(F.col("basin") / scale).cast(kind).alias(item), F.pmod("basin", F.lit(scale)).alias("basin"), F.pmod("into", F.lit(scale)).alias("into"), "height", "persistence")


def persistence(table: DataFrame, arcs: DataFrame, item: str = "z", small: int = SMALL_ARCS, scale: int = SIDE * SIDE) -> DataFrame:
    """``item, basin, into, height, persistence``; null where a basin never ends.

    Items of up to ``small`` arcs are solved in one task each, larger ones by
    contraction over all tasks; both give the same rows.  Basins are below ``scale``.
    """
    sizes = durable(arcs.groupBy(item).agg(F.count("*").alias("n")), "merge-sizes")
    large = sizes.filter(F.col("n") > small).select(item)
    if large.isEmpty():
        ended = _in_one_task(table, arcs, item)
    else:
        parts = [[t.join(large, item, how) for t in (table, arcs)] for how in ("left_anti", "left_semi")]
        ended = _in_one_task(*parts[0], item).unionByName(_by_contraction(*parts[1], item, scale))
    return table.select(item, "basin").join(ended, [item, "basin"], "left")


def threshold(values: DataFrame, absolute: float | None = None, percent: float | None = None, value: str = "v") -> float:
    """Absolute wins; else a percentage of the value range; else 0."""
    if absolute is not None:
        return float(absolute)
    if percent is None:
        return 0.0
    low, high = values.agg(F.min(value), F.max(value)).first()
    return float((high - low) * percent / 100) if low is not None else 0.0


def living(deaths: DataFrame, least: float, item: str = "z") -> DataFrame:
    """``item, basin, living``: where each basin belongs once all below ``least`` have ended."""
    to = F.when(F.col("persistence") < least, F.col("into")).otherwise(F.col("basin"))
    scale = SIDE * SIDE
    pointed = deaths.select(item, "basin", (F.col(item).cast("long") * scale + F.col("basin")).alias("id"), (F.col(item).cast("long") * scale + to).alias("to"))
    roots = jump_to_roots(pointed)
    return pointed.join(roots.withColumnRenamed("node", "id"), "id").select(item, "basin", (F.col("root") % scale).alias("living"))


def roll_up(table: DataFrame, alive: DataFrame, item: str = "z") -> DataFrame:
    """Areas and sums of the living regions; the minimum of each is the survivor's own."""
    return (
        table.join(alive, [item, "basin"]).groupBy(item, "living").agg(F.sum("area").alias("area"), F.sum("sum_base").alias("sum_base"), F.min("low").alias("low"), F.count("*").alias("n_base"))
    )


def sweep(deaths: DataFrame, levels: list[float], item: str = "z") -> DataFrame:
    """Living regions per item and persistence level."""
    alive = [F.count_if(F.col("persistence").isNull() | (F.col("persistence") >= t)).alias(f"n_{k}") for k, t in enumerate(levels)]
    return deaths.groupBy(item).agg(*alive)


def cut_tree(deaths: DataFrame, table: DataFrame, least: float, beyond: float, item: str = "z") -> DataFrame:
    """Survivors of a cut: persistence of ``least`` or more and a minimum at or below ``beyond``, numbered by id."""
    both = deaths.join(table, [item, "basin"])
    kept = both.filter((F.col("persistence").isNull() | (F.col("persistence") >= least)) & (F.col("low") <= beyond))
    return kept.withColumn("region", F.row_number().over(Window.partitionBy(item).orderBy("basin")))


def absorb(seeds: DataFrame, arcs: DataFrame, item: str = "z", most_rounds: int = 10_000) -> DataFrame:
    """``item, node, owner, cost``: every region goes to the seed that it meets lowest.

    The cost of a path is its largest saddle; ties go to the smaller owner.
    """
    from gridloom.operators.graph import both_ways

    used = durable(both_ways(arcs, (item,), "saddle"), "absorb-arcs")

    def offer(front: DataFrame) -> DataFrame:
        met = front.select(item, F.col("node").alias("src"), "k").join(used, [item, "src"])
        return met.select(item, F.col("dst").alias("node"), F.struct(F.greatest("k.cost", F.col("saddle").cast("double")).alias("cost"), F.col("k.owner").alias("owner")).alias("k"))

    start = seeds.select(item, "node", F.struct(F.lit(float("-inf")).alias("cost"), F.col("node").alias("owner")).alias("k"))
    return relax(start, [item, "node"], "k", offer, "absorb", most_rounds).select(item, "node", "k.owner", "k.cost")


def tree_document(deaths: DataFrame, table: DataFrame, item: str = "z") -> DataFrame:
    """One JSON merge tree an item: leaves with their minimum, area, parent and height."""
    leaf = F.struct("basin", "low", "area", "into", "height")
    rows = deaths.join(table, [item, "basin"])
    return rows.groupBy(item).agg(F.to_json(F.struct(F.array_sort(F.collect_list(leaf)).alias("nodes"))).alias("tree"))
