"""Region graphs: arcs, neighbourhood statistics, floods and votes.

Arcs are unordered pairs ``a < b`` within an item (a slice, a slide).  All
traversals are rounds of joins and grouped minima that stop at a fixpoint.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.raster import AXES
from gridloom.plans.durable import durable
from gridloom.plans.ranking import median_within
from gridloom.plans.relax import relax


def label_pairs(pixels: DataFrame, item: str, label: str, value: str) -> DataFrame:
    """``item, a, b, w`` per touching pixel pair of different labels; w is the larger value."""
    parts = []
    for axis in ("x", "y"):
        across, along = AXES[axis]
        w = Window.partitionBy(item, across).orderBy(along)
        nxt = pixels.select(item, label, value, along, across).select(
            item, F.col(label).alias("p"), F.col(value).alias("pv"), along, F.lead(along).over(w).alias("__at"), F.lead(label).over(w).alias("q"), F.lead(value).over(w).alias("qv")
        )
        parts.append(nxt.filter((F.col("__at") == F.col(along) + 1) & (F.col("p") != F.col("q"))))
    both = reduce(lambda l, r: l.unionByName(r), (p.select(item, "p", "q", "pv", "qv") for p in parts))
    return both.select(item, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.greatest("pv", "qv").alias("w"))


def contact_arcs(pixels: DataFrame, item: str = "z", label: str = "label", value: str = "v") -> DataFrame:
    """``item, a, b, saddle, length``: one row a touching pair of regions."""
    return label_pairs(pixels, item, label, value).groupBy(item, "a", "b").agg(F.min("w").alias("saddle"), F.count("*").alias("length"))


def unique_arcs(arcs: DataFrame, by: Sequence[str] = ("z",), extreme: str = "min") -> DataFrame:
    """Repeated unordered pairs to one, with their count and extreme saddle; self loops go."""
    pick = {"min": F.min, "max": F.max}[extreme]
    return (
        arcs.filter("a <> b").groupBy(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(pick("saddle").alias("saddle"), F.count("*").alias("cnt"))
    )


def both_ways(arcs: DataFrame, by: Sequence[str], *more: str) -> DataFrame:
    """Every arc from either end: ``by, src, dst``."""
    return arcs.select(*by, F.col("a").alias("src"), F.col("b").alias("dst"), *more).union(arcs.select(*by, F.col("b").alias("src"), F.col("a").alias("dst"), *more))


def attach(arcs: DataFrame, table: DataFrame, columns: Sequence[str], by: Sequence[str] = ("z",), ident: str = "label") -> DataFrame:
    """Columns of both ends as ``<c>_a, <c>_b``; arcs with an unknown end are dropped."""
    side = lambda s: table.select(*by, F.col(ident).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return arcs.join(side("a"), [*by, "a"]).join(side("b"), [*by, "b"])


def reachable(arcs: DataFrame, seeds: DataFrame, least: float | None = None, by: Sequence[str] = ("z",), weight: str = "saddle", most_rounds: int = 10_000) -> DataFrame:
    """``by, node, hops`` from ``seeds(by, node)`` over arcs of at least the weight."""
    used = durable(both_ways(arcs if least is None else arcs.filter(F.col(weight) >= least), by).distinct(), "reach-arcs")

    def offer(front: DataFrame) -> DataFrame:
        met = front.select(*by, F.col("node").alias("src"), "hops").join(used, [*by, "src"])
        return met.select(*by, F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops"))

    return relax(seeds.select(*by, "node", F.lit(0).alias("hops")), [*by, "node"], "hops", offer, "reach", most_rounds)


def join_costs(arcs: DataFrame, seeds: DataFrame, by: Sequence[str] = ("z",), weight: str = "saddle", gain: float = 1.0, most_rounds: int = 10_000) -> DataFrame:
    """``by, node, cost``: least over all paths of the largest weight on them; seeds cost minus infinity.

    With a hop ``gain`` above 1 every step multiplies the cost so far.
    Unreached nodes don't appear.
    """
    used = durable(both_ways(arcs, by, weight).groupBy(*by, "src", "dst").agg(F.min(weight).alias("w")), "cost-arcs")

    def offer(front: DataFrame) -> DataFrame:
        met = front.select(*by, F.col("node").alias("src"), "cost").join(used, [*by, "src"])
        hop = F.greatest("cost", F.col("w").cast("double"))
        return met.select(*by, F.col("dst").alias("node"), (hop * gain if gain != 1.0 else hop).alias("cost"))

    return relax(seeds.select(*by, "node", F.lit(float("-inf")).alias("cost")), [*by, "node"], "cost", offer, "cost", most_rounds)


def flood_order(costs: DataFrame, by: Sequence[str] = ("z",), secondary: str = "node") -> DataFrame:
    """``rank`` from 1 by join cost, then by the secondary key."""
    return costs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("cost", secondary)))


def cumulative_area(ranked: DataFrame, by: Sequence[str] = ("z",)) -> DataFrame:
    return ranked.withColumn("cum_area", F.sum("area").over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))


def first_ring(ranked: DataFrame, arcs: DataFrame, k: int, by: Sequence[str] = ("z",)) -> DataFrame:
    """Regions next to the first ``k`` of a flood and not among them."""
    inside = ranked.filter(F.col("rank") <= k).select(*by, F.col("node").alias("src"))
    met = both_ways(arcs, by).join(inside, [*by, "src"]).select(*by, F.col("dst").alias("node")).distinct()
    return met.join(inside.withColumnRenamed("src", "node"), [*by, "node"], "left_anti")


def initial_rank(ranked: DataFrame, by: Sequence[str] = ("z",), share: float = 0.05) -> DataFrame:
    """Rank before the largest relative gap among the first rungs; the gap after the seed is skipped."""
    w = Window.partitionBy(*by).orderBy("rank")
    finite = ranked.filter(F.col("cost") > float("-inf")).withColumn("first", F.first("cost").over(w)).withColumn("next", F.lead("cost").over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    gap = (F.col("next") - F.col("cost")) / (F.col("next") - F.col("first") + 1e-12)
    rungs = finite.withColumn("gap", gap).filter((F.col("rank") - 1 <= F.greatest(F.lit(2), F.ceil(F.col("n") * share))) & F.col("gap").isNotNull())
    return rungs.groupBy(*by).agg(F.min_by("rank", F.struct(-F.col("gap"), F.col("rank"))).alias("initial_rank"))


def weighted(arcs: DataFrame, table: DataFrame, how: str, by: Sequence[str] = ("z",)) -> DataFrame:
    """Directed arcs with ``weight``: ``uniform``, the neighbour's ``area`` or the ``contact`` length."""
    two = both_ways(arcs, by, "length")
    if how == "uniform":
        return two.withColumn("weight", F.lit(1.0)).drop("length")
    if how == "contact":
        return two.withColumn("weight", F.greatest(F.coalesce(F.col("length").cast("double"), F.lit(0.0)), F.lit(0.0))).drop("length")
    if how != "area":
        raise ValueError("weights are uniform, area or contact")
    area = table.select(*by, F.col("label").alias("dst"), F.greatest(F.col("area").cast("double"), F.lit(0.0)).alias("weight"))
    return two.join(area, [*by, "dst"]).drop("length")


def ring(table: DataFrame, arcs: DataFrame, columns: Sequence[str], how: str = "uniform", by: Sequence[str] = ("z",)) -> DataFrame:
    """``mean min max std contrast`` of the neighbours of every region.

    A region without neighbours takes its own value, with deviation 0; where
    all weights are 0 the mean is its own.
    """
    value = table.select(*by, F.col("label").alias("dst"), *[F.col(c).cast("double").alias(c) for c in columns])
    edges = weighted(arcs, table, how, by).join(value, [*by, "dst"])
    w = F.col("weight")
    aggs = [F.sum(w).alias("__w")]
    for c in columns:
        aggs += [F.sum(w * F.col(c)).alias(f"__s_{c}"), F.sum(w * F.col(c) ** 2).alias(f"__q_{c}"), F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}")]
    got = edges.groupBy(*by, F.col("src").alias("label")).agg(*aggs)
    out = table.join(got, [*by, "label"], "left")
    for c in columns:
        own, ok = F.col(c).cast("double"), F.col("__w") > 0
        mean = F.when(ok, F.try_divide(F.col(f"__s_{c}"), F.col("__w"))).otherwise(own)
        var = F.try_divide(F.col(f"__q_{c}"), F.col("__w")) - mean * mean
        out = out.withColumns(
            {
                f"ring_mean_{c}": mean,
                f"ring_min_{c}": F.coalesce(f"__lo_{c}", own),
                f"ring_max_{c}": F.coalesce(f"__hi_{c}", own),
                f"ring_std_{c}": F.when(ok, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0),
                f"ring_contrast_{c}": own - mean,
            }
        )
    return out.drop("__w", *[f"__{p}_{c}" for c in columns for p in ("s", "q", "lo", "hi")])


def hop2(table: DataFrame, arcs: DataFrame, columns: Sequence[str], how: str = "uniform", by: Sequence[str] = ("z",)) -> DataFrame:
    """Ring mean of the ring mean."""
    once = ring(table, arcs, columns, how, by)
    keep = once.select(*table.columns, *[F.col(f"ring_mean_{c}").alias(f"__{c}") for c in columns])
    twice = ring(keep, arcs, [f"__{c}" for c in columns], how, by)
    return twice.select(*table.columns, *[F.col(f"ring_mean___{c}").alias(f"hop2_mean_{c}") for c in columns])


def slice_context(table: DataFrame, columns: Sequence[str], by: Sequence[str] = ("z",), area: bool = False) -> DataFrame:
    """Mean of the whole item and the contrast with it, optionally area weighted."""
    w = Window.partitionBy(*by)
    out = table
    for c in columns:
        mean = (F.sum(F.col(c) * F.col("area")).over(w) / F.sum("area").over(w)) if area else F.avg(c).over(w)
        out = out.withColumn(f"slice_mean_{c}", mean).withColumn(f"slice_contrast_{c}", F.col(c) - F.col(f"slice_mean_{c}"))
    return out


def class_fractions(table: DataFrame, arcs: DataFrame, classes: Sequence[int] = (1, 2, 3, 4), how: str = "uniform", dropout: float = 0.0, seed: int = 0, by: Sequence[str] = ("z",)) -> DataFrame:
    """``frac_c<k>`` and ``frac_any``: weighted share of neighbours with a class; isolated regions have 0.

    ``dropout`` hides that share of labels (at most 0.95), by a seeded hash.
    """
    hidden = F.pmod(F.xxhash64(F.lit(seed), *by, "label"), F.lit(10_000)) < min(dropout, 0.95) * 10_000
    klass = F.when(hidden, 0).otherwise(F.col("class")) if dropout > 0 else F.col("class")
    known = table.select(*by, F.col("label").alias("dst"), klass.alias("k"))
    edges = weighted(arcs, table, how, by).join(known, [*by, "dst"])
    share = lambda c: F.coalesce(F.try_divide(F.sum(F.when(c, F.col("weight")).otherwise(0.0)), F.sum("weight")), F.lit(0.0))
    got = edges.groupBy(*by, F.col("src").alias("label")).agg(*[share(F.col("k") == k).alias(f"frac_c{k}") for k in classes], share(F.col("k") > 0).alias("frac_any"))
    names = [*[f"frac_c{k}" for k in classes], "frac_any"]
    return table.join(got, [*by, "label"], "left").select(*table.columns, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def vote(probabilities: DataFrame, arcs: DataFrame, classes: int, strength: float = 1.0, rounds: int = 3, eps: float = 1e-4, by: Sequence[str] = ("z",)) -> DataFrame:
    """Neighbour voting: ``by, label, class`` after at most ``rounds`` synchronous rounds.

    ``probabilities`` has ``p ARRAY<DOUBLE>``; ``arcs`` has ``p_diff``, the
    probability that the ends differ.  A class scores its log probability plus
    ``strength`` times the log agreement with the neighbours' classes.
    """
    clip = lambda c: F.log(F.least(F.greatest(c, F.lit(eps)), F.lit(1 - eps)))
    scored = durable(probabilities.select(*by, "label", F.transform("p", clip).alias("logp")), "vote-p")
    edges = durable(both_ways(arcs, by, "p_diff").select(*by, "src", "dst", clip(1 - F.col("p_diff")).alias("same"), clip(F.col("p_diff")).alias("diff")), "vote-arcs")
    best = lambda a: F.array_position(a, F.array_max(a)).cast("int") - 1
    now = durable(scored.select(*by, "label", best(F.col("logp")).alias("class")), "vote")
    for _ in range(rounds):
        met = edges.join(now.select(*by, F.col("label").alias("dst"), F.col("class")), [*by, "dst"])
        pull = met.groupBy(*by, F.col("src").alias("label")).agg(*[F.sum(F.when(F.col("class") == k, F.col("same")).otherwise(F.col("diff"))).alias(f"__v{k}") for k in range(classes)])
        joined = scored.join(pull, [*by, "label"], "left")
        total = F.array(*[F.round(F.get("logp", F.lit(k)) + strength * F.coalesce(f"__v{k}", F.lit(0.0)), 9) for k in range(classes)])
        nxt = durable(joined.select(*by, "label", best(total).alias("class")), "vote")
        if nxt.join(now, [*by, "label", "class"], "left_anti").isEmpty():
            return nxt
        now = nxt
    return now


def boundary_scores(table: DataFrame, arcs: DataFrame, by: Sequence[str] = ("z",)) -> DataFrame:
    """Mean ``p_diff`` of the arcs at a region; 0 where there are none."""
    got = both_ways(arcs, by, "p_diff").groupBy(*by, F.col("src").alias("label")).agg(F.avg("p_diff").alias("boundary"))
    return table.join(got, [*by, "label"], "left").withColumn("boundary", F.coalesce("boundary", F.lit(0.0)))


def latent_ring(rows: DataFrame, arcs: DataFrame, latent: str = "latent", by: Sequence[str] = ("z",)) -> DataFrame:
    """Mean latent vector of the neighbours, weighted by ``exp(-distance / tau)``.

    ``tau`` is the item's median distance over its arcs.
    """
    ends = attach(arcs.select(*by, "a", "b"), rows, [latent], by)
    d = F.sqrt(F.aggregate(F.zip_with(f"{latent}_a", f"{latent}_b", lambda x, y: (x - y) ** 2), F.lit(0.0), lambda acc, x: acc + x))
    long = F.greatest(F.size(f"{latent}_a"), F.size(f"{latent}_b"))
    measured = durable(ends.withColumn("d", d).withColumn("dims", long), "latent-arcs")
    dims = range(measured.agg(F.max("dims")).first()[0] or 0)
    # One number an item: the arcs stay where they are, as an item may hold all of them.
    tau = F.broadcast(median_within(measured, by, "d", out="tau"))
    weighed = measured.join(tau, list(by), "left").withColumn("w", F.exp(-F.try_divide(F.col("d"), F.greatest("tau", F.lit(1e-12)))))
    one = lambda s, o: weighed.select(*by, F.col(s).alias("label"), "w", "d", F.col(f"{latent}_{o}").alias("v"))
    # A row an end with all its dimensions; a weight is null unless both ends have the same ones.
    sums = one("a", "b").union(one("b", "a")).filter(F.size("v") > 0).groupBy(*by, "label").agg(
        *[F.sum(F.col("w") * F.get("v", F.lit(k))).alias(f"v{k}") for k in dims], F.sum("w").alias("w"), F.avg("d").alias("ring_distance"), F.max(F.size("v")).alias("n")
    )
    means = F.array(*[F.try_divide(F.col(f"v{k}"), F.col("w")) for k in dims]).cast("array<double>")
    return sums.select(*by, "label", F.slice(means, F.lit(1), F.col("n")).alias("ring_latent"), "ring_distance")


def single_linkage_shape(points: np.ndarray, threshold: float) -> tuple[float, float, float, int]:
    """Largest merge, largest by second largest, distance of the first point to its nearest, and components above the threshold.

    Merge distances of the points, by Prim's algorithm from the first one.
    """
    n = len(points)
    if n < 2:
        return 0.0, 1.0, 0.0, 1
    dist = np.linalg.norm(points - points[0], axis=1)
    attach, dist[0], merges = float(dist[1:].min()), np.inf, []
    inside = np.zeros(n, bool)
    inside[0] = True
    for _ in range(n - 1):
        k = int(dist.argmin())
        merges.append(float(dist[k]))
        inside[k] = True
        dist = np.where(inside, np.inf, np.minimum(dist, np.linalg.norm(points - points[k], axis=1)))
    merges.sort(reverse=True)
    second = merges[1] if n > 2 else 0.0
    return merges[0], merges[0] / second if second > 1e-12 else 1.0, attach, 1 + sum(m > threshold for m in merges)


_SHAPE = T.StructType([*(T.StructField(c, T.DoubleType()) for c in ("h0_largest", "h0_ratio", "h0_attach")), T.StructField("h0_components", T.LongType())])


@F.pandas_udf(_SHAPE)
def _shapes(own: pd.Series, ring: pd.Series, threshold: pd.Series) -> pd.DataFrame:
    rows = []
    for v, near, t in zip(own, ring, threshold):
        points = [np.asarray(v, float), *(np.asarray(x, float) for x in near)] if near is not None else [np.asarray(v, float)]
        rows.append(single_linkage_shape(np.stack(points), float(t)))
    return pd.DataFrame(rows, columns=_SHAPE.names)


def neighbour_shapes(rows: DataFrame, arcs: DataFrame, latent: str = "latent", most: int = 24, z: float = 1.0, by: Sequence[str] = ("z",)) -> DataFrame:
    """Single-linkage shape of each region and its ring in latent space.

    The points are the region's own and those of its ``most`` nearest
    neighbours.  Merges above the mean and ``z`` deviations of the arc
    distances of its slice part components.  A region without neighbours reads
    0, 1, 0 and 1.
    """
    vector = F.col(latent).cast("array<double>")
    ends = both_ways(arcs, by).select(*by, "src", "dst").distinct()
    ends = ends.join(rows.select(*by, F.col("label").alias("src"), vector.alias("u")), [*by, "src"]).join(rows.select(*by, F.col("label").alias("dst"), vector.alias("v")), [*by, "dst"])
    far = durable(ends.withColumn("d", F.sqrt(F.aggregate(F.zip_with("u", "v", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, x: acc + x))).select(*by, "src", "dst", "v", "d"), "shape-arcs")
    limits = far.groupBy(*by).agg((F.avg("d") + z * F.stddev_pop("d")).alias("t"))
    near = far.withColumn("r", F.row_number().over(Window.partitionBy(*by, "src").orderBy("d", "dst"))).filter(F.col("r") <= most)
    rings = near.groupBy(*by, F.col("src").alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias("ring"))
    whole = rows.select(*by, "label", vector.alias("own")).join(rings, [*by, "label"], "left").join(F.broadcast(limits), list(by), "left")
    return whole.select(*by, "label", _shapes("own", "ring", F.coalesce("t", F.lit(0.0))).alias("s")).select(*by, "label", "s.*")


def walk_ends(arcs: DataFrame, starts: DataFrame, hops: int, seed: int = 0, by: Sequence[str] = ("z",)) -> DataFrame:
    """``by, start, node``: end of a uniform walk of ``hops`` steps; a node without arcs stays."""
    two = both_ways(arcs, by).distinct()
    ordered = two.withColumn("i", F.row_number().over(Window.partitionBy(*by, "src").orderBy("dst")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by, "src")))
    ordered = durable(ordered, "walk-arcs")
    at = starts.select(*by, F.col("node").alias("start"), "node")
    for hop in range(hops):
        chosen = at.join(ordered.withColumnRenamed("src", "node"), [*by, "node"], "left")
        mine = F.pmod(F.xxhash64(F.lit(seed), F.lit(hop), *by, "start"), F.coalesce("n", F.lit(1))) == F.coalesce("i", F.lit(0))
        at = chosen.filter(mine).select(*by, "start", F.coalesce("dst", "node").alias("node"))
    return at


def pair_features(ends: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absolute difference and product of both ends, log contact and the barrier."""
    out = [F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")).alias(f"absdiff_{c}") for c in columns]
    out += [(F.col(f"{c}_a") * F.col(f"{c}_b")).alias(f"prod_{c}") for c in columns]
    return ends.select("*", *out, F.log1p(F.col("length").cast("double")).alias("log_contact"), (F.col("saddle").cast("double")).alias("barrier"))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return 1 - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def total_variation(p: Column, q: Column) -> Column:
    """Half the summed difference of two distributions; 1 where one is missing."""
    return F.coalesce(F.aggregate(F.zip_with(p, q, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x) / 2, F.lit(1.0))


def hellinger(p: Column, q: Column) -> Column:
    s = F.aggregate(F.zip_with(p, q, lambda x, y: (F.sqrt(x) - F.sqrt(y)) ** 2), F.lit(0.0), lambda acc, x: acc + x)
    return F.coalesce(F.sqrt(s / 2), F.lit(1.0))


def bhattacharyya(mean_a: Column, std_a: Column, mean_b: Column, std_b: Column, floor: float = 1e-6) -> Column:
    """Distance of two normal distributions with a floor under their spreads."""
    va, vb = F.greatest(std_a * std_a, F.lit(floor)), F.greatest(std_b * std_b, F.lit(floor))
    return (mean_a - mean_b) ** 2 / (4 * (va + vb)) + F.log((va + vb) / (2 * F.sqrt(va * vb))) / 2


def tile_grid(width: int, height: int, side: int) -> list[tuple[int, int, int, int]]:
    """Boxes ``y0, y1, x0, x1`` that cover an image, clamped to it."""
    return [(y, min(y + side, height), x, min(x + side, width)) for y in range(0, height, side) for x in range(0, width, side)]


def distance_weights(arcs: DataFrame, table: DataFrame, column: str, seed: int, by: Sequence[str] = ("z",)) -> DataFrame:
    """``chain`` (ends apart), ``barrier`` (saddle) and ``anchor`` (farther end from the seed) per arc."""
    ends = attach(arcs, table, [column], by)
    start = table.filter(F.col("label") == seed).select(*by, F.col(column).alias("__s"))
    apart = lambda x, y: F.abs(F.col(x) - F.col(y))
    return ends.join(start, list(by)).select(
        *arcs.columns, apart(f"{column}_a", f"{column}_b").alias("chain"), F.col("saddle").alias("barrier"), F.greatest(apart(f"{column}_a", "__s"), apart(f"{column}_b", "__s")).alias("anchor")
    )


def nearest_within(asked: DataFrame, points: DataFrame, radius: int, item: str = "z") -> DataFrame:
    """``item, y, x, label, d2``: nearest point ``py, px`` within the radius, smaller label on ties.

    Both sides meet by tiles of the radius: an asked cell looks into the nine
    tiles around it, so the join is an equality with a residual test.
    """
    tile = lambda c: F.floor(F.col(c) / radius)
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    spread = asked.withColumn("__d", F.explode(around)).withColumn("__ty", tile("y") + F.col("__d.dy")).withColumn("__tx", tile("x") + F.col("__d.dx")).drop("__d")
    placed = points.withColumn("__ty", tile("py")).withColumn("__tx", tile("px"))
    d2 = (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")) + (F.col("x") - F.col("px")) * (F.col("x") - F.col("px"))
    met = spread.join(placed, [item, "__ty", "__tx"]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius)
    best = met.groupBy(item, "y", "x").agg(F.min(F.struct("d2", "label")).alias("m"))
    return best.select(item, "y", "x", "m.label", "m.d2")


def tiles_of(extents: DataFrame, size: int, item: str = "z") -> DataFrame:
    """``item, y0, y1, x0, x1``: the tiles that cover each item's ``height`` by ``width``, cut at its edges."""
    begins = lambda c: F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1, F.lit(size)))
    rows = extents.filter("height > 0 AND width > 0").withColumn("y0", begins("height")).withColumn("x0", begins("width"))
    end = lambda c, most: F.least(F.col(c) + size, F.col(most).cast("int"))
    return rows.select(item, "y0", end("y0", "height").alias("y1"), "x0", end("x0", "width").alias("x1"))
