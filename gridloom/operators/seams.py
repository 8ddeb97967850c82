"""Seams: chains of cracks between two regions, from junction to junction.

A crack is the edge between two cells; corners are ``y * (width + 1) + x``.
The crack from a corner to the right has id ``2 * corner``, down ``2 * corner + 1``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.components import connected_components
from gridloom.operators.raster import AXES
from gridloom.plans.durable import Rounds, durable
from gridloom.plans.relax import relax


def cracks(pixels: DataFrame, width: int, label: str = "label", item: str = "z") -> DataFrame:
    """``item, crack, c0, c1, a, b`` with flanks ``a < b``, between present cells of different labels."""
    row = width + 1
    parts = []
    for axis in ("x", "y"):
        across, along = AXES[axis]
        w = Window.partitionBy(item, across).orderBy(along)
        n = pixels.select(item, "y", "x", F.col(label).alias("p"), F.lead(label).over(w).alias("q"), F.lead(along).over(w).alias("__at")).filter((F.col("__at") == F.col(along) + 1) & (F.col("p") != F.col("q")))
        start = (F.col("y") * row + F.col("x") + 1) if axis == "x" else ((F.col("y") + 1) * row + F.col("x"))
        down = axis == "x"
        parts.append(
            n.select(item, (start * 2 + int(down)).cast("long").alias("crack"), start.cast("long").alias("c0"), (start + (row if down else 1)).cast("long").alias("c1"), F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
        )
    return parts[0].unionByName(parts[1])


def corners(found: DataFrame, item: str = "z") -> DataFrame:
    """``item, corner, degree, junction``: degree other than 2, or two cracks of different flanks."""
    ends = found.select(item, F.col("c0").alias("corner"), "a", "b").union(found.select(item, "c1", "a", "b"))
    got = ends.groupBy(item, "corner").agg(F.count("*").alias("degree"), F.min(F.struct("a", "b")).alias("lo"), F.max(F.struct("a", "b")).alias("hi"))
    return got.select(item, "corner", "degree", ((F.col("degree") != 2) | (F.col("lo") != F.col("hi"))).alias("junction"))


def seams(found: DataFrame, item: str = "z") -> DataFrame:
    """Adds ``seam``, the smallest crack id of its chain, to the cracks.

    Cracks that share a corner which is no junction are linked.
    """
    pass_ = corners(found, item).filter("NOT junction").select(item, "corner")
    gid = F.col(item).cast("long") * (1 << 40) + F.col("crack")
    ends = found.select(item, gid.alias("g"), F.col("c0").alias("corner")).union(found.select(item, gid, "c1"))
    met = ends.join(pass_, [item, "corner"]).groupBy(item, "corner").agg(F.min("g").alias("u"), F.max("g").alias("v"))
    roots = connected_components(met).withColumnRenamed("node", "__g")
    return found.withColumn("__g", gid).join(roots, "__g", "left").withColumn("seam", F.coalesce("component", "__g") % (1 << 40)).drop("__g", "component")


def seam_table(chained: DataFrame, item: str = "z") -> DataFrame:
    """``item, seam, a, b, length, j0, j1, closed``: ends are the corners met once."""
    ends = chained.select(item, "seam", F.col("c0").alias("corner")).union(chained.select(item, "seam", "c1"))
    open_ = ends.groupBy(item, "seam", "corner").agg(F.count("*").alias("n")).filter("n = 1").groupBy(item, "seam").agg(F.min("corner").alias("j0"), F.max("corner").alias("j1"))
    size = chained.groupBy(item, "seam").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.count("*").alias("length"))
    return size.join(open_, [item, "seam"], "left").withColumn("closed", F.col("j0").isNull())


def seam_boxes(chained: DataFrame, width: int, item: str = "z") -> DataFrame:
    """Box of the corners of each seam, and its chord and tortuosity."""
    row = width + 1
    y = lambda c: F.floor(F.col(c) / row)
    x = lambda c: F.col(c) % row
    return chained.groupBy(item, "seam").agg(
        F.min(F.least(y("c0"), y("c1"))).alias("y0"), F.max(F.greatest(y("c0"), y("c1"))).alias("y1"), F.min(F.least(x("c0"), x("c1"))).alias("x0"), F.max(F.greatest(x("c0"), x("c1"))).alias("x1"), F.count("*").alias("length")
    )


def affinity(table: DataFrame, arcs: DataFrame, weight: str = "saddle", item: str = "z", q: float = 0.95) -> DataFrame:
    """``affinity`` of a seam from its flanks' arc, scaled by the item's percentile and clipped; 0 where unknown."""
    joined = table.join(arcs.select(item, "a", "b", F.col(weight).cast("double").alias("__w")), [item, "a", "b"], "left")
    scale = joined.filter(F.col("__w").isNotNull()).groupBy(item).agg(F.percentile("__w", F.lit(q)).alias("__s"))
    return joined.join(scale, item, "left").withColumn("affinity", F.coalesce(F.least(F.greatest(F.try_divide("__w", "__s"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).drop("__w", "__s")


def tolls(table: DataFrame, eps: float = 0.01) -> DataFrame:
    return table.withColumn("toll", (F.lit(eps) + 1 - F.col("affinity")) * F.col("length"))


def coverage(chained: DataFrame, traces: DataFrame, least: float = 0.5, item: str = "z") -> DataFrame:
    """``item, uid, seam, covered``: seams of which a trace ``item, uid, crack`` covers at least the share."""
    size = chained.groupBy(item, "seam").agg(F.count("*").alias("n"))
    hit = traces.join(chained.select(item, "crack", "seam"), [item, "crack"]).groupBy(item, "uid", "seam").agg(F.countDistinct("crack").alias("k"))
    return hit.join(size, [item, "seam"]).select(item, "uid", "seam", (F.col("k") / F.col("n")).alias("covered")).filter(F.col("covered") >= least)


def in_scope(boxes: DataFrame, scopes: DataFrame, item: str = "z") -> DataFrame:
    """``item, uid, seam`` where the scope ``y0s..x1s`` holds every corner of the seam."""
    inside = (F.col("y0") >= F.col("y0s")) & (F.col("y1") <= F.col("y1s")) & (F.col("x0") >= F.col("x0s")) & (F.col("x1") <= F.col("x1s"))
    return boxes.join(scopes, item).filter(inside).select(item, "uid", "class", "seam")


def resolve(scoped: DataFrame, traced: DataFrame, item: str = "z") -> DataFrame:
    """Scopes by uid, then traces by uid; the last one wins."""
    events = scoped.select(item, "seam", F.lit(0).alias("kind"), "uid", "class").union(traced.select(item, "seam", F.lit(1), "uid", "class"))
    return events.groupBy(item, "seam").agg(F.max_by("class", F.struct("kind", "uid")).alias("class"))


def junction_seams(table: DataFrame, item: str = "z") -> DataFrame:
    """Seams at each junction, from either end."""
    ends = table.filter("NOT closed").select(item, F.col("j0").alias("junction"), "seam").union(table.filter("NOT closed").select(item, "j1", "seam"))
    return ends.groupBy(item, "junction").agg(F.array_sort(F.collect_set("seam")).alias("seams"))


def cheapest_paths(tolled: DataFrame, seeds: DataFrame, item: str = "z", most_rounds: int = 10_000) -> DataFrame:
    """``item, node, cost``: least toll from the seed junctions along seams, relaxed to a fixpoint."""
    open_ = tolled.filter("NOT closed").groupBy(item, "j0", "j1").agg(F.min("toll").alias("toll"))
    used = durable(open_.select(item, F.col("j0").alias("src"), F.col("j1").alias("dst"), "toll").union(open_.select(item, "j1", "j0", "toll")), "path-arcs")

    def offer(front: DataFrame) -> DataFrame:
        met = front.select(item, F.col("node").alias("src"), "cost").join(used, [item, "src"])
        return met.select(item, F.col("dst").alias("node"), F.round(F.col("cost") + F.col("toll"), 9).alias("cost"))

    return relax(seeds.select(item, "node", F.lit(0.0).alias("cost")), [item, "node"], "cost", offer, "path", most_rounds)


def placed(chained: DataFrame, item: str = "z") -> DataFrame:
    """Adds ``at``, a crack's place along its seam, and ``fore``, whether it leads from ``c0`` to ``c1`` there.

    An open seam starts at its smaller end, a closed one at its smallest crack,
    from ``c0`` to ``c1``.  Each crack has two arcs, one a direction, and every
    arc finds the end of its seam by doubling the distance that it looks ahead.
    """
    table = seam_table(chained, item)
    arc = lambda fore, tail, head: F.struct(F.lit(fore).alias("fore"), F.col(tail).alias("tail"), F.col(head).alias("head"))
    ways = F.explode(F.array(arc(True, "c0", "c1"), arc(False, "c1", "c0")))
    arcs = durable(chained.select(item, "seam", "crack", "c0", ways.alias("w")).select(item, "seam", "crack", "c0", "w.*").withColumn("arc", F.col("crack") * 2 + F.col("fore").cast("int")), "seam-arcs")
    after = arcs.select(item, "seam", F.col("tail").alias("head"), F.col("crack").alias("__c"), F.col("arc").alias("next"))
    # A closed seam ends before its first crack.
    met = arcs.join(after, [item, "seam", "head"]).filter("__c <> crack").join(table.select(item, "seam", "closed"), [item, "seam"])
    follow = met.filter("NOT (closed AND __c = seam)").select(item, "arc", "next")
    state = arcs.select(item, "arc", F.col("head").alias("end")).join(follow, [item, "arc"], "left").select(item, "arc", "next", F.col("next").isNotNull().cast("long").alias("ahead"), "end")
    rounds = Rounds(chained.sparkSession, "seam-ends")
    state = rounds.write(state)
    while not state.filter("next IS NOT NULL").isEmpty():
        far = state.select(item, F.col("arc").alias("next"), F.col("next").alias("__n"), F.col("ahead").alias("__a"), F.col("end").alias("__e"))
        both = state.join(far, [item, "next"], "left")
        state = rounds.write(both.select(item, "arc", F.col("__n").alias("next"), (F.col("ahead") + F.coalesce("__a", F.lit(0))).alias("ahead"), F.coalesce("__e", "end").alias("end")))
    starts = chained.filter("crack = seam").select(item, "seam", F.col("c0").alias("__s"))
    last = table.join(starts, [item, "seam"]).select(item, "seam", "length", F.coalesce("j1", "__s").alias("end"))
    right = arcs.join(state.select(item, "arc", "ahead", "end"), [item, "arc"]).join(last, [item, "seam", "end"])
    return chained.join(right.select(item, "crack", (F.col("length") - 1 - F.col("ahead")).alias("at"), "fore"), [item, "crack"])


def legs(events: DataFrame, tolled: DataFrame, item: str = "z") -> DataFrame:
    """``item, trace, leg, s, i, t, k``: from a point ``(s, i)`` of a seam to the next point ``(t, k)`` of a trace.

    ``events`` are ``item, trace, ordinal, seam, idx``: a point, or a drop of the
    last point if ``seam`` is null.  Place ``idx`` is a corner of the seam, 0 to its
    length.  A point counts only if its seam is in ``tolled``, if it lies on it and
    if it can be reached from the trace's first such point; a drop of nothing is
    nothing.
    """
    wide = 1 << 40
    gid = lambda c: F.col(item).cast("long") * wide + F.col(c)
    roots = connected_components(tolled.filter("NOT closed").select(gid("j0").alias("u"), gid("j1").alias("v")))
    where = tolled.withColumn("node", gid("j0")).join(roots, "node", "left").select(item, "seam", "length", F.when(F.col("closed"), -gid("seam") - 1).otherwise(F.col("component")).alias("part"))
    known = events.join(where, [item, "seam"], "left").filter(F.col("seam").isNull() | ((F.col("idx") >= 0) & (F.col("idx") <= F.col("length"))))
    of_trace = Window.partitionBy(item, "trace")
    point = F.col("seam").isNotNull()
    kept = known.withColumn("base", F.min_by("part", F.when(point, F.col("ordinal"))).over(of_trace)).filter(~point | (F.col("part") == F.col("base")))
    depth = F.sum(F.when(point, 1).otherwise(-1)).over(of_trace.orderBy("ordinal"))
    # A point is dropped once the sum of points less drops falls below what it was at the point.
    later = F.min("depth").over(of_trace.orderBy(F.desc("ordinal")))
    stays = kept.withColumn("depth", depth).withColumn("later", later).filter(point & (F.col("later") >= F.col("depth")))
    row = of_trace.orderBy("ordinal")
    ends = stays.select(item, "trace", (F.row_number().over(row) - 2).alias("leg"), F.lag("seam").over(row).alias("s"), F.lag("idx").over(row).alias("i"), F.col("seam").alias("t"), F.col("idx").alias("k"))
    return ends.filter("leg >= 0")


def livewire(events: DataFrame, tolled: DataFrame, item: str = "z", most_rounds: int = 10_000) -> DataFrame:
    """``item, trace, leg, step, seam, i0, i1, cost``: the cheapest way of each leg, seam by seam.

    A step walks a seam from place ``i0`` to ``i1``; steps of no crack are left
    out, and ``cost`` is that of the leg.  Round a closed seam places run on past
    its length or below 0.  Ties: the seam itself before ways through junctions,
    then the smaller end, fewer hops, the smaller junction and seam.  All legs are
    relaxed at once, with predecessors; ways are found by doubling along these.
    """
    spark, key = events.sparkSession, [item, "trace", "leg"]
    sides = tolled.select(item, "seam", "length", "j0", "j1", "closed", F.col("toll").cast("double").alias("toll"), (F.col("toll") / F.col("length")).alias("rate"))
    sides = durable(sides, "wire-seams")
    named = lambda p: sides.select(item, *[F.col(c).alias(f"{p}_{c}" if c != "seam" else p) for c in sides.columns if c != item])
    wanted = durable(legs(events, tolled, item).join(named("s"), [item, "s"]).join(named("t"), [item, "t"]), "wire-legs")
    open_ = sides.filter("NOT closed")
    two = open_.select(item, F.col("j0").alias("src"), F.col("j1").alias("node"), "toll", "seam").union(open_.select(item, "j1", "j0", "toll", "seam"))
    used = durable(two.groupBy(item, "src", "node").agg(F.min(F.struct("toll", "seam")).alias("by")), "wire-arcs")
    way = lambda cost, hops, prev, seam: F.struct(F.round(cost, 9).alias("cost"), hops.cast("int").alias("hops"), prev.cast("long").alias("prev"), seam.cast("long").alias("seam")).alias("way")
    out = [wanted.filter("NOT s_closed").select(*key, F.col(f"s_j{e}").cast("long").alias("node"), way(d * F.col("s_rate"), F.lit(1), F.lit(-1), F.col("s"))) for e, d in ((0, F.col("i")), (1, F.col("s_length") - F.col("i")))]

    def offer(front: DataFrame) -> DataFrame:
        met = front.withColumnRenamed("node", "src").join(used, [item, "src"])
        return met.select(*key, F.col("node").cast("long").alias("node"), way(F.col("way.cost") + F.col("by.toll"), F.col("way.hops") + 1, F.col("src"), F.col("by.seam")))

    tree = relax(out[0].union(out[1]), [*key, "node"], "way", offer, "wire", most_rounds)

    n, same = F.col("t_length"), wanted.filter("s = t")
    ahead, back = F.pmod(F.col("k") - F.col("i"), n), F.pmod(F.col("i") - F.col("k"), n)
    stop = F.when(~F.col("t_closed"), F.col("k")).when(ahead <= back, F.col("i") + ahead).otherwise(F.col("i") - back)
    pick = lambda cost, order, node, stop: F.struct(F.round(cost, 9).alias("cost"), F.lit(order).alias("order"), node.cast("long").alias("goal"), stop.cast("long").alias("stop")).alias("pick")
    found = same.select(*key, pick(F.abs(stop - F.col("i")) * F.col("t_rate"), 0, F.lit(None), stop))
    for order, end, rest in ((1, "t_j0", F.col("k")), (2, "t_j1", n - F.col("k"))):
        reached = wanted.filter("NOT t_closed").withColumn("node", F.col(end).cast("long")).join(tree, [*key, "node"])
        found = found.unionByName(reached.select(*key, pick(F.col("way.cost") + rest * F.col("t_rate"), order, F.col("node"), F.col("k"))))
    best = durable(found.groupBy(*key).agg(F.min("pick").alias("pick")), "wire-best")

    # Ancestors by doubling: after a round the marked nodes are twice as far along the way.
    jumps = durable(tree.select(*key, "node", F.col("way.prev").alias("up")), "wire-jumps")
    marked = durable(best.filter("pick.goal IS NOT NULL").select(*key, F.col("pick.goal").alias("node")), "wire-marked")
    longest = tree.join(marked, [*key, "node"]).agg(F.max("way.hops")).first()[0] or 0
    for _ in range(max(0, longest - 1).bit_length()):
        more = marked.join(jumps, [*key, "node"]).filter("up >= 0").select(*key, F.col("up").alias("node"))
        marked = durable(marked.union(more).distinct(), "wire-marked")
        up = jumps.select(*key, F.col("node").alias("up"), F.col("up").alias("__u"))
        jumps = durable(jumps.join(up, [*key, "up"], "left").select(*key, "node", F.coalesce("__u", F.lit(-1)).alias("up")), "wire-jumps")

    ways = marked.join(tree, [*key, "node"]).select(*key, "node", "way.hops", "way.seam").join(sides.select(item, "seam", "length", "j1"), [item, "seam"])
    to_end = F.col("node") == F.col("j1")
    i0 = F.when(F.col("hops") == 1, F.col("i")).when(to_end, F.lit(0)).otherwise(F.col("length"))
    middle = ways.join(wanted.select(*key, "i"), key).select(*key, F.col("hops").alias("rank"), "seam", i0.alias("i0"), F.when(to_end, F.col("length")).otherwise(F.lit(0)).alias("i1"))
    done = best.join(wanted, key)
    first = F.when(F.col("pick.order") == 0, F.col("i")).when(F.col("pick.order") == 1, F.lit(0)).otherwise(n)
    last = done.select(*key, F.lit(1 << 30).alias("rank"), F.col("t").alias("seam"), first.alias("i0"), F.col("pick.stop").alias("i1"))
    steps = middle.union(last).filter("i0 <> i1").join(best.select(*key, F.col("pick.cost").alias("cost")), key)
    number = F.row_number().over(Window.partitionBy(*key).orderBy("rank")) - 1
    return steps.select(*key, number.alias("step"), F.col("seam").cast("long").alias("seam"), F.col("i0").cast("long").alias("i0"), F.col("i1").cast("long").alias("i1"), "cost")


def walked(steps: DataFrame, places: DataFrame, item: str = "z") -> DataFrame:
    """``item, trace, leg, step, pos, crack, corner``: the cracks of each step in order, with the corner each leads to.

    ``places`` are those of ``placed``.  The cracks are traces for ``coverage``.
    """
    size = places.groupBy(item, "seam").agg(F.count("*").alias("__n"))
    span = F.abs(F.col("i1") - F.col("i0"))
    onward = F.col("i1") > F.col("i0")
    each = steps.join(size, [item, "seam"]).withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), span - 1)))
    spots = each.withColumn("at", F.pmod(F.when(onward, F.col("i0") + F.col("pos")).otherwise(F.col("i0") - 1 - F.col("pos")), F.col("__n"))).withColumn("__on", onward)
    met = spots.join(places.select(item, "seam", "at", "crack", "c0", "c1", "fore"), [item, "seam", "at"])
    return met.select(item, "trace", "leg", "step", "pos", "crack", F.when(F.col("__on") == F.col("fore"), F.col("c1")).otherwise(F.col("c0")).alias("corner"))
