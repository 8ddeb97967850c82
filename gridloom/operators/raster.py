"""Stencil operators over ``z, y, x, value`` rows.

Separable kernels read a row or a column of the raster through one range
window, so a pass is one shuffle by row and many kernels share it.  Cells that
are absent, as beyond the border, count as the value at the centre.  A raster
is complete: a pass along columns can't see past a cell that a row lacks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.components import connected_components
from gridloom.operators.planes import symmetric_eigenvalue

AXES = {"x": ("y", "x"), "y": ("x", "y")}


def kernel(sigma: float, order: int = 0) -> list[float]:
    """Sampled Gaussian or its first or second derivative, radius ``ceil(3 sigma)``."""
    r = max(1, math.ceil(3 * sigma))
    g = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    g = [v / sum(g) for v in g]
    d = range(-r, r + 1)
    if order == 0:
        return g
    if order == 1:
        k = [x * v / sigma**2 for x, v in zip(d, g)]
        return [v / sum(x * w for x, w in zip(d, k)) for v in k]
    k = [(x * x / sigma**4 - 1 / sigma**2) * v for x, v in zip(d, g)]
    k = [v - sum(k) / len(k) for v in k]
    return [2 * v / sum(x * x * w for x, w in zip(d, k)) for v in k]


def convolve(df: DataFrame, axis: str, responses: dict[str, tuple[str, list[float], bool]], by: Sequence[str] = ("z",)) -> DataFrame:
    """Adds ``name = sum of kernel * (neighbour - centre)``, plus the centre where ``smooth``.

    ``responses`` is ``{name: (column, kernel, smooth)}``; all share one window.
    """
    across, along = AXES[axis]
    radius = max(len(k) // 2 for _, k, _ in responses.values())
    columns = sorted({c for c, _, _ in responses.values()})
    w = Window.partitionBy(*by, across).orderBy(along).rangeBetween(-radius, radius)
    near = df.withColumn("__near", F.collect_list(F.struct(F.col(along).alias("at"), *[F.col(c).cast("double").alias(c) for c in columns])).over(w))

    def response(c: str, k: list[float], smooth: bool) -> Column:
        r, weights, centre = len(k) // 2, F.array(*[F.lit(v) for v in k]), F.col(c).cast("double")

        def add(acc: Column, e: Column) -> Column:
            step = e["at"] - F.col(along)
            return acc + F.when(F.abs(step) <= r, F.get(weights, step + r) * (e[c] - centre)).otherwise(0.0)

        return F.aggregate("__near", F.lit(0.0), add) + (centre if smooth else F.lit(0.0))

    out = [response(*r).alias(name) for name, r in responses.items()]
    return near.select(*df.columns, *out)


def gaussian(df: DataFrame, value: str, sigma: float, out: str = "blur", orders: tuple[int, int] = (0, 0), by: Sequence[str] = ("z",)) -> DataFrame:
    """Gaussian blur or derivative ``orders`` along (x, y)."""
    first = convolve(df, "x", {"__p": (value, kernel(sigma, orders[0]), orders[0] == 0)}, by)
    return convolve(first, "y", {out: ("__p", kernel(sigma, orders[1]), orders[1] == 0)}, by).drop("__p")


def derivatives(df: DataFrame, value: str, sigma: float, by: Sequence[str] = ("z",)) -> DataFrame:
    """All first and second derivatives in two passes: ``dx dy dxx dxy dyy`` and ``smooth``."""
    k0, k1, k2 = (kernel(sigma, o) for o in range(3))
    rows = convolve(df, "x", {"__s": (value, k0, True), "__d": (value, k1, False), "__h": (value, k2, False)}, by)
    return convolve(
        rows, "y", {"smooth": ("__s", k0, True), "dx": ("__d", k0, True), "dy": ("__s", k1, False), "dxx": ("__h", k0, True), "dxy": ("__d", k1, False), "dyy": ("__s", k2, False)}, by
    ).drop("__s", "__d", "__h")


def laplacian(df: DataFrame, value: str, sigma: float, out: str = "laplacian") -> DataFrame:
    d = derivatives(df, value, sigma)
    return d.select(*df.columns, (F.col("dxx") + F.col("dyy")).alias(out))


def neighbours(df: DataFrame, value: str, by: Sequence[str] = ("z",)) -> DataFrame:
    """Adds ``left right up down`` values; null where the cell is absent."""
    out = df
    for (lower, upper), axis in ((("left", "right"), "x"), (("up", "down"), "y")):
        across, along = AXES[axis]
        w = Window.partitionBy(*by, across).orderBy(along)
        for name, f, step in ((lower, F.lag, -1), (upper, F.lead, 1)):
            out = out.withColumn(name, F.when(f(along).over(w) == F.col(along) + step, f(value).over(w)))
    return out


def zero_crossings(df: DataFrame, value: str, sigma: float, out: str = "crossing") -> DataFrame:
    """1 where the Laplacian changes sign towards the right or lower neighbour."""
    n = neighbours(laplacian(df, value, sigma, "__l"), "__l")
    change = reduce(lambda a, b: a | b, (F.coalesce(F.signum("__l") * F.signum(c) < 0, F.lit(False)) for c in ("right", "down")))
    return n.select(*df.columns, change.cast("int").alias(out))


def hessian_eigenvalues(df: DataFrame, value: str, sigma: float) -> DataFrame:
    d = derivatives(df, value, sigma)
    part = lambda big: symmetric_eigenvalue(F.col("dxx"), F.col("dxy"), F.col("dyy"), big)
    return d.select(*df.columns, part(True).alias("hessian_largest"), part(False).alias("hessian_smallest"))


def structure_eigenvalues(df: DataFrame, value: str, sigma: float, integration: float) -> DataFrame:
    d = derivatives(df, value, sigma)
    products = d.select(*df.columns, (F.col("dx") ** 2).alias("__xx"), (F.col("dx") * F.col("dy")).alias("__xy"), (F.col("dy") ** 2).alias("__yy"))
    k = kernel(integration)
    names = ("__xx", "__xy", "__yy")
    rows = convolve(products, "x", {f"{n}r": (n, k, True) for n in names})
    both = convolve(rows, "y", {f"{n}b": (f"{n}r", k, True) for n in names})
    part = lambda big: symmetric_eigenvalue(F.col("__xxb"), F.col("__xyb"), F.col("__yyb"), big)
    return both.select(*df.columns, part(True).alias("tensor_largest"), part(False).alias("tensor_smallest"))


def gradient_magnitude(df: DataFrame, value: str, sigma: float, out: str = "gradmag") -> DataFrame:
    d = derivatives(df, value, sigma)
    return d.select(*df.columns, F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2).alias(out))


def ridge_cells(df: DataFrame, value: str, sigma: float, out: str = "gradmag") -> DataFrame:
    """Cells whose gradient is the largest across the edge, with its magnitude.

    The magnitude is compared on both sides along the gradient, between the
    neighbour on its main axis and the diagonal one beside it, by how far it
    leans to the diagonal.  Neighbours outside the raster count as 0.  On a
    plateau across the edge the cell that is last along the gradient stays.
    Cells without a gradient go.
    """
    m = derivatives(df, value, sigma).withColumn("__m", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2))
    across, down = Window.partitionBy("z", "y").orderBy("x"), Window.partitionBy("z", "x").orderBy("y")
    # By coordinate and not by row, as cells may be missing.
    beside = lambda f, d: F.when(f("x").over(across) == F.col("x") + d, f("__m").over(across))
    row = m.withColumn("__row", F.struct(beside(F.lag, -1).alias("l"), F.col("__m").alias("c"), beside(F.lead, 1).alias("r"), F.col("y")))
    near = row.withColumns({"__u": F.lag("__row").over(down), "__d": F.lead("__row").over(down)})
    at = lambda c, side, d: F.coalesce(F.when(F.col(f"{c}.y") == F.col("y") + d, F.col(f"{c}.{side}")), F.lit(0.0))
    own = lambda side: F.coalesce(F.col(f"__row.{side}"), F.lit(0.0))
    flat, lean = F.abs("dx") >= F.abs("dy"), F.least(F.abs("dx"), F.abs("dy")) / F.greatest(F.abs("dx"), F.abs("dy"))

    def side(sign: int) -> Column:
        right, low = F.col("dx") * sign > 0, F.col("dy") * sign > 0
        # The diagonal that the gradient leans to; without a lean it has no weight.
        diagonal = F.when(right, F.when(low, at("__d", "r", 1)).otherwise(at("__u", "r", -1))).otherwise(F.when(low, at("__d", "l", 1)).otherwise(at("__u", "l", -1)))
        main = F.when(flat, F.when(right, own("r")).otherwise(own("l"))).otherwise(F.when(low, at("__d", "c", 1)).otherwise(at("__u", "c", -1)))
        return main * (1 - lean) + diagonal * lean

    kept = near.filter((F.col("__m") > 0) & (F.col("__m") > side(1)) & (F.col("__m") >= side(-1)))
    return kept.select(*df.columns, F.col("__m").alias(out))


def edge_mask(df: DataFrame, value: str, sigma: float, low: float | None, high: float | None, thin: bool = False) -> DataFrame:
    """Hysteresis: cells above ``low`` in a component that reaches ``high``; of thin edges only ``ridge_cells``, linked over corners too."""
    if low is None and high is None:
        raise ValueError("an edge mask needs a low or a high threshold")
    low, high = (high if low is None else low), (low if high is None else high)
    weak = (ridge_cells if thin else gradient_magnitude)(df, value, sigma, "__m").filter(F.col("__m") >= low)
    marked = label_components(weak, "z", 8 if thin else 4, keep=("__m",))
    strong = marked.groupBy("z", "component").agg(F.max("__m").alias("__top")).filter(F.col("__top") >= high)
    return marked.join(strong.select("z", "component"), ["z", "component"], "left_semi").select("z", "y", "x")


def morphology(df: DataFrame, value: str, op: str, radius: int, out: str = "out", by: Sequence[str] = ("z",)) -> DataFrame:
    """``erode dilate open close`` with a square of the radius, separable and exact."""
    one = {"erode": F.min, "dilate": F.max}

    def step(rows: DataFrame, f: Callable, src: str, dst: str) -> DataFrame:
        wx = Window.partitionBy(*by, "y").orderBy("x").rangeBetween(-radius, radius)
        wy = Window.partitionBy(*by, "x").orderBy("y").rangeBetween(-radius, radius)
        return rows.withColumn("__r", f(src).over(wx)).withColumn(dst, f("__r").over(wy)).drop("__r")

    if op in one:
        return step(df, one[op], value, out)
    order = {"open": ("erode", "dilate"), "close": ("dilate", "erode")}[op]
    return step(step(df, one[order[0]], value, "__m"), one[order[1]], "__m", out).drop("__m")


def adjacent(df: DataFrame, diagonal: bool = False, by: Sequence[str] = ("z",)) -> DataFrame:
    """Pairs of present cells: ``by, y, x, ny, nx``, each pair once.

    Straight neighbours come from windows along rows and columns; diagonals
    need the row below and are joined by place.
    """
    pairs = []
    for axis in ("x", "y"):
        across, along = AXES[axis]
        w = Window.partitionBy(*by, across).orderBy(along)
        nxt = df.select(*by, "y", "x").withColumn("__n", F.lead(along).over(w)).filter(F.col("__n") == F.col(along) + 1)
        pairs.append(nxt.select(*by, "y", "x", *((F.col("y").alias("ny"), F.col("__n").alias("nx")) if axis == "x" else (F.col("__n").alias("ny"), F.col("x").alias("nx")))))
    if diagonal:
        below = df.select(*by, (F.col("y")).alias("ny"), F.col("x").alias("nx"))
        for d in (-1, 1):
            here = df.select(*by, "y", "x", (F.col("y") + 1).alias("ny"), (F.col("x") + d).alias("nx"))
            pairs.append(here.join(below, [*by, "ny", "nx"]).select(*by, "y", "x", "ny", "nx"))
    return reduce(lambda a, b: a.unionByName(b), pairs)


def cell_id(z: Column, y: Column, x: Column, side: int = 1 << 20) -> Column:
    """Raster-order id of a cell: slice, row, column."""
    return (z.cast("long") * side + y) * side + x


def with_runs(df: DataFrame, item: str = "z") -> DataFrame:
    """Adds ``run``, the id of the first cell of the row's run that a cell is in, and ``run_last``, true at its end."""
    w = Window.partitionBy(item, "y").orderBy("x")
    opens = F.coalesce(F.lag("x").over(w) != F.col("x") - 1, F.lit(True))
    closes = F.coalesce(F.lead("x").over(w) != F.col("x") + 1, F.lit(True))
    first = F.max(F.when(F.col("__opens"), F.col("x"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__opens", opens).withColumn("run_last", closes).withColumn("run", cell_id(F.col(item), F.col("y"), first)).drop("__opens")


def run_edges(runs: DataFrame, diagonal: bool, item: str = "z") -> DataFrame:
    """``u, v``: runs of neighbouring rows that touch.

    Below one another is a window along the column.  Of the diagonals only
    those beyond the ends of a run matter: inside it the cell beside is below.
    """
    w = Window.partitionBy(item, "x").orderBy("y")
    above = F.when(F.lag("y").over(w) == F.col("y") - 1, F.lag("run").over(w))
    edges = runs.select(F.col("run").alias("u"), above.alias("v")).filter("v IS NOT NULL")
    if diagonal:
        upper = runs.select(item, (F.col("y") + 1).alias("y"), "x", F.col("run").alias("v"))
        starts = runs.filter(F.col("run") == cell_id(F.col(item), F.col("y"), F.col("x"))).select(item, "y", (F.col("x") - 1).alias("x"), F.col("run").alias("u"))
        ends = runs.filter("run_last").select(item, "y", (F.col("x") + 1).alias("x"), F.col("run").alias("u"))
        edges = edges.union(starts.union(ends).join(upper, [item, "y", "x"]).select("u", "v"))
    return edges.distinct()


def label_components(df: DataFrame, slice_: str = "z", connectivity: int = 4, keep: Sequence[str] = ()) -> DataFrame:
    """``z, y, x, component`` with ids 1, 2, ... a slice in raster order of their first cell.

    The graph has one node a run of a row, not one a cell.
    """
    runs = with_runs(df.select(slice_, "y", "x", *keep), slice_)
    roots = connected_components(run_edges(runs, connectivity == 8, slice_)).withColumnRenamed("node", "run").withColumnRenamed("component", "__linked")
    cells = runs.join(roots, "run", "left").withColumn("__root", F.coalesce("__linked", "run"))
    # Numbering needs one row a component, not one a cell.
    ranks = cells.select(slice_, "__root").distinct().withColumn("component", F.row_number().over(Window.partitionBy(slice_).orderBy("__root")))
    return cells.join(ranks, [slice_, "__root"]).select(slice_, "y", "x", *keep, "component")


def halve(df: DataFrame, value: str, by: Sequence[str] = ("z",)) -> DataFrame:
    """Means of 2x2 boxes; boxes that an odd edge leaves incomplete are dropped."""
    boxes = df.groupBy(*by, F.expr("y div 2").cast("int").alias("y"), F.expr("x div 2").cast("int").alias("x"))
    return boxes.agg(F.avg(value).alias(value), F.count("*").alias("__n")).filter("__n = 4").drop("__n")


def moving_average(df: DataFrame, order: str, value: str, width: int, out: str = "smooth", by: Sequence[str] = ()) -> DataFrame:
    """Mean over an odd width, the end values repeated beyond the ends."""
    if width % 2 == 0:
        raise ValueError("the width is odd")
    h = width // 2
    w = Window.partitionBy(*by).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = F.row_number().over(w), F.count("*").over(whole)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    before, after = F.greatest(h - i + 1, F.lit(0)), F.greatest(h - (n - i), F.lit(0))
    return df.withColumn(out, (F.sum(value).over(w.rowsBetween(-h, h)) + before * first + after * last) / width)


#: Filters by name; each takes a frame, the value column and its parameters.
FILTERS: dict[str, Callable[..., DataFrame]] = {
    "none": lambda df, value, out="out": df.withColumn(out, F.col(value)),
    "blur": lambda df, value, sigma, out="out": gaussian(df, value, sigma, out),
    "derivative": lambda df, value, sigma, orders, out="out": gaussian(df, value, sigma, out, orders),
    "laplacian": lambda df, value, sigma, out="out": laplacian(df, value, sigma, out),
    "zero_crossings": lambda df, value, sigma, out="out": zero_crossings(df, value, sigma, out),
    "gradmag": lambda df, value, sigma, out="out": gradient_magnitude(df, value, sigma, out),
    "erode": lambda df, value, radius, out="out": morphology(df, value, "erode", radius, out),
    "dilate": lambda df, value, radius, out="out": morphology(df, value, "dilate", radius, out),
    "open": lambda df, value, radius, out="out": morphology(df, value, "open", radius, out),
    "close": lambda df, value, radius, out="out": morphology(df, value, "close", radius, out),
}


def filter_chain(df: DataFrame, value: str, steps: Sequence[tuple[str, dict]], out: str = "out") -> DataFrame:
    """Filters applied one after the other; an empty chain copies the value."""
    current, name = df, value
    for k, (op, parameters) in enumerate(steps):
        if op not in FILTERS:
            raise ValueError(f"unknown filter {op!r}; there are {sorted(FILTERS)}")
        nxt = f"__f{k}"
        current = FILTERS[op](current, name, out=nxt, **parameters)
        current, name = (current.drop(name) if name.startswith("__f") else current), nxt
    return current.withColumn(out, F.col(name)).drop(*([name] if name != value else []))


def measurement_bank(df: DataFrame, value: str, sigmas: Sequence[float]) -> DataFrame:
    """Blur, gradient magnitude, Laplacian and Hessian eigenvalues per scale, two passes in all.

    All kernels of all scales share the same two windows.
    """
    rows = convolve(df, "x", {f"__{o}{i}": (value, kernel(s, o), o == 0) for i, s in enumerate(sigmas) for o in range(3)})
    wanted = {"smooth": (0, 0), "dx": (1, 0), "dy": (0, 1), "dxx": (2, 0), "dxy": (1, 1), "dyy": (0, 2)}
    both = convolve(rows, "y", {f"__{n}{i}": (f"__{ox}{i}", kernel(s, oy), oy == 0) for i, s in enumerate(sigmas) for n, (ox, oy) in wanted.items()})
    out = []
    for i, s in enumerate(sigmas):
        c = {n: F.col(f"__{n}{i}") for n in wanted}
        out += [
            c["smooth"].alias(f"blur_s{s:g}"),
            F.sqrt(c["dx"] ** 2 + c["dy"] ** 2).alias(f"gradmag_s{s:g}"),
            (c["dxx"] + c["dyy"]).alias(f"laplacian_s{s:g}"),
            symmetric_eigenvalue(c["dxx"], c["dxy"], c["dyy"]).alias(f"hessian_largest_s{s:g}"),
            symmetric_eigenvalue(c["dxx"], c["dxy"], c["dyy"], False).alias(f"hessian_smallest_s{s:g}"),
        ]
    return both.select(*df.columns, *out)
