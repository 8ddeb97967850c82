"""Parsing, formatting, geometry and uncertainty expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel_name(kind: str, sigma: float | None = None, plane: int | None = None, source: str | None = None, which: str | None = None) -> str:
    """``[source_]kind[_which][_s<sigma>][_c<plane>]``."""
    parts = [p for p in (source, kind, which) if p]
    if sigma is not None:
        parts.append(f"s{sigma:g}")
    if plane is not None:
        parts.append(f"c{plane}")
    return "_".join(parts)


def parse_range(text: Column) -> Column:
    """``START:END`` to ``struct<start, stop>``; null where it isn't one."""
    parts = F.split(F.trim(text), ":")
    start, stop = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    return F.when((F.size(parts) == 2) & start.isNotNull() & stop.isNotNull() & (start <= stop), F.struct(start.alias("start"), stop.alias("stop")))


def parse_numbers(text: Column, separators: str = r"[,;\s]+") -> Column:
    """Numbers of a list; what doesn't parse is left out."""
    return F.filter(F.transform(F.split(F.trim(text), separators), lambda t: t.try_cast("double")), lambda v: v.isNotNull())


def downsample_factor(name: Column) -> Column:
    """Factor of a file name such as ``a_ds4.csv`` or ``a_full.csv``; null if it has none."""
    n = F.nullif(F.regexp_extract(F.lower(name), r"(?:ds|down|factor)[_-]?([0-9]+)", 1), F.lit("")).try_cast("int")
    return F.when(n.isNotNull(), n).when(F.lower(name).contains("full"), 1)


def item_key(slide: Column, level: Column, y0: Column, y1: Column, x0: Column, x1: Column) -> Column:
    return F.concat(slide, F.lit("@"), level.cast("string"), F.lit("["), F.concat_ws(",", *[c.cast("string") for c in (y0, y1, x0, x1)]), F.lit("]"))


def parse_item_key(key: Column) -> Column:
    pattern = r"^(.*)@(\d+)\[(\d+),(\d+),(\d+),(\d+)\]$"
    part = lambda k: F.nullif(F.regexp_extract(key, pattern, k), F.lit("")).try_cast("int")
    names = ("level", "y0", "y1", "x0", "x1")
    return F.when(key.rlike(pattern), F.struct(F.regexp_extract(key, pattern, 1).alias("slide"), *[part(k + 2).alias(n) for k, n in enumerate(names)]))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def context_parts(name: Column) -> Column:
    """``kind[weight]__source`` to its parts."""
    pattern = r"^([a-z0-9_]+?)(?:\[([a-z]+)\])?__(.+)$"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return F.when(name.rlike(pattern), F.struct(part(1).alias("kind"), F.coalesce(part(2), F.lit("uniform")).alias("weight"), part(3).alias("source")))


def polyline_length(points: Column) -> Column:
    """Length of ``ARRAY<STRUCT<x, y>>``."""
    steps = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2))
    return F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + v)


def chord(points: Column) -> Column:
    a, b = F.element_at(points, 1), F.element_at(points, -1)
    return F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2)


def tortuosity(points: Column) -> Column:
    """Length over chord; 1 for a closed line."""
    return F.coalesce(F.try_divide(polyline_length(points), chord(points)), F.lit(1.0))


def is_loop(points: Column) -> Column:
    a, b = F.element_at(points, 1), F.element_at(points, -1)
    return (F.size(points) > 2) & (a["x"] == b["x"]) & (a["y"] == b["y"])


def without_collinear(points: Column) -> Column:
    """Corner points only: a point between two in line with it goes."""
    n = F.size(points)

    def bend(p: Column, i: Column) -> Column:
        a, b = F.get(points, i - 1), F.get(points, i + 1)
        cross = (p["x"] - a["x"]) * (b["y"] - p["y"]) - (p["y"] - a["y"]) * (b["x"] - p["x"])
        return (i == 0) | (i == n - 1) | (cross != 0)

    return F.filter(points, bend)


def entropy(p: Column) -> Column:
    """Normalised to [0, 1]."""
    h = F.aggregate(p, F.lit(0.0), lambda acc, v: acc - F.when(v > 0, v * F.log(v)).otherwise(0.0))
    return F.coalesce(F.try_divide(h, F.log(F.size(p).cast("double"))), F.lit(0.0))


def margin(p: Column) -> Column:
    """One minus the lead of the best class."""
    s = F.array_sort(p)
    return 1 - (F.element_at(s, -1) - F.coalesce(F.try_element_at(s, F.lit(-2)), F.lit(0.0)))


def confidence(p: Column) -> Column:
    return 1 - F.array_max(p)


def blend(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    total = sum(weights.values()) or 1.0
    return sum((parts[k] * (w / total) for k, w in weights.items()), F.lit(0.0))


def dense(x: Column, weights: list[list[float]], bias: list[float], activation: str = "relu") -> Column:
    """One layer of a dense network as an expression."""
    act = {"relu": lambda v: F.greatest(v, F.lit(0.0)), "tanh": F.tanh, "logistic": lambda v: 1 / (1 + F.exp(-v)), "identity": lambda v: v}[activation]
    row = lambda w, b: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda p, q: p * q), F.lit(float(b)), lambda acc, v: acc + v)
    return F.array(*[act(row(w, b)) for w, b in zip(weights, bias)])


def clean_scaled(value: Column, mean: float, std: float, log: bool = False) -> Column:
    """Log where asked, standardised, 0 where not finite."""
    v = F.log1p(F.greatest(value, F.lit(0.0))) if log else value
    z = (v - mean) / (std if std > 0 else 1.0)
    return F.when(z.isNull() | F.isnan(z) | (F.abs(z) == math.inf), 0.0).otherwise(z)


def digest(*parts: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length)


def hue_of(ident: Column) -> Column:
    """Golden-ratio hue in [0, 1) of an id."""
    v = ident.cast("double") * 0.6180339887498949
    return v - F.floor(v)


def human_bytes(n: Column, units: Sequence[str] = ("KB", "MB", "GB", "TB")) -> Column:
    """Bytes, or 1024 of the unit before; what is beyond the last unit stays in it."""
    out = F.format_string("%.0f B", n.cast("double"))
    for k, unit in enumerate(units, 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", F.bround(n / float(1024**k), 1))).otherwise(out)
    return out


def clock(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", (s / 3600).cast("long"), ((s % 3600) / 60).cast("long"), s % 60)


def pair_key(a: Column, b: Column, base: int) -> Column:
    return F.least(a, b).cast("long") * base + F.greatest(a, b)
