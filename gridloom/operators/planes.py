"""Plane algebra: expressions over ``planes ARRAY<DOUBLE>`` or single columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Luminance weights of red, green and blue.
LUMINANCE = (0.2126, 0.7152, 0.0722)
#: Unit stain vectors in optical density, a row a stain; None is completed by the cross product.
STAINS = {
    "he": ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), None),
    "hdab": ((0.65, 0.70, 0.29), (0.27, 0.57, 0.78), None),
    "hed": ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78)),
}


def _dot(planes: Column, weights: Sequence[float]) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(planes, w, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def pick(planes: Column, k: int) -> Column:
    return F.get(planes, F.lit(k))


def luminance(planes: Column) -> Column:
    return _dot(F.slice(planes, 1, 3), LUMINANCE)


def weighted_sum(planes: Column, weights: Sequence[float]) -> Column:
    return _dot(planes, weights)


def reduce_planes(planes: Column, how: str, weights: Sequence[float] | None = None) -> Column:
    """``mean sum max min norm first``; a weighted mean divides by the number of planes."""
    values = planes if weights is None else F.zip_with(planes, F.array(*[F.lit(float(x)) for x in weights]), lambda a, b: a * b)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    ways = {
        "mean": lambda: total / F.size(planes),
        "sum": lambda: total,
        "max": lambda: F.array_max(values),
        "min": lambda: F.array_min(values),
        "norm": lambda: F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x)),
        "first": lambda: F.get(values, F.lit(0)),
    }
    if how not in ways:
        raise ValueError(f"unknown reduction {how!r}; there are {sorted(ways)}")
    return ways[how]()


def select_planes(planes: Column, order: Sequence[int]) -> Column:
    return F.array(*[F.get(planes, F.lit(k)) for k in order])


def project_planes(planes: Column, rows: Sequence[Sequence[float]]) -> Column:
    """A linear map, one weight row an output plane."""
    return F.array(*[_dot(planes, r) for r in rows])


def hsv(r: Column, g: Column, b: Column, part: str) -> Column:
    """Hue in degrees, saturation or value; grey has hue 0, black saturation 0."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span = hi - lo
    if part == "value":
        return hi
    if part == "saturation":
        return F.when(hi > 0, F.try_divide(span, hi)).otherwise(0.0)
    turn = F.when(hi == r, F.try_divide(g - b, span)).when(hi == g, F.try_divide(b - r, span) + 2).otherwise(F.try_divide(r - g, span) + 4)
    hue = turn * 60
    return F.when(span == 0, 0.0).when(hue < 0, hue + 360).otherwise(hue)


def optical_density(value: Column, white: Column, eps: float = 1.0) -> Column:
    return -F.log10(F.greatest(value, F.lit(eps)) / white)


def with_density(df: DataFrame, planes: Sequence[str], by: Sequence[str] = ("z",), eps: float = 1.0) -> DataFrame:
    """``od_<plane>`` against the plane's maximum in the slice."""
    w = Window.partitionBy(*by)
    return df.select("*", *[optical_density(F.col(p), F.greatest(F.max(p).over(w), F.lit(eps)), eps).alias(f"od_{p}") for p in planes])


def stain_matrix(preset: str) -> np.ndarray:
    """Unit stain rows of a preset; a missing third is the cross product of the others."""
    rows = [None if r is None else np.asarray(r, float) / math.sqrt(sum(x * x for x in r)) for r in STAINS[preset]]
    if rows[2] is None:
        rest = np.cross(rows[0], rows[1])
        rows[2] = rest / np.linalg.norm(rest)
    return np.stack(rows)


def unmix(densities: Column, preset: str) -> Column:
    """Stain amounts from three densities by the inverse stain matrix."""
    return project_planes(densities, np.linalg.inv(stain_matrix(preset)).T.tolist())


def two_point(value: Column, low: Column, high: Column, clamp: bool = False) -> Column:
    """Maps low to 0 and high to 1; unchanged where they agree or one is missing."""
    scaled = F.try_divide(value - low, high - low)
    if clamp:
        scaled = F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))
    return F.when(low.isNull() | high.isNull() | (low == high), value).otherwise(scaled)


def void_posterior(value: Column, mean_void: float, mean_rest: float, variance: float, weight_void: float = 0.5, masked: Column | None = None) -> Column:
    """Posterior of the void component under a pooled variance; 0 where masked."""
    delta = ((value - mean_rest) ** 2 - (value - mean_void) ** 2) / (2 * variance) + math.log(weight_void / (1 - weight_void))
    p = 1 / (1 + F.exp(-delta))
    return p if masked is None else F.when(masked, 0.0).otherwise(p)


def channel_gradient(gradients: Sequence[tuple[Column, Column]]) -> Column:
    """Root of the summed squared gradients of all channels."""
    return F.sqrt(sum((gx * gx + gy * gy for gx, gy in gradients[1:]), gradients[0][0] ** 2 + gradients[0][1] ** 2))


def di_zenzo(gradients: Sequence[tuple[Column, Column]], largest: bool = True) -> Column:
    """Eigenvalue of the summed 2x2 gradient tensor."""
    total = lambda f: sum((f(*g) for g in gradients[1:]), f(*gradients[0]))
    return symmetric_eigenvalue(total(lambda x, y: x * x), total(lambda x, y: x * y), total(lambda x, y: y * y), largest)


def symmetric_eigenvalue(a: Column, b: Column, c: Column, largest: bool = True) -> Column:
    """Eigenvalue of ``[[a, b], [b, c]]``."""
    half, root = (a + c) / 2, F.sqrt(((a - c) / 2) ** 2 + b * b)
    return half + root if largest else half - root


def placed(x: Column, origin: float, scale: float) -> Column:
    """Raster coordinate to the coordinate of the slide."""
    return x * scale + origin


def smallest_integer(df: DataFrame, column: str) -> str:
    """Name of the smallest integer type that holds a column without loss; double if none does."""
    low, high, whole = df.agg(F.min(column), F.max(column), F.bool_and(F.col(column) == F.floor(column))).first()
    if low is None or not whole:
        return "double"
    return next((t for t, k in (("byte", 7), ("short", 15), ("int", 31), ("long", 63)) if -(2**k) <= low and high < 2**k), "double")
