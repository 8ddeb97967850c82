"""Feature schemas derived from a specification, without looking at data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.scalars import channel_name

REDUCTIONS = ("mean", "min", "max", "std")
BOXES = ("bbox_w", "bbox_h", "min_x", "max_x", "min_y", "max_y")
#: Kinds of derived channels; those with two values are given per eigenvalue.
KINDS = {"blur": 1, "gradmag": 1, "laplacian": 1, "hessian": 2, "chgradmag": 1, "dizenzo": 2}


@dataclass(frozen=True)
class Channel:
    """A named channel, the column that it is read from, and its reductions and histogram range."""

    name: str
    column: str
    reductions: tuple[str, ...] = REDUCTIONS
    bins: int = 0
    low: float = 0.0
    high: float = 1.0


@dataclass(frozen=True)
class Request:
    """Derived channels: a kind at scales, of planes, of a named source."""

    kind: str
    sigmas: tuple[float, ...]
    planes: tuple[int, ...] = ()
    source: str | None = None


def expand(requests: Sequence[Request], planes: int = 0) -> list[str]:
    """Channel names: base, filtered, raw planes, then the requests in order, scale by scale, plane by plane."""
    names = ["base", "filtered", *[f"raw_c{k}" for k in range(planes)]]
    for r in requests:
        if r.kind not in KINDS:
            raise ValueError(f"unknown channel kind {r.kind!r}; there are {sorted(KINDS)}")
        which = ("largest", "smallest") if KINDS[r.kind] == 2 else (None,)
        names += [channel_name(r.kind, s, p, r.source, w) for s in r.sigmas for p in (r.planes or (None,)) for w in which]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"channels given twice: {repeated}")
    return names


def schema_2d(channels: Sequence[Channel], relevance: bool = False, extremum: bool = False) -> T.StructType:
    """Fields of the 2D feature table in their fixed order, with channel and reduction as metadata."""
    fields = [T.StructField("feature_id", T.LongType()), T.StructField("area", T.LongType())]
    fields += [T.StructField(b, T.LongType()) for b in BOXES]

    def add(name: str, channel: str, reduction: str) -> None:
        fields.append(T.StructField(name, T.DoubleType(), metadata={"channel": channel, "reduction": reduction}))

    for c in channels:
        for r in c.reductions:
            add(f"{r}_{c.name}", c.name, r)
        if relevance and c.name == "base":
            add("relevance_base", "base", "relevance")
    if extremum:
        for name in ("ext_x", "ext_y"):
            fields.append(T.StructField(name, T.LongType()))
        for c in channels:
            add(f"ext_{c.name}", c.name, "ext")
    for c in channels:
        for k in range(c.bins):
            add(f"hist{k:02d}_{c.name}", c.name, f"hist{k:02d}")
    return T.StructType(fields)


def compose_field(reduction: str, channel: str) -> str:
    return f"{reduction}_{channel}"


def split_field(name: str, schema: T.StructType) -> tuple[str, str] | None:
    """``(channel, reduction)`` of a field, None for positional ones."""
    meta = schema[name].metadata if name in schema.names else {}
    return (meta["channel"], meta["reduction"]) if meta else None


def feature_table(pixels: DataFrame, channels: Sequence[Channel], by: Sequence[str], boxes: Sequence[str] = BOXES) -> DataFrame:
    """Regions by channels: only what is asked for is accumulated."""
    box = {
        "bbox_w": F.max("x") - F.min("x") + 1, "bbox_h": F.max("y") - F.min("y") + 1,
        "min_x": F.min("x"), "max_x": F.max("x"), "min_y": F.min("y"), "max_y": F.max("y"),
    }
    reduce_ = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop}
    aggs = [F.count("*").alias("area"), *[box[b].alias(b) for b in boxes]]
    for c in channels:
        aggs += [reduce_[r](c.column).alias(compose_field(r, c.name)) for r in c.reductions]
    from gridloom.operators.stats import bin_of

    for c in channels:
        if c.bins:
            b = bin_of(F.col(c.column), c.low, c.high, c.bins)
            aggs += [(F.count_if(b == k) / F.count("*")).alias(f"hist{k:02d}_{c.name}") for k in range(c.bins)]
    return pixels.groupBy(*by).agg(*aggs)


@dataclass(frozen=True)
class Stage:
    """A filter of a chain and whether it needs, and makes, planes (many) or one scalar."""

    op: str
    takes: str = "scalar"
    makes: str = "scalar"
    parameters: dict = field(default_factory=dict, hash=False)


def plan_chain(stages: Sequence[Stage], planes: int, convert: str = "front") -> list[tuple[str, str]]:
    """Arity plan ``(op, how)``: plane stages run whole, scalar ones on each plane (lifted) or on the scalar.

    A chain that would not end scalar gets a conversion: at the ``front`` or the
    ``end``, or it raises where conversion is ``none``.
    """
    def ends_many(start_many: bool) -> bool:
        many = start_many
        for s in stages:
            if s.takes == "planes" and not many:
                raise ValueError(f"{s.op} needs planes after the chain became scalar")
            many = s.makes == "planes" if s.takes == "planes" else many
        return many

    many, out = planes > 1, []
    if many and not (convert == "front" and not any(s.takes == "planes" for s in stages)) and ends_many(True) and convert == "none":
        raise ValueError("the chain ends with several planes and conversion is off")
    if many and convert == "front" and not any(s.takes == "planes" for s in stages):
        out.append(("luminance", "convert"))
        many = False
    for s in stages:
        if s.takes == "planes":
            if not many:
                raise ValueError(f"{s.op} needs planes")
            out.append((s.op, "planes"))
            many = s.makes == "planes"
        else:
            out.append((s.op, "lifted" if many else "scalar"))
    if many:
        out.append(("luminance", "convert"))
    return out
