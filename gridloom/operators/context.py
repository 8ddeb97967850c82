"""Context columns: what surrounds a region, by kind, weighting and source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import graph

RING = ("ring_mean", "ring_min", "ring_max", "ring_std", "ring_contrast")
KINDS = (*RING, "hop2_mean", "slice_mean", "slice_contrast")


def column_name(kind: str, source: str, how: str = "uniform") -> str:
    return f"{kind}{'' if how == 'uniform' else f'[{how}]'}__{source}"


def sources_of(table: DataFrame, which: str) -> list[str]:
    """``all`` numeric columns that aren't positional, ``ext`` or ``mean`` ones; never context columns."""
    positional = {"z", "label", "feature_id", "class", "min_x", "max_x", "min_y", "max_y", "ext_x", "ext_y", "ext_z"}
    names = [c for c, t in table.dtypes if t in ("double", "float", "bigint", "int") and c not in positional and "__" not in c]
    return [c for c in names if which == "all" or c.startswith(f"{which}_")]


def augment(table: DataFrame, arcs: DataFrame, kinds: Sequence[str], how: Sequence[str] = ("uniform",), sources: Sequence[str] | None = None, by: Sequence[str] = ("z",)) -> DataFrame:
    """``table`` with context columns in the order kind, weighting, source; the same table for no kinds.

    Slice kinds know uniform and area weights and take uniform ones otherwise.
    """
    if not kinds:
        return table
    unknown = [k for k in kinds if k not in KINDS]
    if unknown:
        raise ValueError(f"unknown context kinds {unknown}; there are {KINDS}")
    sources = list(sources if sources is not None else sources_of(table, "all"))
    parts, names = table, []
    for w in how:
        slice_w = w if w in ("uniform", "area") else "uniform"
        made: dict[str, dict[str, str]] = {}
        if any(k in RING for k in kinds):
            got = graph.ring(table, arcs, sources, w, by)
            made |= {k: {s: f"{k}_{s}" for s in sources} for k in RING}
            parts = parts.join(got.select(*by, "label", *[F.col(f"{k}_{s}").alias(column_name(k, s, w)) for k in kinds if k in RING for s in sources]), [*by, "label"])
        if "hop2_mean" in kinds:
            got = graph.hop2(table, arcs, sources, w, by)
            parts = parts.join(got.select(*by, "label", *[F.col(f"hop2_mean_{s}").alias(column_name("hop2_mean", s, w)) for s in sources]), [*by, "label"])
        if any(k.startswith("slice_") for k in kinds):
            got = graph.slice_context(table, sources, by, slice_w == "area")
            parts = parts.join(got.select(*by, "label", *[F.col(f"{k}_{s}").alias(column_name(k, s, w)) for k in kinds if k.startswith("slice_") for s in sources]), [*by, "label"])
    names = [column_name(k, s, w) for k in kinds for w in how for s in sources]
    return parts.select(*table.columns, *[F.col(f"`{n}`") for n in names])
