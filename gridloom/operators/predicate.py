"""NaN-safe predicate chains over feature tables.

A predicate that meets NaN or null is false, also under Spark's ordering where
NaN is the largest value.  Chains are conjunctions.  A field that the table
doesn't have fails its chain, or raises where ``strict``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.ranking import global_rank

OPS = ("lt", "le", "gt", "ge", "eq", "between")
_SIGNS = {"<": "lt", "<=": "le", ">": "gt", ">=": "ge", "==": "eq"}


@dataclass(frozen=True)
class Query:
    """``field op value``; ``between`` is inclusive and uses ``high`` too."""

    field: str
    op: str
    value: float
    high: float | None = None


def predicate(column: Column, op: str, value: float, high: float | None = None) -> Column:
    tests = {
        "lt": lambda: column < value,
        "le": lambda: column <= value,
        "gt": lambda: column > value,
        "ge": lambda: column >= value,
        "eq": lambda: column == value,
        "between": lambda: (column >= value) & (column <= (value if high is None else high)),
    }
    if op not in tests:
        return F.lit(False)
    number = column.cast("double")
    return F.coalesce(tests[op]() & ~F.isnan(number), F.lit(False))


def chain(df: DataFrame, queries: Iterable[Query], strict: bool = False) -> Column:
    """The conjunction as a column; an empty chain is true."""
    queries = list(queries)
    missing = [q.field for q in queries if q.field not in df.columns]
    if missing and strict:
        raise ValueError(f"unknown fields {missing}; the table has {df.columns}")
    if missing:
        return F.lit(False)
    return reduce(lambda a, b: a & b, (predicate(F.col(q.field), q.op, q.value, q.high) for q in queries), F.lit(True))


def select_rows(df: DataFrame, queries: Iterable[Query], strict: bool = False) -> DataFrame:
    return df.filter(chain(df, queries, strict))


def chain_on_map(entries: Column, queries: Iterable[Query]) -> Column:
    """The same over a ``MAP<STRING, DOUBLE>`` row; an absent key is false."""
    return reduce(lambda a, b: a & b, (predicate(F.try_element_at(entries, F.lit(q.field)), q.op, q.value, q.high) for q in queries), F.lit(True))


@dataclass(frozen=True)
class Gate:
    """Bounds on a segment table and lists of ids; None is no bound."""

    min_area: int | None = None
    max_area: int | None = None
    min_value: float | None = None
    max_value: float | None = None
    min_mean: float | None = None
    max_mean: float | None = None
    allow: Sequence[int] | None = None
    deny: Sequence[int] = ()


def gate(df: DataFrame, g: Gate, ident: str = "label") -> DataFrame:
    """Segments within the bounds, on the allow list if there is one and not denied."""
    tests = [
        (g.min_area, "area", "ge"), (g.max_area, "area", "le"), (g.min_value, "min_value", "ge"),
        (g.max_value, "max_value", "le"), (g.min_mean, "mean_value", "ge"), (g.max_mean, "mean_value", "le"),
    ]
    kept = select_rows(df, [Query(f, op, v) for v, f, op in tests if v is not None], strict=True)
    if g.allow is not None:
        kept = kept.filter(F.col(ident).isin(list(g.allow)))
    return kept.filter(~F.col(ident).isin(list(g.deny))) if g.deny else kept


@dataclass(frozen=True)
class PixelRule:
    """Keep or omit pixels that pass a predicate; NaN never passes, so it survives an omission."""

    query: Query
    keep: bool = True


def trim_pixels(df: DataFrame, rules: Iterable[PixelRule]) -> DataFrame:
    out = df
    for r in rules:
        test = chain(df, [r.query], strict=True)
        out = out.filter(test if r.keep else ~test)
    return out


def parse_rule(text: str) -> tuple[str, str, float]:
    """``FIELD OP NUMBER`` with one of ``< <= > >= == !=``."""
    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*(<=|>=|==|!=|<|>)\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*", text)
    if not m:
        raise ValueError(f"not a rule: {text!r}")
    return m[1], m[2], float(m[3])


def drop_matching(df: DataFrame, rule: str) -> DataFrame:
    """Rows that match the textual rule go; a field that is absent raises."""
    field, sign, value = parse_rule(rule)
    if field not in df.columns:
        raise ValueError(f"unknown field {field!r}; the table has {df.columns}")
    if sign == "!=":
        hit = F.coalesce((F.col(field) != value) | F.isnan(F.col(field).cast("double")), F.lit(False))
    else:
        hit = predicate(F.col(field), _SIGNS[sign], value)
    return df.filter(~hit)


def is_data(value: Column, omit: float | None = None) -> Column:
    """Finite, and not the sentinel."""
    number = value.cast("double")
    ok = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return ok if omit is None else ok & (number != omit)


def percentile_trim(df: DataFrame, value: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """Values within the q-th and (100 - q)-th linear percentile, inclusive, by group."""
    bounds = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(q / 100), F.lit(1 - q / 100))).alias("__b"))
    joined = df.join(bounds, list(by)) if by else df.crossJoin(F.broadcast(bounds))
    return joined.filter(F.col(value).between(F.col("__b")[0], F.col("__b")[1])).drop("__b")


def crop(df: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Rows ``[y0, y1)`` and columns ``[x0, x1)``; an empty or negative box raises."""
    if not (0 <= y0 < y1 and 0 <= x0 < x1):
        raise ValueError("a rectangle has positive size and no negative corner")
    return df.filter((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))


def subsample(df: DataFrame, key: str, factor: int, seed: int = 0) -> DataFrame:
    """One row in ``factor``, rounded down, and at least ten (or all there are): those of least seeded hash of the unique ``key``."""
    if factor <= 1:
        return df
    ranked = global_rank(df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))), "__h", key, out="__r")
    total = ranked.agg(F.greatest(F.floor(F.count("*") / factor), F.lit(10)).alias("__most"))
    return ranked.crossJoin(F.broadcast(total)).filter(F.col("__r") <= F.col("__most")).drop("__h", "__r", "__most")


def drop_regions(rows: DataFrame, arcs: DataFrame, rule: str, ident: str = "label") -> tuple[DataFrame, DataFrame]:
    """Surviving rows, and arcs with both ends among them."""
    kept = drop_matching(rows, rule)
    ids = kept.select(F.col(ident).alias("__id"))
    both = arcs.join(ids, F.col("a") == F.col("__id"), "left_semi").join(ids, F.col("b") == F.col("__id"), "left_semi")
    return kept, both
