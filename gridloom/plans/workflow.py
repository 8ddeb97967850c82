"""Workflow documents: filter, decompose, simplify, select, link."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import linking, topology
from gridloom.operators.predicate import OPS, Query, select_rows
from gridloom.operators.raster import FILTERS, filter_chain
from gridloom.plans.durable import durable

#: Decompositions by name: pixels with a value to pixels with a ``region`` each.
STRATEGIES: dict[str, Callable[[DataFrame, "Workflow"], DataFrame]] = {}


def strategy(name: str) -> Callable:
    def register(f: Callable) -> Callable:
        STRATEGIES[name] = f
        return f

    return register


@dataclass(frozen=True)
class Workflow:
    filters: tuple[tuple[str, dict], ...] = ()
    segmentation: str = "basin"
    persistence: float | None = None
    persistence_percent: float | None = None
    queries: tuple[Query, ...] = ()
    connectivity: int = 6
    unknown: tuple[str, ...] = field(default=(), compare=False)


def parse(document: dict) -> Workflow:
    """A document to a workflow; what can't run is refused here, with what would do."""
    filters = tuple((f["op"], {k: v for k, v in f.items() if k != "op"}) for f in document.get("filters", []))
    for op, _ in filters:
        if op not in FILTERS:
            raise ValueError(f"unknown filter {op!r}; there are {sorted(FILTERS)}")
    seg = document.get("segmentation", "basin")
    if seg not in STRATEGIES:
        raise ValueError(f"unknown segmentation {seg!r}; there are {sorted(STRATEGIES)}")
    queries = tuple(Query(q["field"], q["op"], q["value"], q.get("high")) for q in document.get("queries", []))
    for q in queries:
        if q.op not in OPS:
            raise ValueError(f"unknown operator {q.op!r}; there are {OPS}")
        if q.field not in FIELDS:
            raise ValueError(f"unknown field {q.field!r}; there are {sorted(FIELDS)}")
    if document.get("connectivity", 6) not in linking.STEPS:
        raise ValueError("connectivity is 6, 18 or 26")
    simplify = document.get("simplify", {})
    known = {"filters", "segmentation", "queries", "connectivity", "simplify"}
    return Workflow(filters, seg, simplify.get("persistence"), simplify.get("percent"), queries, document.get("connectivity", 6), tuple(sorted(set(document) - known)))


FIELDS = ("area", "min_base", "max_base", "mean_base")


@strategy("null")
def one_region(pixels: DataFrame, w: Workflow) -> DataFrame:
    return pixels.withColumn("region", F.lit(0).cast("long"))


@strategy("basin")
def living_basins(pixels: DataFrame, w: Workflow) -> DataFrame:
    labelled = durable(topology.basins(pixels, "filtered"), "workflow-basins")
    table, arcs = topology.basin_table(labelled, "filtered"), topology.basin_arcs(labelled, "filtered")
    level = topology.threshold(labelled, w.persistence, w.persistence_percent, "filtered")
    alive = topology.living(topology.persistence(table, arcs), level)
    return labelled.join(alive, ["z", "basin"]).drop("basin").withColumnRenamed("living", "region")


def explain(w: Workflow) -> list[str]:
    """What a workflow would do, step by step."""
    steps = [f"filter {op} {p}" for op, p in w.filters] + [f"segment {w.segmentation}"]
    if w.persistence is not None or w.persistence_percent is not None:
        steps.append(f"simplify below {w.persistence if w.persistence is not None else f'{w.persistence_percent} %'}")
    return steps + [f"keep {q.field} {q.op} {q.value}" for q in w.queries] + [f"link {w.connectivity}", "global table"]


def run(pixels: DataFrame, w: Workflow, value: str = "v") -> dict[str, DataFrame]:
    """``regions``, ``selected`` cells and the ``features`` of a stack ``z, y, x, value``."""
    base = pixels.select("z", "y", "x", F.col(value).cast("double").alias("v"))
    filtered = filter_chain(base, "v", w.filters, "filtered")
    regions = durable(STRATEGIES[w.segmentation](filtered, w), "workflow-regions")
    table = regions.groupBy("z", "region").agg(F.count("*").alias("area"), F.min("v").alias("min_base"), F.max("v").alias("max_base"), F.avg("v").alias("mean_base"))
    kept = select_rows(table, w.queries, strict=True)
    cells = regions.join(kept.select("z", "region"), ["z", "region"], "left_semi").select("z", "y", "x", "v")
    linked = durable(linking.assign_global(linking.slice_components(cells, w.connectivity), w.connectivity), "workflow-linked")
    return {"regions": table, "selected": cells, "features": linking.global_table(linked), "map": linking.feature_map(linked)}
