"""Registered queries of the reference's own operators."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from gridloom.catalog import REGISTRY

MODULES = ("aggregates", "relational", "rasters", "graphs", "models", "more", "surface")


def _load() -> None:
    for name in MODULES:
        import_module(f"gridloom.catalog.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql}


def entry_global_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.catalog.graphs import entry_global_table as table

    return table(spark, sf_dir)
