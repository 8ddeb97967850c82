"""What an application supplies: items, records, images and labels, as DataFrames."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame


class Catalogue(Protocol):
    def items(self) -> DataFrame:
        """``item`` and what describes it, in display order."""


class Records(Protocol):
    def record(self, item: str, commit: int) -> DataFrame:
        """The region table of an item at a commit."""


class Images(Protocol):
    def read_region(self, item: str, level: int, y: int, x: int, h: int, w: int) -> DataFrame:
        """``y, x`` and the planes of a rectangle."""


class Labels(Protocol):
    def label_at(self, item: str, level: int) -> DataFrame:
        """``y, x, label`` of an item; background is -1."""


PROTOCOLS = {"catalogue": "items", "records": "record", "images": "read_region", "labels": "label_at"}
