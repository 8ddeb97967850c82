"""Table functions for SQL users."""

from __future__ import annotations


def image_regions():
    """``image_regions(cells ARRAY<STRUCT<label, v>>)``: ``label, area, total`` per region of one image."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="label int, area bigint, total double")
    class ImageRegions:
        def eval(self, cells):
            found: dict[int, list[float]] = {}
            for c in cells or []:
                found.setdefault(c["label"], []).append(c["v"])
            for label, values in found.items():
                yield label, len(values), float(sum(values))

    return ImageRegions
