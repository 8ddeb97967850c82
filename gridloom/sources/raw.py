"""Raw float32 volumes with their dimensions in a sidecar or in the file name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = r"_(\d+)x(\d+)x(\d+)\.raw$"


def dims_from_name(path: Column) -> Column:
    """``struct<nx, ny, nz>`` of ``..._XxYxZ.raw``; null where the name has none."""
    part = lambda k: F.regexp_extract(path, NAME, k).try_cast("int")
    return F.when(path.rlike(NAME), F.struct(part(1).alias("nx"), part(2).alias("ny"), part(3).alias("nz")))


def read_volumes(spark: SparkSession, path: str, dims: tuple[int, int, int] | None = None) -> DataFrame:
    """``path, z, y, x, v``; a file that is shorter than its dimensions raises."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.raw").load(path)
    d = F.struct(*[F.lit(v).alias(n) for n, v in zip(("nx", "ny", "nz"), dims)]) if dims else dims_from_name(F.col("path"))
    named = files.select("path", "content", d.alias("d")).select("path", "content", "d.nx", "d.ny", "d.nz")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if pd.isna(r.nx):
                    raise ValueError(f"no dimensions for {r.path}")
                nx, ny, nz = int(r.nx), int(r.ny), int(r.nz)
                if len(r.content) < 4 * nx * ny * nz:
                    raise ValueError(f"{r.path} is too short for {nx} x {ny} x {nz}")
                volume = np.frombuffer(r.content, "<f4", count=nx * ny * nz).reshape(nz, ny, nx)
                for z in range(nz):
                    yield pd.DataFrame({"path": r.path, "z": np.int32(z), "y": np.repeat(np.arange(ny, dtype=np.int32), nx), "x": np.tile(np.arange(nx, dtype=np.int32), ny), "v": volume[z].ravel()})

    return named.mapInPandas(rows, "path string, z int, y int, x int, v float")


def encode_slices(pixels: DataFrame, value: str, width: int, height: int, item: str = "z", kind: str = "<i4") -> DataFrame:
    """``item, content``: rows of each slice, little-endian int32 unless told otherwise, 0 where no cell is."""
    key = pixels.schema[item].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((height, width), kind)
        grid[pdf["y"], pdf["x"]] = pdf[value]
        return pd.DataFrame({item: [pdf[item].iloc[0]], "content": [grid.tobytes()]})

    return pixels.select(item, "y", "x", value).groupBy(item).applyInPandas(pack, f"{item} {key}, content binary")
