"""A scan of TIFF rasters by tiles: strips or tiles, plain or compressed, either byte order.

Classic and big files, one page or many, chunky or planar; samples of 8, 16 or
32 bits, signed, unsigned or float, are widened to float32.  Anything else
raises with the name of the tag.

A scan has two steps.  The headers give a table of tiles, with the place and
length of their bytes; a box is a filter of that table.  Then tasks of about
``TASK_BYTES`` samples read the byte ranges of their tiles and nothing else.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.planes import reduce_planes
from gridloom.plans.durable import durable
from gridloom.plans.ranking import global_rank
from gridloom.sources import codecs

#: Bytes of the field types, their codes, and numpy codes by (sample format, bits).
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
FIELD_CODES = {1: "B", 2: "B", 3: "H", 4: "I", 5: "II", 13: "I", 16: "Q", 18: "Q"}
SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4"}
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, OFFSETS, COUNT, STRIP_ROWS, COUNTS, X_RESOLUTION, Y_RESOLUTION, PLANAR, PREDICTOR, FORMAT = 256, 257, 258, 259, 270, 273, 277, 278, 279, 282, 283, 284, 317, 339
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325

#: Samples a task, and bytes of one band of an uncompressed strip.
TASK_BYTES, BAND_BYTES = 64 << 20, 4 << 20
TILES = "path string, page int, tile int, y0 int, x0 int, height int, width int, rows int, columns int, samples int, planar boolean, code string, compression int, predictor int, offsets array<long>, sizes array<long>"
PIXELS = "path string, z int, y int, x int, planes array<float>"

Read = Callable[[int, int], bytes]
Tags = dict[int, list[int]]


def _pages(read: Read) -> Iterator[tuple[str, Tags]]:
    """Byte order and tags of each page, from ``read(offset, size)``."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack_from(f"{order}H", head, 2)[0] if order and len(head) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    word, n_code, entry, inline = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
    n_size, link_size = struct.calcsize(n_code), struct.calcsize(word)
    at, seen = struct.unpack_from(f"{order}{word}", head, 8 if big else 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the pages of the file go round in a ring")
        seen.add(at)
        n = struct.unpack(f"{order}{n_code}", read(at, n_size))[0]
        body = read(at + n_size, n * entry + link_size)
        tags: Tags = {}
        for k in range(n):
            tag, kind, many = struct.unpack_from(f"{order}HH{word}", body, entry * k)
            size, code = FIELD_SIZES.get(kind, 1) * many, FIELD_CODES.get(kind)
            if code is None:
                continue
            field = body[entry * (k + 1) - inline : entry * (k + 1)]
            if size > inline:
                field = read(struct.unpack(f"{order}{word}", field)[0], size)
            tags[tag] = list(struct.unpack_from(f"{order}{many if len(code) == 1 else 2 * many}{code[0]}", field))
        yield order, tags
        at = struct.unpack_from(f"{order}{word}", body, n * entry)[0]


@dataclass(frozen=True)
class Tile:
    """A block of a page: where it lies, its shape in the file and cut to the page, and its bytes by plane."""

    tile: int
    y0: int
    x0: int
    height: int
    width: int
    rows: int
    columns: int
    samples: int
    planar: bool
    code: str
    compression: int
    predictor: int
    offsets: Sequence[int]
    sizes: Sequence[int]

    def decode(self, read: Read) -> np.ndarray:
        """``(samples, height, width)`` as float32."""
        dtype, per = np.dtype(self.code), 1 if self.planar else self.samples
        need = self.rows * self.columns * per * dtype.itemsize
        parts = []
        for offset, size in zip(self.offsets, self.sizes):
            body = codecs.expand(read(int(offset), int(size)), self.compression)
            if len(body) < need:
                raise ValueError(f"a chunk holds {len(body)} bytes of samples, {need} are needed")
            block = np.frombuffer(body, dtype, count=need // dtype.itemsize).reshape(self.rows, self.columns, per)
            if self.predictor == 2:
                block = codecs.undo_differences(block.astype(dtype.newbyteorder("=")))
            parts.append(block[: self.height, : self.width].transpose(2, 0, 1))
        return np.concatenate(parts).astype(np.float32)


def _tiles(order: str, tags: Tags) -> Iterator[Tile]:
    one = lambda tag, other: tags.get(tag, [other])[0]
    samples, bits, form = one(COUNT, 1), one(BITS, 8), one(FORMAT, 1) or 1
    compression, predictor, planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2 and one(COUNT, 1) > 1
    if (form, bits) not in SAMPLES or len(set(tags.get(BITS, [8]))) > 1:
        raise ValueError(f"samples of format {form} and {tags.get(BITS, [8])} bits (tags 339 and 258) aren't read")
    if compression not in (codecs.NONE, codecs.LZW, codecs.DEFLATE, codecs.PACKBITS, codecs.OLD_DEFLATE):
        raise ValueError(f"compression {compression} (tag 259) isn't read")
    if predictor not in (1, 2) or (predictor == 2 and form == 3):
        raise ValueError(f"predictor {predictor} (tag 317) of format {form} isn't read")
    if samples == 0:
        raise ValueError("no samples (tag 277)")
    h, w = tags[HEIGHT][0], tags[WIDTH][0]
    tiled = TILE_OFFSETS in tags
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags.get(OFFSETS), tags.get(COUNTS))
    if offsets is None:
        raise ValueError("neither strips (tag 273) nor tiles (tag 324)")
    rows, columns = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(one(STRIP_ROWS, h), h), w)
    if h == 0 or w == 0:
        return
    if sizes is None:
        if compression != codecs.NONE:
            raise ValueError("no lengths of the strips (tag 279)")
        sizes = [rows * columns * (1 if planar else samples) * bits // 8] * len(offsets)
    down, across, planes = -(-h // rows), -(-w // columns), samples if planar else 1
    if len(offsets) < down * across * planes:
        raise ValueError(f"{len(offsets)} chunks, {down * across * planes} are needed")
    row_bytes = columns * (1 if planar else samples) * bits // 8
    band = rows if tiled or compression != codecs.NONE else max(1, min(rows, BAND_BYTES // max(1, row_bytes)))
    code, n = order + SAMPLES[form, bits], 0
    for k in range(down * across):
        y, x = k // across * rows, k % across * columns
        tall = min(rows, h - y)
        which = [k + p * down * across for p in range(planes)]
        for top in range(0, tall, band):
            if band == rows:
                at, size, high = [offsets[i] for i in which], [sizes[i] for i in which], rows if tiled else tall
            else:
                high = min(band, tall - top)
                at = [offsets[i] + top * row_bytes for i in which]
                size = [max(0, min(high * row_bytes, sizes[i] - top * row_bytes)) for i in which]
            yield Tile(n, y + top, x, min(band, tall - top), min(columns, w - x), high, columns, samples, planar, code, compression, predictor, at, size)
            n += 1


def decode(raw: bytes, page: int = 0) -> np.ndarray:
    """Planes ``(samples, height, width)`` of one page as float32."""
    read = lambda at, n: raw[at : at + n]
    for k, (order, tags) in enumerate(_pages(read)):
        if k == page:
            out = np.zeros((tags.get(COUNT, [1])[0], tags[HEIGHT][0], tags[WIDTH][0]), np.float32)
            for t in _tiles(order, tags):
                out[:, t.y0 : t.y0 + t.height, t.x0 : t.x0 + t.width] = t.decode(read)
            return out
    raise ValueError(f"the file has no page {page}")


def spacing(tags: Tags) -> tuple[float, float, float]:
    """Lengths of a cell along x, y and z; 1 where no tag tells one.

    The resolution tags hold cells a unit; the distance of slices stands in the
    description of stacks, as ``spacing=``.
    """

    def length(tag: int) -> float:
        cells, units = (tags.get(tag) or [0, 0])[:2]
        return units / cells if cells and units else 1.0

    said = bytes(tags.get(DESCRIPTION, [])).split(b"\0")[0].decode("latin-1")
    found = re.search(r"^spacing=([0-9.eE+-]+)\s*$", said, re.M) if said.startswith("ImageJ=") else None
    try:
        deep = float(found.group(1)) if found else 1.0
    except ValueError:
        deep = 1.0
    return length(X_RESOLUTION), length(Y_RESOLUTION), deep or 1.0


def _field(kind: int, values: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(values)}{FIELD_CODES[kind][0]}", *values)


def encode(pages: np.ndarray | Sequence[np.ndarray], tile: tuple[int, int] | None = None, compression: int = codecs.NONE, predictor: int = 1, planar: bool = True, resolution: tuple[int, int] | None = None, description: str = "") -> bytes:
    """A file of one page ``(samples, height, width)`` or of several: u1, i4 or f4.

    ``tile`` is ``(rows, columns)``; without it each plane (or the whole page,
    if not planar) is one strip.  ``resolution`` is ``(cells, units)``.
    """
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for planes in [pages] if isinstance(pages, np.ndarray) else pages:
        n, h, w = planes.shape
        apart = planar and n > 1
        rows, columns = tile or (h, w)
        offsets, sizes = [], []
        for part in planes[:, None] if apart else [planes]:
            for y in range(0, h, rows):
                for x in range(0, w, columns):
                    block = np.zeros((rows, columns, len(part)), planes.dtype.newbyteorder("<"))
                    cut = part[:, y : y + rows, x : x + columns].transpose(1, 2, 0)
                    block[: cut.shape[0], : cut.shape[1]] = cut
                    body = codecs.shrink((codecs.differences(block) if predictor == 2 else block).tobytes(), compression)
                    offsets.append(len(out))
                    sizes.append(len(body))
                    out += body + b"\0" * (len(body) & 1)
        form = {"u": 1, "i": 2, "f": 3}[planes.dtype.kind]
        fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [planes.dtype.itemsize * 8] * n), (COMPRESSION, 3, [compression]), (262, 3, [2 if n > 2 else 1])]
        fields += [(DESCRIPTION, 2, [*description.encode("latin-1"), 0])] if description else []
        fields += [] if tile else [(OFFSETS, 4, offsets)]
        fields += [(COUNT, 3, [n])]
        fields += [] if tile else [(STRIP_ROWS, 4, [h]), (COUNTS, 4, sizes)]
        fields += [(X_RESOLUTION, 5, resolution), (Y_RESOLUTION, 5, resolution)] if resolution else []
        fields += [(PLANAR, 3, [2 if apart else 1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [columns]), (TILE_HEIGHT, 4, [rows]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, sizes)] if tile else []
        fields += [(FORMAT, 3, [form] * n)]
        entries = b""
        for tag, kind, values in fields:
            packed = _field(kind, values)
            if len(packed) > 4:
                place, packed = len(out), packed + b"\0" * (len(packed) & 1)
                out += packed
                packed = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, kind, len(values) // (2 if kind == 5 else 1)) + packed.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def split_alpha(planes: np.ndarray, policy: str = "drop") -> tuple[np.ndarray, bool]:
    """Four samples are colour and alpha, two are grey and alpha; ``drop`` removes the last."""
    has = planes.shape[0] in (2, 4)
    return (planes[:-1], True) if has and policy == "drop" else (planes, False)


def _reader(path: str):
    """An open file of any file system that Arrow knows; Spark gives paths without escapes."""
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    from urllib.parse import quote

    scheme, rest = path.split("://", 1)
    fs, name = pafs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@')}")
    return fs.open_input_file(name)


def _headers(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Paths alone: the scan prunes the content away."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")


def tile_table(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    """``TILES`` and ``z``, 0, 1, ... in the order of path and page; only headers are read."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in TILES.split(", ")]
        for pdf in batches:
            for name in pdf["path"]:
                with _reader(name) as file:
                    for page, (order, tags) in enumerate(_pages(lambda at, n: file.read_at(n, at))):
                        rows = []
                        for t in _tiles(order, tags):
                            rows.append((name, page, *[getattr(t, c) for c in names[2:]]))
                            if len(rows) == 4096:
                                yield pd.DataFrame(rows, columns=names)
                                rows = []
                        yield pd.DataFrame(rows, columns=names)

    tiles = durable(_headers(spark, path, pattern).mapInPandas(index, TILES), "tiles")
    pages = global_rank(tiles.filter("tile = 0").select("path", "page"), "path", "page", out="z")
    return tiles.join(pages.withColumn("z", (F.col("z") - 1).cast("int")), ["path", "page"])


def in_box(tiles: DataFrame, box: dict[str, tuple[int, int]]) -> DataFrame:
    """Tiles that meet a box of half-open ranges of ``z``, ``y`` and ``x``."""
    for axis, (lo, hi) in box.items():
        far = F.col(axis) + 1 if axis == "z" else F.col(f"{axis}0") + F.col({"y": "height", "x": "width"}[axis])
        tiles = tiles.filter((F.col("z" if axis == "z" else f"{axis}0") < hi) & (far > lo))
    return tiles


def read_planes(spark: SparkSession, path: str, alpha: str = "drop", pattern: str = "*.tif*", rows_per_batch: int = 64, box: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """``path, z, y, x, planes ARRAY<FLOAT>``; ``z`` follows the order of paths and pages.

    Of files that a ``box`` cuts, only the tiles that meet it are read; ``z``
    counts all pages, in the box or not.
    """
    box = dict(box or {})
    if set(box) - {"z", "y", "x"}:
        raise ValueError("a box has ranges of z, y and x")
    tiles = in_box(tile_table(spark, path, pattern), box)
    held = tiles.agg(F.sum(F.col("rows").cast("long") * F.col("columns") * F.col("samples") * 4)).first()[0] or 0
    dealt = tiles.repartitionByRange(max(1, -(-held // TASK_BYTES)), "path", "page", "tile")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file = None, None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.path != name:
                    if file is not None:
                        file.close()
                    name, file = r.path, _reader(r.path)
                t = Tile(*[getattr(r, c) for c in Tile.__dataclass_fields__])
                planes, _ = split_alpha(t.decode(lambda at, n: file.read_at(n, at)), alpha)
                (ya, yb), (xa, xb) = box.get("y", (t.y0, t.y0 + t.height)), box.get("x", (t.x0, t.x0 + t.width))
                ya, yb, xa, xb = max(ya, t.y0), min(yb, t.y0 + t.height), max(xa, t.x0), min(xb, t.x0 + t.width)
                planes, wide = planes[:, ya - t.y0 : yb - t.y0, xa - t.x0 : xb - t.x0], xb - xa
                for y in range(0, yb - ya, rows_per_batch):
                    part = planes[:, y : y + rows_per_batch]
                    k = part.shape[1]
                    yield pd.DataFrame({"path": name, "z": np.int32(r.z), "y": np.repeat(np.arange(ya + y, ya + y + k, dtype=np.int32), wide), "x": np.tile(np.arange(xa, xb, dtype=np.int32), k), "planes": list(part.reshape(len(part), -1).T)})
        if file is not None:
            file.close()

    return dealt.mapInPandas(rows, PIXELS)


def read_single(spark: SparkSession, path: str, box: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """``path, z, y, x, v``; a file of several samples raises."""
    df = read_planes(spark, path, alpha="keep", box=box)
    one = F.when(F.size("planes") == 1, F.get("planes", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("several samples in "), F.col("path"))).cast("float"))
    return df.select("path", "z", "y", "x", one.alias("v"))


def read_spacing(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    """``path, sx, sy, sz`` of the first page of each file."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for name in pdf["path"]:
                with _reader(name) as file:
                    found.append((name, *spacing(next(_pages(lambda at, n: file.read_at(n, at)))[1])))
            yield pd.DataFrame(found, columns=["path", "sx", "sy", "sz"])

    return _headers(spark, path, pattern).mapInPandas(look, "path string, sx double, sy double, sz double")


def load_volume(spark: SparkSession, path: str, channel: str | int = "max", pattern: str = "*.tif*", box: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """``path, z, y, x, v``: three or four samples become one by ``max``, ``mean`` or a number; of others the first counts."""
    planes = F.col("planes")
    one: Column = F.get(planes, F.lit(channel)) if isinstance(channel, int) else reduce_planes(F.transform(planes, lambda v: v.cast("double")), channel)
    v = F.when(F.size(planes).isin(3, 4), one).otherwise(F.get(planes, F.lit(0)))
    return read_planes(spark, path, alpha="keep", pattern=pattern, box=box).select("path", "z", "y", "x", v.cast("float").alias("v"))


def encode_slices(pixels: DataFrame, value: str | Sequence[str], kind: str, width: int, height: int, background: float = 0, item: str = "z", **layout) -> DataFrame:
    """``item, content``: one TIFF a slice, ``u1`` masks, ``i4`` labels or ``f4`` rasters; a plane a value."""
    key, values = pixels.schema[item].dataType.simpleString(), [value] if isinstance(value, str) else list(value)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((len(values), height, width), background, dtype=kind)
        for k, name in enumerate(values):
            grid[k, pdf["y"], pdf["x"]] = pdf[name].to_numpy().astype(kind)
        return pd.DataFrame({item: [pdf[item].iloc[0]], "content": [encode(grid, **layout)]})

    return pixels.select(item, "y", "x", *values).groupBy(item).applyInPandas(pack, f"{item} {key}, content binary")
