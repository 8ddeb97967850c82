"""TIFF: codecs against published examples, layouts, spacing, boxes that read only their tiles."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest

from gridloom.sources import codecs, tiff


def in_nines(codes):
    bits = "".join(f"{c:09b}" for c in codes)
    bits = bits.ljust(-(-len(bits) // 8) * 8, "0")
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def test_codecs_give_the_examples_of_the_format():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert codecs.unpack_bits(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    text, packed = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]), in_nines([256, 7, 258, 8, 8, 258, 6, 6, 257])
    assert codecs.unlzw(packed) == text and codecs.lzw(text) == packed
    with pytest.raises(ValueError):
        codecs.unlzw(in_nines([256, 7, 300, 257]))


@pytest.mark.parametrize("compression", [codecs.NONE, codecs.LZW, codecs.DEFLATE, codecs.PACKBITS])
def test_codecs_round_trip_at_every_width(compression):
    rng = random.Random(5)
    for n in [*range(70), *range(250, 260), *range(760, 775), *range(3830, 3845), 20_000]:
        for raw in (rng.randbytes(n), bytes(n), bytes(rng.choices(b"ab", k=n))):
            assert codecs.expand(codecs.shrink(raw, compression), compression) == raw


@pytest.mark.parametrize("kind", ["u1", "i4", "f4"])
def test_every_layout_holds_the_same_samples(kind):
    for n in (1, 3, 4):
        planes = (np.arange(n * 37 * 29).reshape(n, 37, 29) % 251).astype(kind)
        for tile in (None, (16, 16), (16, 48)):
            for compression in (codecs.NONE, codecs.LZW, codecs.DEFLATE, codecs.PACKBITS):
                for predictor in (1, 2) if kind != "f4" else (1,):
                    for planar in (True, False):
                        raw = tiff.encode(planes, tile, compression, predictor, planar)
                        assert np.array_equal(tiff.decode(raw), planes.astype("f4"))


def test_pages_bands_and_what_is_refused(monkeypatch):
    a = np.arange(37 * 29, dtype="f4").reshape(1, 37, 29)
    monkeypatch.setattr(tiff, "BAND_BYTES", 29 * 4 * 5)
    stack = tiff.encode([a, a + 1])
    order, tags = next(tiff._pages(lambda at, n: stack[at : at + n]))
    assert len(list(tiff._tiles(order, tags))) == 8
    assert np.array_equal(tiff.decode(stack, 1), a + 1)
    for bad in (b"", b"nothing", stack[:8]):
        with pytest.raises(Exception):
            tiff.decode(bad)
    with pytest.raises(ValueError, match="no page 2"):
        tiff.decode(stack, 2)
    at = stack.index(struct.pack("<HHIH", tiff.COMPRESSION, 3, 1, 1))
    with pytest.raises(ValueError, match="259"):
        tiff.decode(stack[: at + 8] + struct.pack("<H", 7) + stack[at + 10 :])


def big_endian_big_file(values):
    """A big file of one strip of 16-bit samples, written by hand."""
    h, w = values.shape
    body = values.astype(">u2").tobytes()
    fields = [(256, 3, w), (257, 3, h), (258, 3, 16), (259, 3, 1), (273, 16, 16), (277, 3, 1), (278, 3, h), (279, 16, len(body))]
    entries = b"".join(struct.pack(">HHQ", t, k, 1) + struct.pack(">H" if k == 3 else ">Q", v).ljust(8, b"\0") for t, k, v in fields)
    return struct.pack(">2sHHHQ", b"MM", 43, 8, 0, 16 + len(body)) + body + struct.pack(">Q", len(fields)) + entries + bytes(8)


def test_big_files_of_the_other_byte_order():
    values = np.arange(12).reshape(3, 4) * 1000
    assert np.array_equal(tiff.decode(big_endian_big_file(values))[0], values.astype("f4"))


def test_a_box_reads_only_its_tiles(spark, tmp_path):
    """Every tile outside of the box is broken, so that reading one would fail."""
    planes = np.arange(3 * 40 * 50, dtype="i4").reshape(3, 40, 50)
    folder = tmp_path / "a folder"
    folder.mkdir()
    raw = bytearray(tiff.encode(planes, (16, 16), codecs.DEFLATE, 2))
    order, tags = next(tiff._pages(lambda at, n: bytes(raw[at : at + n])))
    for t in tiff._tiles(order, tags):
        if not (t.y0 < 30 and t.y0 + t.height > 20 and t.x0 < 16):
            for at in t.offsets:
                raw[at : at + 2] = b"\xff\xff"
    (folder / "a.tif").write_bytes(raw)
    (folder / "b.tif").write_bytes(b"II*\0" + bytes(4))
    got = {(r.y, r.x): r.planes for r in tiff.read_planes(spark, str(folder), box={"y": (20, 30), "x": (3, 16)}).collect()}
    assert got == {(y, x): planes[:, y, x].tolist() for y in range(20, 30) for x in range(3, 16)}
    with pytest.raises(Exception):
        tiff.read_planes(spark, str(folder)).collect()
    with pytest.raises(ValueError):
        tiff.read_planes(spark, str(folder), box={"w": (0, 1)})


def test_volumes_count_pages_and_tell_their_spacing(spark, tmp_path):
    grey = [np.full((1, 5, 6), k, "u1") for k in range(3)]
    colour = np.stack([np.full((5, 6), v, "u1") for v in (30, 60, 90)])
    (tmp_path / "a.tif").write_bytes(tiff.encode(grey, resolution=(2, 1), description="ImageJ=1.5\nimages=3\nspacing=2.5\n"))
    (tmp_path / "b.tif").write_bytes(tiff.encode(colour, planar=False))
    for channel, want in (("max", 90), ("mean", 60), (0, 30)):
        got = tiff.load_volume(spark, str(tmp_path), channel).groupBy("z").agg({"v": "sum", "*": "count"}).orderBy("z").collect()
        assert [(r.z, r["sum(v)"] / r["count(1)"], r["count(1)"]) for r in got] == [(0, 0, 30), (1, 1, 30), (2, 2, 30), (3, want, 30)]
    told = {r.path[-5]: (r.sx, r.sy, r.sz) for r in tiff.read_spacing(spark, str(tmp_path)).collect()}
    assert told == {"a": (0.5, 0.5, 2.5), "b": (1.0, 1.0, 1.0)}
    dropped = tiff.load_volume(spark, str(tmp_path), box={"z": (1, 2)}).select("z", "v").distinct().collect()
    assert [tuple(r) for r in dropped] == [(1, 1.0)]
