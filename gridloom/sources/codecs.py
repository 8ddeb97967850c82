"""Codecs of single chunks of a raster file, as the published format defines them."""

from __future__ import annotations

import zlib

import numpy as np

#: Fixed values of the format: compression tags, and the two control codes of its LZW.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, STOP, WIDEST = 256, 257, 12
SINGLES = [bytes([k]) for k in range(256)] + [b"", b""]


def unpack_bits(raw: bytes) -> bytes:
    """Runs and literals; a header of 128 is nothing."""
    out, at = bytearray(), 0
    while at < len(raw):
        head = raw[at]
        at += 1
        if head < 128:
            out += raw[at : at + head + 1]
            at += head + 1
        elif head > 128:
            out += raw[at : at + 1] * (257 - head)
            at += 1
    return bytes(out)


def pack_bits(raw: bytes) -> bytes:
    """Runs of three equal bytes or more, literals between them."""
    out, literal, at = bytearray(), bytearray(), 0

    def flush() -> None:
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while at < len(raw):
        n = 1
        while n < 128 and at + n < len(raw) and raw[at + n] == raw[at]:
            n += 1
        if n >= 3:
            flush()
            out += bytes([257 - n, raw[at]])
        else:
            literal += raw[at : at + n]
        at += n
    flush()
    return bytes(out)


def unlzw(raw: bytes) -> bytes:
    """Codes from the high bit down, which get wider one code before the table asks for it."""
    table, width, held, bits, last = list(SINGLES), 9, 0, 0, b""
    out = []
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == STOP:
            break
        if code == CLEAR:
            table, width, last = list(SINGLES), 9, b""
            continue
        if code > len(table) or (code == len(table) and not last):
            raise ValueError("a code that the table doesn't have yet")
        word = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + word[:1])
            if len(table) + 1 >= 1 << width and width < WIDEST:
                width += 1
        out.append(word)
        last = word
    return b"".join(out)


def lzw(raw: bytes) -> bytes:
    """The longest known prefix at each place; the table starts anew when it is full."""
    known: dict[bytes, int] = {}
    held, bits, width, out = CLEAR, 9, 9, bytearray()

    def drain() -> None:
        nonlocal held, bits
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        drain()

    def code_of(word: bytes) -> int:
        return word[0] if len(word) == 1 else known[word]

    drain()
    word = b""
    for k in range(len(raw)):
        longer = word + raw[k : k + 1]
        if len(longer) == 1 or longer in known:
            word = longer
            continue
        put(code_of(word))
        known[longer] = 258 + len(known)
        size = 258 + len(known)
        if size >= (1 << WIDEST) - 2:
            put(CLEAR)
            known, width = {}, 9
        elif size >= 1 << width:
            width += 1
        word = raw[k : k + 1]
    if word:
        put(code_of(word))
        if 258 + len(known) + 1 >= 1 << width and width < WIDEST:
            width += 1
    put(STOP)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def expand(raw: bytes, compression: int) -> bytes:
    if compression == NONE:
        return raw
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(raw)
    if compression == LZW:
        return unlzw(raw)
    if compression == PACKBITS:
        return unpack_bits(raw)
    raise ValueError(f"compression {compression} (tag 259) isn't read")


def shrink(raw: bytes, compression: int) -> bytes:
    if compression == NONE:
        return raw
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(raw)
    if compression == LZW:
        return lzw(raw)
    if compression == PACKBITS:
        return pack_bits(raw)
    raise ValueError(f"compression {compression} (tag 259) isn't written")


def undo_differences(block: np.ndarray) -> np.ndarray:
    """Sums along the second axis of ``(rows, columns, samples)``, which wrap as the type does."""
    return np.cumsum(block, axis=1, dtype=block.dtype)


def differences(block: np.ndarray) -> np.ndarray:
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out
