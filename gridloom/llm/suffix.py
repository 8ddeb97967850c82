"""Removal of repeated byte strings with sampled suffixes and deep-shallow sorting.

Every window of ``length`` bytes holds a byte string of ``SEED`` bytes with the
least hash in it.  Equal windows hold it at the same place, so it is enough to
look at the suffixes that start at such anchors:

1.  Anchors are keyed by the hash of their seed.  Those that have the same
    neighbourhood (all windows that the anchor stands for, by fingerprint) are
    collapsed to the first: all the others are repeats, whole.
2.  The neighbourhoods that are left under one seed are sorted as suffixes, to
    the right of the anchor and, reversed, to its left: multikey quicksort to a
    shallow depth, blind tries below it.  The common prefixes of neighbours in
    these orders give, window by window, which are equal and which is first.
3.  The neighbourhoods of a seed that has very many are first cut into blocks of
    windows, keyed by the bytes that a block's windows share, and equal blocks
    are collapsed by a grouped minimum; blocks that still crowd under one key are
    cut into single windows, for which the minimum is the answer.

Nothing but the neighbourhoods of step 2 is shuffled beside anchors, and the
text once by id.  Only in step 2 rows of one seed meet, up to ``CROWDED``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.plans.durable import durable
from gridloom.plans.session import bounded_batches

LENGTH, SEED = 100, 32
#: Bytes behind the seed that the multikey quicksort compares before blind tries take over.
SHALLOW = 24
#: Seeds with more different neighbourhoods are cut into blocks of so many windows, then into single ones.
CROWDED = 2000
BLOCK = 8
#: Bytes of text per step of the anchor search, and anchors held before they are collapsed.
STEP, HELD = 1 << 16, 400_000
NO_ID = -(1 << 63)
ANCHOR = "kind byte, h long, c long, doc long, tag long, pack long"
ANCHOR_NAMES = [x.split()[0] for x in ANCHOR.split(", ")]
#: One text in so many is looked at for seeds that stand in very many texts, and at most so many seeds are dealt apart.
SHARE, MOST_OFTEN = 64, 100_000

_ODD = 0x9E3779B97F4A7C15
_U = np.uint64


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bytes_ = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    n = STEP + 2 * LENGTH
    return bytes_, np.cumprod(np.full(n, _ODD, np.uint64)), np.cumprod(np.full(n, pow(_ODD, -1, 1 << 64), np.uint64))


_BYTE, _POW, _INV = _tables()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def anchors(raw: bytes, length: int = LENGTH, seed: int = SEED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays ``h, c, first window, bytes to the anchor, windows`` for a text.

    ``h`` is the hash of the seed and ``c`` the fingerprint of the bytes of all
    windows that the anchor stands for, and of its place among them.
    """
    text, at, span = np.frombuffer(raw, np.uint8), 0, length - seed + 1
    low = _U((1 << 17) - 1)
    while at + length <= len(text):
        stop = min(len(text), at + STEP)
        part = text[at:stop]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POW[: len(part)], out=sums[1:])
        h = _mix((sums[seed:] - sums[:-seed]) * _INV[: len(part) - seed + 1])
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: -(span - width)], least[span - width :])
        place = (least & low).astype(np.int64)
        begin = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        end = np.concatenate((begin[1:], [len(place)]))
        left, many = place[begin] - begin, end - begin
        c = (sums[end + length - 1] - sums[begin]) * _INV[begin]
        c = _mix(c ^ ((left * 128 + many).astype(np.uint64) * _U(_ODD)))
        yield h[place[begin]].view(np.int64), c.view(np.int64), at + begin, left, many
        if stop == len(text):
            break
        at = stop - length + 1


def _packed(first: np.ndarray, left: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Bits 14-62 first window, 7-13 bytes to the anchor, 0-6 windows."""
    return (first << 14) | (left << 7) | many


def _collapse(h: np.ndarray, c: np.ndarray, doc: np.ndarray, tag: np.ndarray, pack: np.ndarray) -> pa.RecordBatch:
    """Marks (kind 0) all but the first of each neighbourhood; their key spreads them."""
    order = np.lexsort((pack, tag, doc, c, h))
    h, c, doc, tag, pack = h[order], c[order], doc[order], tag[order], pack[order]
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (c[1:] == c[:-1])))
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    repeat = same & ((doc != doc[head]) | (tag != tag[head]) | (pack != pack[head]))
    spread = _mix(((doc ^ tag).view(np.uint64) * _U(31)) ^ pack.view(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array((~repeat).astype(np.int8)), pa.array(np.where(repeat, spread, h)), pa.array(np.where(repeat, 0, c)), pa.array(doc), pa.array(tag), pa.array(pack)],
        names=["kind", "h", "c", "doc", "tag", "pack"],
    )


def _sample(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            for doc, tag, text in zip(batch["doc"].to_pylist(), batch["tag"].to_pylist(), batch["text"]):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for h, c, first, left, many in anchors(raw, length, seed):
                    held.append((h, c, np.full(len(h), doc, np.int64), np.full(len(h), tag, np.int64), _packed(first, left, many)))
                    n += len(h)
                if n >= HELD:
                    yield _collapse(*(np.concatenate(x) for x in zip(*held)))
                    held, n = [], 0
        if held:
            yield _collapse(*(np.concatenate(x) for x in zip(*held)))

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors sorted by key and neighbourhood: repeats (kind 0) and suffixes to sort (kind 1).

    Rows stream through; of what came before only the first row of the current
    neighbourhood is kept, however many rows a key has.  The first of a
    neighbourhood is sent on if its key has several, as crowded keys (kind 2),
    whose neighbourhoods are dealt apart, always do.
    """
    keep: tuple[int, int, int, int, int, bool, bool] | None = None  # h, c, doc, tag, pack, sent, key has several
    for batch in batches:
        kind, h, c, doc, tag, pack = (batch[k].to_numpy(zero_copy_only=False) for k in ("kind", "h", "c", "doc", "tag", "pack"))
        done = kind == 0
        out = [(np.zeros(int(done.sum()), np.int8), h[done], doc[done], tag[done], pack[done])]
        crowded, h, c, doc, tag, pack = kind[~done] == 2, h[~done], c[~done], doc[~done], tag[~done], pack[~done]
        if len(h):
            if keep is not None:
                h, c, doc, tag, pack = (np.concatenate(([k], x)) for k, x in zip(keep[:5], (h, c, doc, tag, pack)))
                crowded = np.concatenate(([False], crowded))
            new_h = np.concatenate(([True], h[1:] != h[:-1]))
            new_c = new_h | np.concatenate(([True], c[1:] != c[:-1]))
            head = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), 0))
            group = np.cumsum(new_h) - 1
            several = (np.bincount(group, new_c) > 1) | (np.bincount(group, crowded) > 0)
            if keep is not None and keep[6]:
                several[0] = True
            send = new_c & several[group]
            if keep is not None and keep[5]:
                send[0] = False
            again = ~new_c & ((doc != doc[head]) | (tag != tag[head]) | (pack != pack[head]))
            for rows, mark in ((again, 0), (send, 1)):
                out.append((np.full(int(rows.sum()), mark, np.int8), h[rows], doc[rows], tag[rows], pack[rows]))
            last = head[-1]
            sent = bool(send[last]) or bool(last == 0 and keep is not None and keep[5])
            keep = (h[last], c[last], doc[last], tag[last], pack[last], sent, bool(several[group[-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["kind", "h", "doc", "tag", "pack"])


def _neighbourhoods(length: int):
    """The bytes of all windows of the anchors that are asked for, a text in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "doc", "tag", "pack", "near"]
        for batch in batches:
            for doc, tag, text, asked in zip(batch["doc"].to_pylist(), batch["tag"].to_pylist(), batch["text"], batch["asked"]):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                h, pack = (asked.values.field(k).to_numpy(zero_copy_only=False) for k in ("h", "pack"))
                for at in range(0, len(h), 10_000):
                    packs = pack[at : at + 10_000]
                    near = [raw[p >> 14 : (p >> 14) + (p & 127) + length - 1] for p in packs.tolist()]
                    n = len(packs)
                    yield pa.RecordBatch.from_arrays([pa.array(h[at : at + n]), pa.array(np.full(n, doc, np.int64)), pa.array(np.full(n, tag, np.int64)), pa.array(packs), pa.array(near, pa.binary())], names=names)

    return run


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two byte strings."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class BlindTrie:
    """Suffixes that share a long prefix, branched by the bytes in which they differ.

    Inner nodes are ``[depth, children by byte]`` and store no text: an insert
    first walks down blindly, compares once with the leaf that it meets, and so
    knows where to branch.  Equal suffixes share a leaf.
    """

    def __init__(self) -> None:
        self.root: list | None = None

    def insert(self, text: bytes, member: int) -> None:
        leaf = ["leaf", text, [member]]
        if self.root is None:
            self.root = leaf
            return
        node, way = self.root, []
        while node[0] != "leaf":
            way.append(node)
            key = text[node[0]] if node[0] < len(text) else -1
            node = node[1].get(key) or next(iter(node[1].values()))
        depth = _common(text, node[1])
        if depth == len(text) == len(node[1]):
            node[2].append(member)
            return
        byte = lambda x: x[depth] if depth < len(x) else -1
        above = [x for x in way if x[0] <= depth]
        if above and above[-1][0] == depth:
            above[-1][1][byte(text)] = leaf
            return
        below = way[len(above)] if len(above) < len(way) else node
        inner = [depth, {byte(node[1]): below, byte(text): leaf}]
        if above:
            parent = above[-1]
            parent[1][text[parent[0]] if parent[0] < len(text) else -1] = inner
        else:
            self.root = inner

    def in_order(self) -> Iterator[tuple[int, int]]:
        """``(member, common prefix with the member before)``; 0 for the first."""
        stack, depth = [(self.root, 0)], 0
        while stack:
            node, shared = stack.pop()
            if node[0] == "leaf":
                for k, member in enumerate(node[2]):
                    yield member, len(node[1]) if k else shared
                continue
            for k, key in reversed(list(enumerate(sorted(node[1])))):
                stack.append((node[1][key], node[0] if k else shared))


def deep_shallow(texts: list[bytes], group: np.ndarray, shallow: int = SHALLOW, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``texts`` within their groups, and each one's common prefix with the one before.

    ``group`` is ascending; texts of a group share their first ``base`` bytes.
    All groups are sorted at once: a ternary quicksort step on eight bytes at a
    time splits every open segment, until its texts differ or agree to
    ``base + shallow`` bytes; the segments that are still open become tries.
    The first of a group has a common prefix of 0.
    """
    n = len(texts)
    words = -(-shallow // 8)
    cut = b"".join(x[base : base + 8 * words].ljust(8 * words, b"\0") for x in texts)
    char = np.frombuffer(cut, ">u8").reshape(n, words).astype(np.uint64)
    order, seg, depth = np.arange(n), group.astype(np.int64), np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    while True:
        _, start, size = np.unique(seg, return_index=True, return_counts=True)
        sized = np.repeat(size, size)
        open_ = (sized > 1) & (depth < words)
        if not open_.any():
            break
        rows = order
        now = np.where(open_, char[rows, np.minimum(depth, words - 1)], 0)
        pivot = np.repeat(now[start + size // 2], size)
        side = np.where(open_, 1 + (now > pivot).astype(np.int64) - (now < pivot), 1)
        step = np.argsort(seg * 3 + side, kind="stable")
        order, key = order[step], (seg * 3 + side)[step]
        depth = (depth + (open_ & (side == 1)))[step]
        seg = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64))))
    _, start, size = np.unique(seg, return_index=True, return_counts=True)
    shared = np.zeros(n, np.int64)
    for s, k in zip(start[size > 1].tolist(), size[size > 1].tolist()):
        trie = BlindTrie()
        for member in order[s : s + k].tolist():
            trie.insert(texts[member], member)
        for i, (member, common) in enumerate(trie.in_order()):
            order[s + i], shared[s + i] = member, common
    ordered = group[order]
    for s in start.tolist():
        if s and ordered[s] == ordered[s - 1]:
            shared[s] = _common(texts[order[s - 1]], texts[order[s]])
        else:
            shared[s] = 0
    return order, shared


def repeated_windows(texts: list[bytes], group: np.ndarray, left: np.ndarray, many: np.ndarray, length: int = LENGTH, seed: int = SEED) -> list[tuple[int, int, int]]:
    """``(member, from, to)`` of the windows of neighbourhoods that an earlier member of the group has.

    Members are ordered by group and then by place; ``from`` and ``to`` count
    windows from the first of the neighbourhood.
    """
    n = len(texts)
    right = [t[k:] for t, k in zip(texts, left.tolist())]
    back = [t[:k][::-1] for t, k in zip(texts, left.tolist())]
    r_order, r_shared = deep_shallow(right, group, base=seed)
    l_order, l_shared = deep_shallow(back, group)
    hit = np.zeros((n, length - seed + 1), bool)
    for j in range(length - seed + 1):
        has = (left >= j) & (left - many < j)
        if not has.any():
            continue
        r_id, l_id = np.empty(n, np.int64), np.empty(n, np.int64)
        r_id[r_order] = np.cumsum(r_shared < length - j)
        l_id[l_order] = np.cumsum(l_shared < j) if j else group[l_order]
        rows = np.flatnonzero(has)
        key = r_id[rows] * (2 * n + 2) + l_id[rows]
        order = np.argsort(key, kind="stable")
        later = np.concatenate(([False], key[order][1:] == key[order][:-1]))
        hit[rows[order[later]], j] = True
    out = []
    for m in np.flatnonzero(hit.any(1)).tolist():
        js = np.flatnonzero(hit[m])
        breaks = np.flatnonzero(np.diff(js) > 1)
        for a, b in zip(np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(js) - 1]))):
            out.append((m, int(left[m] - js[b]), int(left[m] - js[a]) + 1))
    return out


def _sort_groups(length: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        held = 0

        def solved(pdf: pd.DataFrame) -> pd.DataFrame:
            group = np.cumsum(np.concatenate(([0], np.diff(pdf["h"].to_numpy()) != 0)).astype(np.int64))
            pack = pdf["pack"].to_numpy()
            found = repeated_windows(pdf["near"].to_list(), group, (pack >> 7) & 127, pack & 127, length, seed)
            m = np.array([x[0] for x in found], np.int64)
            first = (pack >> 14)[m]
            a, b = (np.array([x[k] for x in found], np.int64) for k in (1, 2))
            return pd.DataFrame({"doc": pdf["doc"].to_numpy()[m], "tag": pdf["tag"].to_numpy()[m], "start": first + a, "stop": first + b + length - 1})

        for pdf in batches:
            rest.append(pdf)
            held += len(pdf)
            if held < 20_000 or pdf["h"].iloc[0] == pdf["h"].iloc[-1]:
                continue
            whole = pd.concat(rest, ignore_index=True)
            last = int(np.searchsorted(whole["h"].to_numpy(), whole["h"].iloc[-1]))
            if last:
                yield solved(whole.iloc[:last])
            rest, held = [whole.iloc[last:]], len(whole) - last
        if held:
            yield solved(pd.concat(rest, ignore_index=True))

    return run


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """``doc, tag, text`` and columns ``more``: rows of one id are told apart by a 64-bit hash of their text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(body).alias("tag"), body.alias("text"), *more
    )


def _field(name: str) -> Column:
    shift, bits = {"first": (14, 49), "left": (7, 7), "many": (0, 7)}[name]
    return F.shiftright("pack", shift).bitwiseAND(F.lit((1 << bits) - 1))


def _extent(length: int) -> list[Column]:
    """``tag, start, stop`` of the bytes that all windows of an anchor cover."""
    return [F.col("tag"), _field("first").alias("start"), (_field("first") + _field("many") + length - 1).alias("stop")]


def _split(rows: DataFrame, width: int, length: int) -> DataFrame:
    """Neighbourhoods cut into blocks of ``width`` windows, by the windows' distance to the anchor.

    The key of a block is the bytes that all its windows share, so equal
    windows stay under one key, and neighbourhoods that differ there part.
    """
    first, left, many = _field("first"), _field("left"), _field("many")
    least = left - many + 1
    cut_ = rows.select("h", "doc", "tag", "pack", "near", F.explode(F.sequence(F.floor(least / width), F.floor(left / width))).alias("q"))
    high, low = F.least(left, F.col("q") * width + width - 1), F.greatest(least, F.col("q") * width)
    skip, n = left - high, high - low + 1
    core = F.substring("near", (left - F.col("q") * width + 1).cast("int"), F.lit(length - width + 1))
    pack = F.shiftleft(first + skip, 14).bitwiseOR(F.shiftleft(high, 7)).bitwiseOR(n)
    return cut_.select(
        F.xxhash64("h", "q", core).alias("h"), "doc", "tag", pack.alias("pack"), F.substring("near", (skip + 1).cast("int"), (n + length - 1).cast("int")).alias("near")
    )


def repeated_spans(rows: DataFrame, length: int = LENGTH, seed: int = SEED, crowded: int = CROWDED, share: int = SHARE) -> DataFrame:
    """``doc, tag, spans``: the byte ranges of ``keyed`` rows that occur earlier; they may overlap.

    Earlier is a smaller ``(doc, tag)``, or the same text and an earlier start.
    Rows that agree in id and text are one text.
    """
    if not seed < length <= 127 or length - seed + 1 > 127:
        raise ValueError("windows of up to 127 bytes, longer than the seed")
    texts = rows.filter(F.octet_length("text") >= length).select("doc", "tag", "text")
    found = bounded_batches(texts).mapInArrow(_sample(length, seed), ANCHOR)
    # How anchors are dealt never changes the result.  Seeds that stand in very many texts are dealt by
    # neighbourhood; which ones is estimated from a share of the texts, and their number is bounded.
    some = bounded_batches(texts.filter(F.pmod(F.xxhash64("tag"), F.lit(share)) == 0)).mapInArrow(_sample(length, seed), ANCHOR)
    often = some.filter("kind = 1").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") * share > crowded)
    often = durable(often.orderBy(F.desc("n"), "h").limit(MOST_OFTEN).select("h", F.lit(True).alias("often")), "suffix-often")
    marked = found.join(F.broadcast(often), "h", "left").withColumn("kind", F.when((F.col("kind") == 1) & F.col("often"), 2).otherwise(F.col("kind")).cast("byte")).drop("often")
    dealt = marked.repartition(F.when(F.col("kind") == 2, F.xxhash64("h", "c")).otherwise(F.col("h"))).sortWithinPartitions("h", "kind", "c", "doc", "tag", "pack")
    resolved = durable(dealt.select(*ANCHOR_NAMES).mapInArrow(_resolve, "kind byte, h long, doc long, tag long, pack long"), "suffix-anchors")
    whole = resolved.filter("kind = 0").select("doc", *_extent(length))
    open_ = resolved.filter("kind = 1")
    asked = open_.groupBy("doc", "tag").agg(F.collect_list(F.struct("h", "pack")).alias("asked"))
    # One row a text: the texts are dealt out by id once, here and where they are cut.
    texts = bounded_batches(texts.join(asked, ["doc", "tag"]).select("doc", "tag", "text", "asked"))
    near = texts.mapInArrow(_neighbourhoods(length), "h long, doc long, tag long, pack long, near binary")
    near = durable(near.distinct(), "suffix-near")
    spans, calm, rows = whole, [], near
    for width in (BLOCK, 1):
        busy = durable(rows.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > crowded).select("h"), "suffix-crowded")
        if busy.isEmpty():
            calm.append(rows)
            break
        calm.append(rows.join(busy, "h", "left_anti").select(*rows.columns))
        pieces = durable(_split(rows.join(busy, "h", "left_semi"), width, length), "suffix-pieces")
        firsts = durable(pieces.groupBy("h", "near").agg(F.min(F.struct("doc", "tag", "pack")).alias("one"), F.count("*").alias("n")), "suffix-firsts")
        later = pieces.join(firsts.filter("n > 1").select("h", "near", "one"), ["h", "near"]).filter(F.struct("doc", "tag", "pack") > F.col("one"))
        spans = spans.union(later.select("doc", *_extent(length)))
        rows = firsts.select("h", "one.doc", "one.tag", "one.pack", "near")
    apart = reduce(lambda a, b: a.unionByName(b), calm)
    sorted_ = apart.repartition("h").sortWithinPartitions("h", "doc", "tag", "pack").mapInPandas(_sort_groups(length, seed), "doc long, tag long, start long, stop long")
    return spans.union(sorted_).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def cut(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of ``raw`` without the ranges, the bytes removed and the maximal runs."""
    if not len(starts):
        return raw, 0, 0
    change = np.zeros(len(raw) + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, stops, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(gone) else 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _each(text: pd.Series, spans: pd.Series) -> Iterator[tuple[bytes, bytes, int, int]]:
    for t, s in zip(text, spans):
        raw = t.encode("utf-8", "surrogatepass")
        pairs = [(x["start"], x["stop"]) for x in s] if s is not None else []
        edges = np.array(pairs, np.int64).reshape(-1, 2)
        yield raw, *cut(raw, edges[:, 0], edges[:, 1])


_CUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


@F.pandas_udf(_CUT)
def _digest(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = [(len(raw), gone, runs, hashlib.sha256(left).hexdigest()) for raw, left, gone, runs in _each(text, spans)]
    return pd.DataFrame(rows, columns=_CUT.names)


@F.pandas_udf(T.StringType())
def _left(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([left.decode("utf-8", "ignore") for _, left, _, _ in _each(text, spans)], dtype="object")


def _original(doc: Column) -> Column:
    return F.when(doc != NO_ID, doc)


def report(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", crowded: int = CROWDED, share: int = SHARE) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every input row.

    A byte goes if a window of ``length`` bytes over it starts earlier too.
    Null texts are empty; a null id counts as the smallest id.  Rows of one id
    are told apart and ordered by a 64-bit hash of their text; rows that agree in both
    get the same result and don't remove each other.
    """
    rows = keyed(docs, key, text)
    found = rows.join(repeated_spans(rows, length, crowded=crowded, share=share), ["doc", "tag"], "left")
    return found.select(_original(F.col("doc")).alias("doc_id"), _digest("text", "spans").alias("r")).select("doc_id", "r.*")


def remove(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """``docs`` without repeated bytes, columns unchanged; ``chars`` is counted anew.

    A character that loses some of its bytes goes whole.
    """
    others = [c for c in docs.columns if c not in (key, text)]
    renamed = docs.select(key, text, *[F.col(c).alias(f"__{c}") for c in others])
    rows = keyed(renamed, key, text, tuple(f"__{c}" for c in others))
    found = rows.join(repeated_spans(keyed(docs, key, text), length), ["doc", "tag"], "left")
    out = found.withColumn("kept", F.when(F.col("spans").isNull(), F.col("text")).otherwise(_left("text", "spans")))
    back = {key: _original(F.col("doc")).cast(docs.schema[key].dataType), text: F.col("kept")} | {c: F.col(f"__{c}") for c in others}
    if chars in others:
        back[chars] = F.length("kept").cast(docs.schema[chars].dataType)
    return out.select(*[back[c].alias(c) for c in docs.columns])
