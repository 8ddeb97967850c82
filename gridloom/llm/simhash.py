"""SimHash near-duplicate groups by multi-index hashing.

:func:`near_duplicates` links 64-bit fingerprints within two bits.  They are cut
into two 32-bit segments.  Two fingerprints within two bits either differ by at
most one bit in the upper segment or agree in the lower one, so probing the ball
of radius one around the upper segment and the lower segment itself (34 probes)
meets every such pair.  Complete distances are then verified.

:func:`keep_one` finds texts that share 0.8 of their five-word shingles.  Their
fingerprints differ in some 14 % of the bits, so a wide fingerprint of
``SEGMENTS`` segments is used, and the ball of radius two around a segment flips
only its least certain bits (those with the smallest majority): they are where
similar texts differ.  Rows that meet in a ball are verified by the complete
distance and then by their sets of shingles.

Work starts from distinct fingerprints or sets: copies meet no one.
"""

from __future__ import annotations

import math
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.components import connected_components
from gridloom.plans.durable import durable
from gridloom.plans.session import bounded_batches

RADIUS = 2
#: Above so many fingerprints in a segment bucket, its pairs are found another exact way.
BUCKET = 64
_HALF = (1 << 32) - 1


def fingerprint_text(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of one whole text; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprint(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_text(x) for x in text], dtype="int64")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fp`` (signed long), one row per input row, no shuffle."""
    return bounded_batches(docs).select(F.col(key).alias("doc_id"), _fingerprint(F.col(text)).alias("fp"))


def _probes() -> list[tuple[int, int]]:
    return [(0, 0), *((0, 1 << k) for k in range(32)), (1, 0)]


def _segments(fps: DataFrame) -> DataFrame:
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(_HALF))
    both = F.array(F.struct(F.lit(0).alias("seg"), upper.alias("value")), F.struct(F.lit(1).alias("seg"), lower.alias("value")))
    return fps.select("fp", "rep", F.explode(both).alias("s")).select("fp", "rep", "s.*")


def _probed(fps: DataFrame) -> DataFrame:
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(_HALF))
    each = F.array(*[F.struct(F.lit(s).alias("seg"), (upper if s == 0 else lower).bitwiseXOR(F.lit(m).cast("long")).alias("value")) for s, m in _probes()])
    return fps.select("fp", "rep", F.explode(each).alias("s")).select("fp", "rep", "s.*")


def _stars(fps: DataFrame) -> DataFrame:
    """Links within two bits through shared centres one bit away.

    Two values are within two bits of each other exactly if some value is
    within one bit of both.  A centre has at most 65 such values, however many
    fingerprints there are, so no group here grows with the data.
    """
    masks = [0] + [1 << k if k < 63 else -(1 << 63) for k in range(64)]
    centres = fps.select("rep", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in masks])).alias("centre"))
    met = centres.groupBy("centre").agg(F.collect_set("rep").alias("reps")).filter("size(reps) > 1")
    return met.select(F.array_min("reps").alias("u"), F.explode("reps").alias("v")).filter("u <> v")


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(u, v)`` between ``rep`` ids whose components are those of all pairs within ``radius`` bits.

    ``fps`` has distinct ``fp`` with a ``rep`` id each.  Pairs come from the
    segment index; where a bucket holds more than ``bucket`` fingerprints, all
    that probe it are linked through shared centres instead, which is exact too.
    """
    if radius != 2:
        raise ValueError("the segment plan and the shared centres are for a radius of 2")
    table = _segments(fps)
    crowded = durable(table.groupBy("seg", "value").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("seg", "value"), "simhash-crowded")
    any_crowded = not crowded.isEmpty()
    probes = _probed(fps)
    if any_crowded:
        table = table.join(crowded, ["seg", "value"], "left_anti")
    near = (
        probes.select("seg", "value", F.col("fp").alias("fp_u"), F.col("rep").alias("u"))
        .join(table.select("seg", "value", F.col("fp").alias("fp_v"), F.col("rep").alias("v")), ["seg", "value"])
        .filter(F.col("fp_u") < F.col("fp_v"))
        .filter(F.bit_count(F.col("fp_u").bitwiseXOR(F.col("fp_v"))) <= radius)
        .select("u", "v")
    )
    if any_crowded:
        inside = probes.join(crowded, ["seg", "value"], "left_semi").select("fp", "rep").distinct()
        near = near.union(_stars(inside))
    return near


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fp, component_id``: groups of documents linked within ``radius`` bits.

    One row per input row.  ``component_id`` is the smallest id reachable.
    Texts without words share fingerprint zero.  Rows whose id is null link
    like any others, so they may bridge two; ``component_id`` is null only where
    nothing that is reachable has an id.
    """
    marked = durable(fingerprints(docs, key, text), "simhash-fp")
    # The fingerprint itself is the node: rows without ids have one as well.
    fps = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("rep", F.col("fp")), "simhash-distinct")
    roots = durable(connected_components(links(fps.select("fp", "rep"), radius, bucket)).withColumnRenamed("node", "fp"), "simhash-roots")
    least = fps.join(roots, "fp").groupBy("component").agg(F.min("first").alias("least"))
    named = roots.join(least, "component").select("fp", "least")
    placed = durable(fps.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "simhash-placed")
    return marked.join(placed, "fp", "left").select("doc_id", "fp", "component_id")


#: Shingles and similarity of :func:`keep_one`.
WIDTH, SIMILAR = 5, 0.8
#: Segments of 32 bits, bits of each that a ball may flip, and flips at once.
SEGMENTS, UNSURE, FLIPS = 16, 6, 2
#: Texts that share 0.8 of their shingles differ in 78 of the 512 bits with a deviation of 8.
FAR = 128
#: In balls of more rows (and of more than meet by chance, see crowd_size), all are compared with LEADERS of them first; BLOCKS are rows of either side of a comparison.
CROWD, LEADERS, BLOCKS = 8, 4, (128, 512)

_WORDS = SEGMENTS * 32 // 64
_ODD = np.random.default_rng(5).integers(0, 1 << 62, _WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(6).integers(0, 1 << 62, _WORDS, dtype=np.uint64)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Ascending distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) < width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    n = max(1, len(words) - width + 1) if words else 0
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64, count=n))


def wide_segments(shingles: np.ndarray) -> list[int]:
    """The wide fingerprint: 32 bits a segment, and above them the places of its ``UNSURE`` least certain bits, five bits each."""
    if not len(shingles):
        return []
    ones = np.zeros(SEGMENTS * 32, np.int64)
    for at in range(0, len(shingles), 1 << 12):
        x = (shingles[at : at + (1 << 12), None] ^ _ADD) * _ODD
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        ones += np.unpackbits((x ^ (x >> np.uint64(29))).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    lead = (2 * ones - len(shingles)).reshape(SEGMENTS, 32)
    unsure = np.argsort(np.abs(lead), axis=1, kind="stable")[:, :UNSURE]
    value = ((lead > 0).astype(np.int64) << np.arange(32)).sum(axis=1)
    return (value | (unsure << (32 + 5 * np.arange(UNSURE))).sum(axis=1)).tolist()


_MARK = T.StructType([T.StructField("whole", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("wide", T.ArrayType(T.LongType()))])


@F.pandas_udf(_MARK)
def _mark(text: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(x) for x in text]
    return pd.DataFrame({"whole": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "n": [len(s) for s in sets], "wide": [wide_segments(s) for s in sets]})


@F.pandas_udf(T.ArrayType(T.LongType()))
def _set(text: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(x).view(np.int64) for x in text], dtype="object")


def _ball(segment: Column, packed: Column) -> Column:
    """Keys of all values within ``FLIPS`` of the segment's least certain bits."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(packed, 32 + 5 * k).bitwiseAND(F.lit(31)).cast("int")) for k in range(UNSURE)]
    value = packed.bitwiseAND(F.lit(_HALF)).bitwiseOR(F.shiftleft(segment.cast("long"), 32))
    keys = []
    for n in range(FLIPS + 1):
        for chosen in combinations(bits, n):
            key = value
            for bit in chosen:
                key = key.bitwiseXOR(bit)
            keys.append(key)
    return F.array(*keys)


def _far(a: Column, b: Column) -> Column:
    """Complete distance of two wide fingerprints."""
    total = F.lit(0)
    for k in range(SEGMENTS):
        total = total + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))).bitwiseAND(F.lit(_HALF)))
    return total


def _alike(n: Column, m: Column, similar: float) -> Column:
    """A set that is too small for the other can't be similar."""
    return F.least(n, m) >= similar * F.greatest(n, m)


class Verifier:
    """Verifies pairs of rows, by complete distances and then by sets of shingles.

    ``firsts`` has ``rid, n, wide`` and ``texts`` has ``rid, text`` for (at least) the same rows.
    """

    def __init__(self, firsts: DataFrame, texts: DataFrame, similar: float) -> None:
        self.firsts, self.texts, self.similar = firsts.select("rid", "n", "wide"), texts, similar

    def sets(self, rids: DataFrame) -> DataFrame:
        """``rid, shingles`` of the rows asked for, written."""
        found = self.texts.join(rids.select("rid").distinct(), "rid", "left_semi")
        return durable(bounded_batches(found).select("rid", _set(F.col("text")).alias("shingles")), "simhash-sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The similar ones of the distinct pairs ``(u, v)``, written."""
        a, b = (self.firsts.select(*[F.col(c).alias(f"{c}_{x}") for c in ("rid", "n", "wide")]).withColumnRenamed(f"rid_{x}", x) for x in "uv")
        near = pairs.join(a, "u").join(b, "v").filter(_alike(F.col("n_u"), F.col("n_v"), self.similar)).filter(_far(F.col("wide_u"), F.col("wide_v")) <= FAR)
        near = durable(near.select("u", "v"), "simhash-near")
        sets = self.sets(near.select(F.explode(F.array("u", "v")).alias("rid")))
        a, b = sets.select(F.col("rid").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("rid").alias("v"), F.col("shingles").alias("b"))
        both = F.size(F.array_intersect("a", "b"))
        return durable(near.join(a, "u").join(b, "v").filter(both >= self.similar * (F.size("a") + F.size("b") - both)).select("u", "v"), "simhash-links")


def _compare(similar: float):
    """A block of rows against another of the same crowd: edges that join components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rest, all_ = pdf[pdf["asks"]], pdf[~pdf["asks"]].reset_index(drop=True)
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        if not len(rest) or not len(all_):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        wide = np.stack(all_["wide"].to_list()).astype(np.uint32)
        sizes, comps, rids, sets = all_["n"].to_numpy(), all_["comp"].to_numpy(), all_["rid"].to_numpy(), all_["shingles"].to_list()
        found = []
        for r in rest.itertuples(index=False):
            far = np.bitwise_count(wide ^ np.asarray(r.wide).astype(np.uint32)).sum(axis=1)
            able = (far <= FAR) & (np.minimum(sizes, r.n) >= similar * np.maximum(sizes, r.n)) & (comps != r.comp)
            mine = np.asarray(r.shingles)
            for k in np.flatnonzero(able).tolist():
                a, b = find(r.comp), find(int(comps[k]))
                if a != b:
                    both = len(np.intersect1d(mine, np.asarray(sets[k]), assume_unique=True))
                    if both >= similar * (len(mine) + len(sets[k]) - both):
                        root[max(a, b)] = min(a, b)
                        found.append((r.rid, int(rids[k])))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return run


def _crowd_links(crowded: DataFrame, verifier: Verifier) -> tuple[DataFrame, DataFrame]:
    """Links within crowded balls, and ``rid, crowd``.

    ``crowded`` has ``key, rid`` and ``first``, the smallest ``rid`` of the key.
    Rows that share crowded balls are a crowd.
    All of it are compared with a few leaders, those in most of its balls: that
    leaves one large component and a rest.  The rest is compared with all of
    the crowd, block against block; only edges that join components come out.
    The components are those of all pairs of the crowd.
    """
    # A row has a fixed number of keys.  With the least of their firsts as centre, rows of a crowd share most of their edges.
    firsts = crowded.groupBy("rid").agg(F.collect_set("first").alias("firsts"))
    stars = firsts.select(F.array_min("firsts").alias("u"), F.explode(F.array_append("firsts", F.col("rid"))).alias("v")).distinct()
    named = connected_components(stars).select(F.col("node").alias("rid"), F.col("component").alias("crowd"))
    balls = crowded.groupBy("rid").agg(F.count("*").alias("balls"))
    members = durable(named.join(balls, "rid"), "simhash-crowds")
    order = F.struct("balls", (-F.col("rid")).alias("first"))
    leaders = members.groupBy("crowd", F.pmod(F.xxhash64("rid"), F.lit(LEADERS)).alias("part")).agg(F.max_by("rid", order).alias("u")).select("crowd", "u")
    met = verifier.links(members.join(leaders, "crowd").filter("rid <> u").select("u", F.col("rid").alias("v")))
    comps = connected_components(met)
    placed = durable(members.join(comps, members["rid"] == comps["node"], "left").select("crowd", "rid", F.coalesce("component", "rid").alias("comp")), "simhash-placed")
    largest = placed.groupBy("crowd", "comp").agg(F.count("*").alias("k")).groupBy("crowd").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("k"))
    asked = durable(placed.join(largest, "crowd").select("*", (F.col("comp") != F.col("main")).alias("rest")), "simhash-asked")
    many = asked.groupBy("crowd").agg(F.count_if("rest").alias("r")).filter("r > 0")
    rows = asked.join(many, "crowd").withColumn("asking", F.ceil(F.col("r") / BLOCKS[0])).withColumn("asked", F.ceil(F.col("k") / BLOCKS[1]))
    blocks = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    mine = rows.filter("rest").select("crowd", "rid", "comp", F.pmod(F.xxhash64("rid", F.lit(1)), "asking").alias("i"), blocks("asked").alias("j"), F.lit(True).alias("asks"))
    all_ = rows.select("crowd", "rid", "comp", blocks("asking").alias("i"), F.pmod(F.xxhash64("rid", F.lit(2)), "asked").alias("j"), F.lit(False).alias("asks"))
    sets = verifier.sets(rows)
    dealt = mine.unionByName(all_).join(verifier.firsts, "rid").join(sets, "rid")
    found = dealt.groupBy("crowd", "i", "j").applyInPandas(_compare(verifier.similar), "u long, v long")
    return met.union(durable(found, "simhash-blocks")), members.select("rid", "crowd")


def crowd_size(texts: int, least: int = CROWD) -> int:
    """Rows that a ball must exceed to be a crowd.

    A key of 32 bits brings a ball ``texts * 22 / 2**32`` unrelated rows by
    chance.  The bound stays eight deviations above twice that, so that balls of
    unrelated rows are compared in pairs, inside the ball, and join no crowd.
    """
    chance = texts * (1 + UNSURE + UNSURE * (UNSURE - 1) // 2) / 2**32
    return max(least, math.ceil(2 * chance + 8 * math.sqrt(chance))) if chance > 0.01 else least


def similar_links(firsts: DataFrame, texts: DataFrame, similar: float = SIMILAR, crowd: int = CROWD) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of all verified pairs that meet in a ball.

    ``firsts`` has ``rid, n, wide``, one row a distinct set of shingles, and
    ``texts`` has ``rid, text``.  Balls of up to ``crowd`` rows, or more where
    more meet by chance, are compared in pairs; rows of larger ones form crowds.
    """
    crowd = crowd_size(firsts.count(), crowd)
    verifier = Verifier(firsts, texts, similar)
    keys = firsts.select("rid", F.posexplode("wide").alias("segment", "packed")).select("rid", F.explode(_ball(F.col("segment"), F.col("packed"))).alias("key"))
    shared = durable(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rid").alias("first")).filter("n > 1"), "simhash-shared")
    met = durable(keys.join(shared, "key"), "simhash-met")
    crowded = met.filter(F.col("n") > crowd).select("key", "rid", "first")
    links, few = None, met.filter(F.col("n") <= crowd).select("key", "rid", F.col("rid").alias("crowd"))
    if not crowded.isEmpty():
        links, members = _crowd_links(crowded, verifier)
        # Rows of one crowd have been compared.
        placed = few.drop("crowd").join(members, "rid", "left").select("key", "rid", F.coalesce("crowd", "rid").alias("crowd"))
        mixed = placed.groupBy("key").agg(F.min("crowd").alias("a"), F.max("crowd").alias("b")).filter("a <> b").select("key")
        few = durable(placed.join(mixed, "key", "left_semi"), "simhash-few")
    u, v = few.select("key", F.col("rid").alias("u"), F.col("crowd").alias("cu")), few.select("key", F.col("rid").alias("v"), F.col("crowd").alias("cv"))
    pairs = u.join(v, (u["key"] == v["key"]) & (F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv"))).select("u", "v").distinct()
    close = verifier.links(pairs)
    return close if links is None else links.union(close)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR, crowd: int = CROWD) -> DataFrame:
    """One row of ``docs`` a group of near copies, columns unchanged.

    Groups are the components of the links between texts that share ``similar``
    of their five-word shingles.  The row with the smallest id stays; rows
    without an id come last, and of rows that agree in it any one stays.  Rows
    are told apart by an id that is written with them.  Null texts and texts
    without words are one group.
    """
    rid = "__rid" + "_" * max(map(len, docs.columns))
    rows = durable(docs.withColumn(rid, F.monotonically_increasing_id()), "simhash-rows")
    pref = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(rid).alias("rid"))
    marks = durable(bounded_batches(rows).select(pref.alias("pref"), _mark(F.col(text)).alias("m")).select("pref", "m.*"), "simhash-marks")
    firsts = durable(marks.groupBy("whole").agg(F.min("pref").alias("pref"), F.first("n").alias("n"), F.first("wide").alias("wide")).withColumn("rid", F.col("pref.rid")), "simhash-firsts")
    edges = similar_links(firsts, rows.select(F.col(rid).alias("rid"), F.col(text).alias("text")), similar, crowd)
    groups = connected_components(edges).withColumnRenamed("node", "rid")
    placed = firsts.join(groups, "rid", "left").select("pref", F.coalesce("component", "rid").alias("component"))
    kept = durable(placed.groupBy("component").agg(F.min("pref").alias("pref")).select(F.col("pref.rid").alias(rid)), "simhash-kept")
    return rows.join(kept, rid, "left_semi").select(*docs.columns)
