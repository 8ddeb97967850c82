"""Periodic runs of words: passages that repeat one root four times or more.

A run's root, turned to its least rotation, is a Lyndon word, and the longest
Lyndon word from its place under the order of words or under the reversed order
is that root.  So two Lyndon arrays give every run.  Both are computed from left
to right with a stack of the places whose next smaller suffix is still unknown:
a comparison starts from what an earlier one has matched, either through a
place in between or through the last matched stretch, in which everything
stands a second time one shift to the left.  No suffix is sorted or hashed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.plans.session import bounded_batches

LEAST_LENGTH = 6
LEAST_EXPONENT = 4

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


def lyndon_array(x: list[int]) -> tuple[list[int], list[int]]:
    """Where the longest Lyndon word from each place ends, and how far the text from there matches the text from the place.

    ``prev[r]`` is the nearest place to the left with a smaller suffix and
    ``match[r]`` how far both agree; ``follow`` and ``agree`` are the same for
    the next smaller suffix.  ``[low, high)`` and ``[left, high - shift)`` hold
    the same words: the match that reaches farthest right.
    """
    n = len(x)
    follow, agree = [n] * n, [0] * n
    prev, match = [-1] * n, [0] * n
    left = low = high = shift = 0
    for r in range(1, n):
        j, known = r - 1, 0
        fresh = True  # whether x[j:] and x[r:] must be compared beyond ``known``
        while j >= 0:
            if fresh:
                m = known
                if r + m < high and j - shift >= left:
                    s, k = r - shift, j - shift
                    seen = agree[k] if follow[k] == s else match[s] if prev[s] == k else 0
                    m = max(m, min(seen, high - r))
                    exact = seen < high - r and (follow[k] == s or prev[s] == k)
                else:
                    exact = False
                if not exact:
                    while r + m < n and x[j + m] == x[r + m]:
                        m += 1
                    if r + m > high:
                        left, low, high, shift = j, r, r + m, r - j
                smaller = r + m == n or x[r + m] < x[j + m]
            if not smaller:
                break
            follow[j], agree[j] = r, m
            # What lies below j on the stack agrees with x[j:] for match[j] words.
            known, j, up = m, prev[j], match[j]
            fresh = up == known
            if up < known:
                m, smaller = up, False
            elif up > known:
                m, smaller = known, True
        prev[r], match[r] = j, m if j >= 0 else 0
    return follow, agree


def runs_of(x: list[int], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> set[tuple[int, int, int]]:
    """``(start, length, period)`` of all maximal runs of at least the given length and exponent (two or more)."""
    found, n = set(), len(x)
    for order in (x, [-v for v in x]):
        follow, agree = lyndon_array(order)
        reached: dict[int, int] = {}
        for i, end in enumerate(follow):
            p = end - i
            # The leftmost root of a run has less than a period before it.
            if agree[i] + 2 * p <= max(least_length, least_exponent * p) or i + p <= reached.get(p, 0):
                continue
            first = i
            while first > 0 and i - first < p and x[first - 1] == x[first - 1 + p]:
                first -= 1
            reached[p] = end + agree[i]
            length = reached[p] - first
            if i - first < p and length >= max(least_length, least_exponent * p):
                found.add((first, length, p))
    return found


def _stretches(codes: np.ndarray, text_of: np.ndarray, times: int, least: int) -> list[tuple[int, int]]:
    """Stretches of words outside which no run can reach.

    A run holds each of its words at least ``times`` times, so a word that its
    stretch holds less often parts it; stretches are parted until none is.
    """
    at, part = np.arange(len(codes)), text_of.astype(np.int64)
    width = int(codes.max()) + 1 if len(codes) else 1
    while len(at):
        _, inverse, counts = np.unique(part * width + codes[at], return_inverse=True, return_counts=True)
        keep = counts[inverse] >= times
        left, owner = at[keep], part[keep]
        if not len(left):
            break
        begins = np.concatenate(([True], (np.diff(left) != 1) | (np.diff(owner) != 0)))
        piece = np.cumsum(begins) - 1
        long = np.bincount(piece)[piece] >= least
        done = keep.all() and long.all()
        at, part = left[long], piece[long]
        if done:
            starts = np.flatnonzero(begins)
            return [(int(at[s]), int(e - s)) for s, e in zip(starts, [*starts[1:], len(at)])]
    return []


def periodic(words: list[bytes], h: int) -> list[bytes]:
    """The words with a root repeated from a place on, both drawn from ``h``; unchanged unless ten divides it."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * ((n - a) // p + 1))[: n - a]


def find_runs(texts: list[str | None], planted: list[int | None], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> tuple[list[list[tuple]], list[str]]:
    """Runs of every text of a batch, by start and then period, and the texts without repeats of a root."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    split = [w if h is None or h != h else periodic(w, int(h)) for w, h in zip(split, planted)]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.empty(begin[-1], dtype=object)
    for w, b in zip(split, begin):
        flat[b : b + len(w)] = w
    codes, vocabulary = pd.factorize(flat)
    rank = np.empty(len(vocabulary), dtype=np.int64)
    rank[sorted(range(len(vocabulary)), key=vocabulary.__getitem__)] = np.arange(len(vocabulary))
    codes = rank[codes]
    text_of = np.repeat(np.arange(len(split)), sizes)
    runs: list[list[tuple]] = [[] for _ in split]
    for s, n in _stretches(codes, text_of, least_exponent, least_length):
        k = text_of[s]
        runs[k] += [(s - int(begin[k]) + at, length, p) for at, length, p in runs_of(codes[s : s + n].tolist(), least_length, least_exponent)]
    collapsed = []
    for w, found in zip(split, runs):
        found.sort(key=lambda r: (r[0], r[2]))
        if found:
            drop = np.zeros(len(w), dtype=bool)
            for s, length, p in found:
                drop[s + p : s + length] = True
            w = [x for x, gone in zip(w, drop) if not gone]
        collapsed.append(b" ".join(w).decode("utf-8", "surrogatepass"))
    return runs, collapsed


@F.pandas_udf(FOUND)
def _found(text: pd.Series, planted: pd.Series) -> pd.DataFrame:
    runs, collapsed = find_runs(text.tolist(), planted.tolist())
    return pd.DataFrame({"runs": [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs], "collapsed": collapsed})


def collapse(docs: DataFrame, text: str = "text", planted: Column | None = None) -> DataFrame:
    """Adds ``runs`` (start, length, period in words, by start and then period) and ``collapsed``.

    A run is a stretch of words with a smallest period, at least six words and
    four periods long, that can't be extended; ``collapsed`` has the words that
    no run holds after its first period, joined by one space.  Null and empty
    texts have no words, no runs and an empty result; rows stay as they are,
    repeated ones too; columns of these names are replaced.  No shuffle: each
    text is judged on its own, in linear time.  ``planted`` (a number per row)
    repeats a root in the text first where ten divides it, see ``periodic``.
    """
    planted = F.lit(None).cast("long") if planted is None else planted
    found = bounded_batches(docs).withColumn("__found", _found(F.col(text), planted))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    return found.select(*kept, F.col("__found.runs").alias("runs"), F.col("__found.collapsed").alias("collapsed"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs per document as counts, the longest and digests, in texts made periodic by their id; a null id leaves its text alone."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = collapse(rows, planted=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    best = found.select("doc_id", "runs", "collapsed", longest.alias("b"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
        F.expr("1000 * b.length div -b.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         4294967295 - list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
           lambda crc, c: list_reduce([xor(crc, c)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS h
  FROM documents
), a AS (
  SELECT rid, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS k FROM t
), x AS (
  SELECT rid, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) ELSE w END AS w FROM a
), tok AS (
  SELECT rid, n, unnest(w) AS word, unnest(range(n)) AS i FROM x
), same AS (
  SELECT l.rid, r.i - l.i AS q, l.i FROM tok l JOIN tok r ON l.rid = r.rid AND l.word = r.word AND r.i > l.i AND 4 * (r.i - l.i) <= l.n
), runs AS (
  SELECT rid, q, min(i) AS s, count(*) + q AS len FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS g FROM same)
  GROUP BY rid, q, g HAVING count(*) + q >= greatest(6, 4 * q)
), own AS (
  SELECT * FROM runs r WHERE NOT EXISTS (FROM runs o WHERE o.rid = r.rid AND o.q < r.q AND o.s <= r.s AND o.s + o.len >= r.s + r.len)
), gone AS (
  SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM own
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM tok ANTI JOIN gone USING (rid, i) GROUP BY rid
), best AS (
  SELECT rid, count(*) AS n_runs, arg_min(struct_pack(s := s, len := len, q := q), [-len, s, q]) AS b,
         string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM own GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.len::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.len // b.q)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM x LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""
