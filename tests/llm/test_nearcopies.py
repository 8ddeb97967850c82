"""The near-duplicate stage against brute force and planted copies."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from gridloom.llm import simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOC)


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def changed(r, text, n):
    words = text.split()
    for at in r.sample(range(len(words)), n):
        words[at] = "changed" + str(r.randrange(10**9))
    return " ".join(words)


def jaccard(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def survivors(texts):
    """The smallest id of each component of the pairs of Jaccard 0.8 or more."""
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(texts)), 2):
        if jaccard(texts[a], texts[b]) >= 0.8:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {find(k) for k in range(len(texts))}


def test_stage_drops_planted_near_copies(spark):
    import corpus_pipeline

    r = random.Random(1)
    texts = [prose(r, r.randint(60, 300)) for _ in range(60)]
    texts += [changed(r, t, k % 4) for k, t in enumerate(texts[:40])] + [changed(r, t, 40) for t in texts[40:50]]
    want = survivors(texts)
    assert len(texts) - len(want) >= 30
    got = corpus_pipeline.drop_near_duplicates(spark, table(spark, enumerate(texts)), "").collect()
    assert {x.doc_id for x in got} == want and len(got) == len(want)


@pytest.mark.parametrize("crowd", [1000, 8, 2])
def test_crowded_balls_have_the_components_of_all_pairs(spark, crowd):
    r = random.Random(2)
    base = prose(r, 200)
    texts = [base] + [changed(r, base, r.randint(0, 3)) for _ in range(60)] + [changed(r, base, 9) for _ in range(10)]
    kept = [x.doc_id for x in simhash.keep_one(table(spark, enumerate(texts)), crowd=crowd).collect()]
    assert sorted(kept) == sorted(survivors(texts))


def test_rows_with_equal_or_no_ids_are_told_apart(spark):
    r = random.Random(3)
    a, b, c, d = (prose(r, 120) for _ in range(4))
    rows = [(1, a), (1, b), (None, c), (None, changed(r, c, 1)), (2, changed(r, a, 1)), (None, d), (None, changed(r, b, 1)), (5, None), (6, " ")]
    got = simhash.keep_one(table(spark, rows)).collect()
    assert sorted((x.doc_id or 0) for x in got) == [0, 0, 1, 1, 5]
    assert {x.text for x in got} >= {a, b, d, None}
    assert simhash.keep_one(table(spark, rows[:0])).count() == 0


def test_recall_on_two_thousand_planted_pairs():
    """Pairs of sets of shingles at a similarity of 0.8 to 0.84 share a key and are near enough to be verified."""
    rng = np.random.default_rng(11)

    def keys(wide):
        out = set()
        for k, packed in enumerate(wide):
            value, bits = packed & (2**32 - 1), [1 << (packed >> (32 + 5 * j) & 31) for j in range(simhash.UNSURE)]
            flips = [0, *bits, *(a | b for j, a in enumerate(bits) for b in bits[:j])]
            out |= {(k, value ^ f) for f in flips}
        return out

    missed = {True: 0, False: 0}
    times = {True: 0, False: 0}
    for _ in range(2000):
        n = int(rng.integers(20, 400))
        own = max(1, int(n * rng.uniform(0.085, 0.11)))
        pool = rng.integers(0, 1 << 63, n + own, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[own:])
        both = len(np.intersect1d(a, b))
        if both < 0.8 * (len(a) + len(b) - both):
            continue
        x, y = simhash.wide_segments(a), simhash.wide_segments(b)
        far = sum(((p ^ q) & (2**32 - 1)).bit_count() for p, q in zip(x, y))
        short = n < 60
        times[short] += 1
        missed[short] += far > simhash.FAR or not keys(x) & keys(y)
    assert times[False] > 1400 and times[True] > 100
    # Measured: 14 of 1,784, and 4 of 216 pairs of under 60 shingles.
    assert missed[False] <= 0.01 * times[False] and missed[True] <= 0.03 * times[True], (missed, times)


def test_chance_never_makes_a_crowd():
    assert simhash.crowd_size(10**6) == simhash.CROWD
    for n in (10**8, 10**9, 10**10):
        chance = n * 22 / 2**32
        assert simhash.crowd_size(n) > chance + 8 * chance**0.5
