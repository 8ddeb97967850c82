"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature at a time and then one pair
at a time, over binned features; what they learn is kept as one lookup table a
feature and one a pair.  A score is the sum of one table entry each, so scoring
is a few vectorised gathers and additions.

The features describe the text alone.  Labels, language, source and ids are
never inputs.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.plans.durable import durable
from gridloom.plans.session import bounded_batches

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper_share", "digit_share", "symbol_share", "bang_share", "pipe_share",
    "stop_share", "line_words", "dup_line_share", "distinct_share", "top_share", "high_share", "punct_share", "repeat_share",
)
MAX_TRAINING_ROWS = 40_000


def text_features(text: str | None) -> np.ndarray:
    """The features of one whole text; all zero for null and for empty texts."""
    out = np.zeros(len(FEATURES), dtype=np.float32)
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if not raw:
        return out
    n = len(raw)
    each = np.zeros(256, dtype=np.int64)
    for at in range(0, n, 1 << 20):
        each += np.bincount(np.frombuffer(raw, np.uint8, count=min(1 << 20, n - at), offset=at), minlength=256)
    words = raw.split()
    m = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    counts = Counter(words)
    letters = max(1, int(each[65:91].sum() + each[97:123].sum() + each[128:].sum()))
    pairs = list(zip(words, words[1:]))
    out[:] = (
        np.log1p(n),
        np.log1p(len(words)),
        n / m,
        each[65:91].sum() / letters,
        each[48:58].sum() / n,
        each[list(b"#*$%&<>@^~{}[]\\_=+")].sum() / m,
        each[33] / m,
        each[124] / m,
        each[46] / m,
        len(words) / k,
        1 - len(set(lines)) / k,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        each[128:].sum() / n,
        each[list(b",;:'\"()-?")].sum() / m,
        1 - len(set(pairs)) / max(1, len(pairs)),
    )
    return out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def features(text: pd.Series) -> pd.Series:
    return pd.Series([text_features(x) for x in text])


@dataclass(frozen=True)
class GamModel:
    """``cuts`` a feature, one table a feature, and ``(i, j, table)`` a pair."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for a matrix of features."""
        bins = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)]
        total = np.full(len(x), self.intercept)
        for b, t in zip(bins, self.tables):
            total += t[b]
        for i, j, ci, cj, t in self.pairs:
            total += t[np.searchsorted(ci, x[:, i], side="right"), np.searchsorted(cj, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def score_text(self, text: Column) -> Column:
        """Scores of texts, whole, one pass and no shuffle."""
        model = self

        @F.pandas_udf(T.DoubleType())
        def scored(texts: pd.Series) -> pd.Series:
            if not len(texts):
                return pd.Series([], dtype="float64")
            return pd.Series(model.score(np.stack([text_features(x) for x in texts])))

        return scored(text)


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _split(g: np.ndarray, h: np.ndarray, reg: float, least: float) -> tuple[float, int]:
    """Best gain and cut of ordered bins; cut 0 if none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gt, ht = g.sum(), h.sum()
    gain = gl**2 / (hl + reg) + (gt - gl) ** 2 / (ht - hl + reg) - gt**2 / (ht + reg)
    gain[(hl < least) | (ht - hl < least)] = -1
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, reg: float, least: float) -> np.ndarray:
    """A tree of up to four leaves over ordered bins, as a value a bin."""
    parts = [slice(0, len(g))]
    for _ in range(2):
        grown = []
        for p in parts:
            _, cut = _split(g[p], h[p], reg, least)
            grown += [slice(p.start, p.start + cut), slice(p.start + cut, p.stop)] if cut else [p]
        parts = grown
    out = np.zeros(len(g))
    for p in parts:
        out[p] = -g[p].sum() / (h[p].sum() + reg)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, reg: float, least: float) -> tuple[float, np.ndarray]:
    """One cut along either axis, then one along the other in each half."""
    best, table = 0.0, np.zeros(g.shape)
    for turn in (0, 1):
        a, b = (g, h) if turn == 0 else (g.T, h.T)
        first, cut = _split(a.sum(1), b.sum(1), reg, least)
        if not cut:
            continue
        out, total = np.zeros(a.shape), first
        for rows in (slice(0, cut), slice(cut, a.shape[0])):
            ga, hb = a[rows].sum(0), b[rows].sum(0)
            gain, at = _split(ga, hb, reg, least)
            total += gain
            for cols in (slice(0, at), slice(at, a.shape[1])) if at else (slice(0, a.shape[1]),):
                out[rows, cols] = -ga[cols].sum() / (hb[cols].sum() + reg)
        if total > best:
            best, table = total, out if turn == 0 else out.T
    return best, table


def train(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 8, rounds: int = 120, n_pairs: int = 6, rate: float = 0.15, reg: float = 1.0, least: float = 2.0) -> GamModel:
    """Cyclic boosting on a bounded sample; deterministic.

    Without rows of both labels the model is the constant prior.
    """
    k = x.shape[1] if x.ndim == 2 else len(FEATURES)
    prior = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
    base = float(np.log(prior / (1 - prior)))
    cuts = [_cuts(x[:, f], bins) for f in range(k)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    if len(np.unique(y)) < 2:
        return GamModel(base, cuts, tables, [])
    idx = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    total = np.full(len(y), base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for f in range(k):
            if len(tables[f]) < 2:
                continue
            g, h = gradients()
            step = rate * _tree(np.bincount(idx[f], g, len(tables[f])), np.bincount(idx[f], h, len(tables[f])), reg, least)
            tables[f] += step
            total += step[idx[f]]
    coarse = [_cuts(x[:, f], pair_bins) for f in range(k)]
    cidx = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]

    def grid(i: int, j: int, w: np.ndarray) -> np.ndarray:
        a, b = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(cidx[i] * b + cidx[j], w, a * b).reshape(a, b)

    g, h = gradients()
    ranked = sorted(((-_tree2(grid(i, j, g), grid(i, j, h), reg, least)[0], i, j) for i in range(k) for j in range(i + 1, k)))[:n_pairs]
    chosen = [(i, j) for gain, i, j in ranked if gain < 0]
    learned = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(rounds // 2):
        for i, j in chosen:
            g, h = gradients()
            step = rate * _tree2(grid(i, j, g), grid(i, j, h), reg, least)[1]
            learned[i, j] += step
            total += step[cidx[i], cidx[j]]
    return GamModel(base, cuts, tables, [(i, j, coarse[i], coarse[j], t) for (i, j), t in learned.items()])


def held_out(key: Column) -> Column:
    """True for the fold that training never sees; null ids are held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS, key: str = "doc_id", text: str = "text") -> GamModel:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold.

    The rows are those with the smallest hashed ids, so reruns agree; only their
    texts are featurised.  Null labels are left out; a document that is labelled
    twice counts twice, and so does a repeated row.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).filter("y IS NOT NULL AND id IS NOT NULL").filter(~held_out(F.col("id")))
    ids = docs.select(F.col(key).alias("id")).join(known, "id").orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    chosen = durable(ids.distinct(), "quality-chosen")
    # At most max_rows ids and labels.
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    found = durable(bounded_batches(rows).select("id", "y", features(F.col("text")).alias("x")), "quality-training")
    rows = found.orderBy(F.xxhash64("id"), "id", "y", "x").limit(max_rows).select("x", "y").toPandas()
    x = np.stack(rows["x"].to_list()).astype(np.float32) if len(rows) else np.zeros((0, len(FEATURES)), np.float32)
    return train(x, rows["y"].to_numpy(dtype=np.float64))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    Null and empty texts get the score of all-zero features.  Repeated rows
    are scored each; columns other than the id and the text aren't read.
    """
    model = fit(docs, labels)
    return bounded_batches(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score_text(F.col("text")).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, columns unchanged."""
    model = fit(docs, labels)
    return bounded_batches(docs).filter(model.score_text(F.col("text")) >= threshold)
