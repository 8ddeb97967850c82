"""Search of settings by successive halving: many small models over one pass of the rows a step.

Every trial is a linear model over some groups of columns, fitted on all folds
but one for each fold.  A step is one job over the rows: tasks add up the
gradients of all open trials and folds, and only these sums, whose size is that
of the models, meet.  After a rung of steps the trials that do worst on the
held-out folds end, and the others go on from where they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.learn import Fitted, assign_folds, finite, fit_classifier
from gridloom.plans.durable import durable

BASE_REG, REGS = 1e-4, (1e-6, 1e-1)


@dataclass(frozen=True)
class Trial:
    trial: int
    reg: float
    balanced: bool
    columns: tuple[str, ...]
    steps: int = 0
    loss: float = float("inf")
    accuracy: float = 0.0


def draw(groups: dict[str, Sequence[str]], n: int, seed: int = 0) -> list[Trial]:
    """Trial 0 has every column and the settings of no search; the others are drawn, penalties evenly by their logarithm."""
    every = tuple(c for g in groups.values() for c in g)
    rng, out = np.random.default_rng(seed), [Trial(0, BASE_REG, False, every)]
    for k in range(1, n):
        reg = float(np.exp(rng.uniform(*np.log(REGS))))
        balanced, use = bool(rng.integers(2)), rng.integers(2, size=len(groups))
        some = tuple(c for g, u in zip(groups.values(), use) if u for c in g)
        out.append(Trial(k, reg, balanced, some or every))
    return out


def _softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def _sums(rows: DataFrame, params: np.ndarray, weights: np.ndarray, folds: int, held_out: bool) -> dict[int, np.ndarray]:
    """By fold: what the rows of the other folds (or of the fold itself) add up to, as one flat array.

    ``params`` are ``(models, folds, columns + 1, classes)``, ``weights`` ``(models, classes)``.
    Gradients and the weight, or loss, hits by class and rows by class.
    """
    models, _, width, classes = params.shape

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for pdf in batches:
            x = np.column_stack([np.vstack(pdf["x"]), np.ones(len(pdf))]) if len(pdf) else np.zeros((0, width))
            y, fold = pdf["y"].to_numpy(int), pdf["fold"].to_numpy(int)
            for f in range(folds):
                use = fold == f if held_out else fold != f
                if not use.any():
                    continue
                xs, ys = x[use], y[use]
                p = _softmax(np.einsum("rd,mdc->mrc", xs, params[:, f]))
                if held_out:
                    mine = np.maximum(p[:, np.arange(len(ys)), ys], 1e-15)
                    hit = p.argmax(axis=2) == ys
                    one = np.eye(classes)[ys]
                    flat = np.concatenate([-np.log(mine).sum(axis=1), (hit.astype(float) @ one).ravel(), one.sum(axis=0)])
                else:
                    w = weights[:, ys]
                    rest = (p - np.eye(classes)[ys]) * w[:, :, None]
                    flat = np.concatenate([np.einsum("rd,mrc->mdc", xs, rest).ravel(), w.sum(axis=1)])
                totals[f] = totals[f] + flat if f in totals else flat
        yield pd.DataFrame({"fold": list(totals), "sums": list(totals.values())}, columns=["fold", "sums"])

    parts = rows.mapInPandas(add, "fold int, sums array<double>")
    met = parts.select("fold", F.posexplode("sums").alias("k", "v")).groupBy("fold", "k").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for f, cells in met.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("c")).collect():
        out[f] = np.array([c.v for c in cells])
    return out


def halving(rows: DataFrame, groups: dict[str, Sequence[str]], label: str, key: str, trials: int = 9, eta: int = 3, steps: int = 6, folds: int = 3, seed: int = 0) -> tuple[DataFrame, Fitted]:
    """``rung, trial, reg, balanced, columns, steps, loss, accuracy, kept`` of every trial in each rung, and the winner fitted on all rows.

    A rung keeps one of ``eta`` open trials, by loss on the held-out folds and
    then by number, and the first trial beside them, so that the winner is never
    worse than no search; its steps are ``eta`` times those of the rung before.
    Ends when one trial is left beside the first.  Labels are 0, 1, ...; rows
    without one are left out, values that aren't finite count as 0.  Fewer than
    two labels raise.
    """
    every = tuple(c for g in groups.values() for c in g)
    if not every or trials < 1 or eta < 2 or folds < 2:
        raise ValueError("a search needs columns, a trial, an eta of two or more and two folds or more")
    spark = rows.sparkSession
    labelled = rows.filter(F.col(label).isNotNull()).select(F.col(key), F.col(label).cast("int").alias("y"), finite(every).alias("__v"))
    folded = durable(assign_folds(labelled, key, "y", folds, seed=seed).select("y", "fold", "__v"), "search-folds")
    counts = {r.y: r["count"] for r in folded.groupBy("y").count().collect()}
    if len(counts) < 2:
        raise ValueError("a search needs at least two labels")
    classes, total = max(counts) + 1, sum(counts.values())
    k = folded.agg(F.max("fold")).first()[0] + 1
    spread = folded.agg(*[f(F.get("__v", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(len(every))]).first()
    mean, sd = spread[: len(every)], spread[len(every) :]
    standard = F.array(*[(F.get("__v", F.lit(i)) - F.lit(float(mean[i]))) / F.lit(float(sd[i] or 1.0)) for i in range(len(every))])
    ready = durable(folded.select("y", F.col("fold").cast("int").alias("fold"), standard.alias("x")), "search-rows")

    open_, told = draw(groups, trials, seed), []
    params = np.zeros((trials, k, len(every) + 1, classes))
    even = np.array([total / (len(counts) * counts[c]) if c in counts else 0.0 for c in range(classes)])
    rung, more = 0, steps
    while True:
        ids = [t.trial for t in open_]
        weights = np.array([even if t.balanced else np.ones(classes) for t in open_])
        mask = np.array([[*[c in t.columns for c in every], True] for t in open_], float)[:, :, None]
        shrink = mask * np.array([t.reg for t in open_])[:, None, None]
        shrink[:, -1] = 0
        # The curvature of a mean of such losses is at most half of the squared length of a row, times the largest weight.
        rate = 1 / (0.5 * mask.sum(axis=1, keepdims=True) * weights.max(axis=1)[:, None, None] + 1)
        for _ in range(more):
            sums = _sums(ready, params[ids], weights, k, False)
            for f, flat in sums.items():
                cut = len(ids) * (len(every) + 1) * classes
                slope = flat[:cut].reshape(len(ids), len(every) + 1, classes) / flat[cut:][:, None, None]
                params[ids, f] -= rate * mask * (slope + shrink * params[ids, f])
        seen = sum(_sums(ready, params[ids], weights, k, True).values())
        loss = np.round(seen[: len(ids)] / total, 9)
        hits = seen[len(ids) : len(ids) * (1 + classes)].reshape(len(ids), classes)
        present = seen[len(ids) * (1 + classes) :]
        recall = (hits[:, present > 0] / present[present > 0]).mean(axis=1).round(9)
        open_ = sorted((replace(t, steps=t.steps + more, loss=float(a), accuracy=float(r)) for t, a, r in zip(open_, loss, recall)), key=lambda t: (t.loss, t.trial))
        # The last rung has one trial beside the first, or only that.
        last = sum(t.trial != 0 for t in open_) <= 1
        stay = open_[:1] if last else open_[: max(1, len(open_) // eta)]
        if not last and all(t.trial != 0 for t in stay):
            stay = stay + [t for t in open_ if t.trial == 0]
        told += [(rung, t.trial, t.reg, t.balanced, list(t.columns), t.steps, t.loss, t.accuracy, t in stay) for t in open_]
        if last:
            break
        open_, rung, more = stay, rung + 1, more * eta
        if len(open_) == 1:
            told += [(rung, t.trial, t.reg, t.balanced, list(t.columns), t.steps, t.loss, t.accuracy, True) for t in open_]
            break
    best = open_[0]
    table = spark.createDataFrame(told, "rung int, trial int, reg double, balanced boolean, columns array<string>, steps int, loss double, accuracy double, kept boolean")
    weighted = rows.filter(F.col(label).isNotNull()).withColumn("__w", F.element_at(F.create_map(*[F.lit(v) for c, n in counts.items() for v in (c, float(even[c]))]), F.col(label).cast("int")) if best.balanced else F.lit(1.0))
    return table, fit_classifier(weighted, best.columns, label, weight="__w", reg=best.reg)
