"""Successive halving against plain descent, its rungs, and what it refuses."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import learn, search

GROUPS = {"good": ["a", "b"], "noise": ["c"], "other": ["d"]}


def planted(spark, n=240, classes=2):
    rng = np.random.default_rng(3)
    y = np.arange(n) % classes
    rows = [(k, *map(float, (y[k] + rng.normal(0, 0.6), y[k] * -1 + rng.normal(0, 0.9), rng.normal(), rng.normal())), int(y[k])) for k in range(n)]
    return spark.createDataFrame(rows, "key long, a double, b double, c double, d double, y int")


def plain_loss(df, trial, steps, folds):
    """Descent of one trial, fold by fold, in numpy; the folds are the library's."""
    pdf = learn.assign_folds(df, "key", "y", folds, seed=0).toPandas()
    every = [c for g in GROUPS.values() for c in g]
    x = pdf[every].to_numpy()
    x = np.column_stack([(x - x.mean(axis=0)) / x.std(axis=0), np.ones(len(x))])
    use = np.array([*[c in trial.columns for c in every], True], float)
    y, one = pdf["y"].to_numpy(), np.eye(2)[pdf["y"]]
    w = (len(y) / (2 * np.bincount(y)))[y] if trial.balanced else np.ones(len(y))
    loss = 0.0
    top = w.max()
    for f in range(folds):
        t, p = (pdf["fold"] != f).to_numpy(), np.zeros((x.shape[1], 2))
        for _ in range(steps):
            q = np.exp(x[t] @ p)
            q /= q.sum(axis=1, keepdims=True)
            slope = x[t].T @ ((q - one[t]) * w[t][:, None]) / w[t].sum()
            ridge = trial.reg * p
            ridge[-1] = 0
            p -= use[:, None] * (slope + ridge) / (0.5 * use.sum() * top + 1)
        q = np.exp(x[~t] @ p)
        q /= q.sum(axis=1, keepdims=True)
        loss -= np.log(q[np.arange(len(q)), y[~t]]).sum()
    return loss / len(y)


def test_rungs_follow_plain_descent_and_reruns_agree(spark):
    df = planted(spark)
    table, model = search.halving(df, GROUPS, "y", "key", trials=9, steps=2)
    told = table.collect()
    by = {(r.rung, r.trial): r for r in told}
    trials = {t.trial: t for t in search.draw(GROUPS, 9)}
    assert len({t.columns for t in trials.values()}) > 2 and trials[0].reg == search.BASE_REG
    for r in told:
        if r.rung < 2:
            assert abs(r.loss - plain_loss(df, trials[r.trial], r.steps, 3)) < 1e-6
    rungs = sorted({r.rung for r in told})
    for rung in rungs:
        rows = sorted((r for r in told if r.rung == rung), key=lambda r: (r.loss, r.trial))
        kept = {r.trial for r in rows if r.kept}
        assert rows[0].trial in kept and kept == {t for k, t in by if k == rung + 1} or rung == rungs[-1]
    assert (0, 0) in by and len([r for r in told if r.rung == 0]) == 9 and len([r for r in told if r.rung == rungs[-1] and r.kept]) == 1
    winner = next(r for r in told if r.rung == rungs[-1] and r.kept)
    assert winner.loss <= by[rungs[-1], 0].loss and {"a", "b"} <= set(winner.columns) and list(model.columns) == winner.columns
    got = learn.predict(model, df, ["y"])
    assert got.filter(F.col("y") == F.col("predicted")).count() > 190
    again, _ = search.halving(df.repartition(5), GROUPS, "y", "key", trials=9, steps=2)
    assert sorted(map(tuple, again.drop("columns", "loss").collect())) == sorted(map(tuple, table.drop("columns", "loss").collect()))


def test_three_labels_one_trial_and_what_is_refused(spark):
    df = planted(spark, 90, 3).withColumn("a", F.when(F.col("key") == 4, F.lit(None)).when(F.col("key") == 5, float("nan")).otherwise(F.col("a")))
    table, model = search.halving(df, GROUPS, "y", "key", trials=1, steps=2)
    assert [(r.rung, r.trial, r.kept) for r in table.collect()] == [(0, 0, True)] and len(model.weights) == 3
    with pytest.raises(ValueError, match="two labels"):
        search.halving(df.filter("y = 1"), GROUPS, "y", "key")
    with pytest.raises(ValueError, match="two labels"):
        search.halving(df.filter("y > 5"), GROUPS, "y", "key")
    with pytest.raises(ValueError):
        search.halving(df, {}, "y", "key")
