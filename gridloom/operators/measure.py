"""Intensity populations: mixtures, histogram peaks, landmarks.

Every measure is an aggregation per group (a slice); what iterates keeps only
a few numbers per group between rounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bins of a group that a mixture is fitted to; groups of fewer distinct values are fitted exactly.
BINS = 1 << 14


def weighted_bins(df: DataFrame, value: str, by: Sequence[str], trim: float = 0.5, bins: int = BINS, skip_zero: bool = False) -> DataFrame:
    """``by, n, sx, sxx``: count, sum and sum of squares of the finite values in each bin between the ``trim`` percentiles.

    Sums are taken about the middle of the group's range, ``shift``.  Values are
    combined where they lie, so that a group is at most ``bins`` rows from here on.
    """
    x = F.col(value).cast("double")
    finite = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & ((x != 0) | F.lit(not skip_zero))).select(*by, x.alias("x"))
    q = finite.groupBy(*by).agg(F.percentile("x", F.array(F.lit(trim / 100), F.lit(1 - trim / 100))).alias("q"))
    bounds = q.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    same = reduce(lambda a, c: a & c, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    inside = finite.join(bounds, same).filter(F.col("x").between(F.col("low"), F.col("high")))
    shift = (F.col("low") + F.col("high")) / 2
    at = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0)
    moved = inside.select(*by, shift.alias("shift"), at.alias("bin"), (F.col("x") - shift).alias("d"))
    return moved.groupBy(*by, "shift", "bin").agg(F.count("*").alias("n"), F.sum("d").alias("sx"), F.sum(F.col("d") * F.col("d")).alias("sxx"))


def _start(x: np.ndarray, n: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres by k-means++ over weighted places, moved until no place changes its centre."""
    centres = [x[rng.choice(len(x), p=n / n.sum())]]
    for _ in range(1, k):
        near = np.min([(x - c) ** 2 for c in centres], axis=0) * n
        if near.sum() <= 0:
            centres.append(centres[-1])
            continue
        drawn = rng.choice(len(x), size=2 + int(math.log(k)), p=near / near.sum())
        left = [np.minimum(near, (x - x[d]) ** 2 * n).sum() for d in drawn]
        centres.append(x[drawn[int(np.argmin(left))]])
    at, own = np.sort(np.array(centres)), None
    for _ in range(100):
        now = np.abs(x[:, None] - at).argmin(axis=1)
        if own is not None and np.array_equal(now, own):
            break
        own = now
        weight = np.bincount(own, n, k)
        at = np.where(weight > 0, np.bincount(own, n * x, k) / np.maximum(weight, 1e-300), at)
    return np.abs(x[:, None] - at).argmin(axis=1)


def fit_mixture(n: np.ndarray, sx: np.ndarray, sxx: np.ndarray, k: int, seed: int, rounds: int, tol: float, reg: float, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, means and variances by ascending mean, and the mean log-likelihood, from weighted bins.

    A bin's responsibilities are those of its mean; its own sums enter the moments.
    """
    n, x = n.astype(float), sx / n
    total = n.sum()
    share = np.eye(k)[_start(x, n, k, np.random.default_rng(seed))]
    before = -np.inf
    for _ in range(rounds + 1):
        mass = np.maximum((share * n[:, None]).sum(axis=0), 10 * np.finfo(float).eps)
        w, mu = mass / total, share.T @ sx / mass
        var = np.maximum(share.T @ sxx / mass - mu * mu + reg, max(floor, 1e-300))
        log = np.log(np.maximum(w, 1e-300)) - 0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mu) ** 2 / var)
        top = log.max(axis=1, keepdims=True)
        each = np.exp(log - top)
        fit = float(n @ (top[:, 0] + np.log(each.sum(axis=1))) / total)
        share = each / each.sum(axis=1, keepdims=True)
        if abs(fit - before) < tol:
            break
        before = fit
    order = np.argsort(mu, kind="stable")
    return w[order], mu[order], var[order], fit


def gmm(df: DataFrame, value: str, by: Sequence[str], trim: float = 0.5, rounds: int = 100, tol: float = 1e-6, floor: float = 1e-6, k: int = 2, restarts: int = 5, seed: int = 0, reg: float = 1e-6, bins: int = BINS, skip_zero: bool = False) -> DataFrame:
    """Mixture of ``k`` normals per group: ``n, w_1, mu_1, sd_1, w_2, ..., loglik``, means ascending.

    Values outside the ``trim`` percentiles are left out.  Each group and restart
    is fitted to the group's weighted bins, and the restart of the largest mean
    log-likelihood stays, the first on ties.  Groups without values give no
    row; a group of one value has all components there, with the least variance.
    """
    table = weighted_bins(df, value, by, trim, bins, skip_zero)
    tried = table.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    names = [f"{c}_{i}" for i in range(1, k + 1) for c in ("w", "mu", "sd")]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        first = pdf.iloc[0]
        w, mu, var, ll = fit_mixture(*(pdf[c].to_numpy() for c in ("n", "sx", "sxx")), k, seed * 1_000_003 + int(first["restart"]), rounds, tol, reg, floor)
        row = [v for i in range(k) for v in (w[i], mu[i] + first["shift"], math.sqrt(var[i]))]
        out = pdf[[*by, "restart"]].iloc[:1].reset_index(drop=True)
        out[["n", *names, "loglik"]] = [[int(pdf["n"].sum()), *row, ll]]
        return out.astype({"n": "int64"})

    keys = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in by)
    fitted = tried.groupBy(*by, "restart").applyInPandas(fit, f"{keys}, restart int, n long, {', '.join(f'{c} double' for c in names)}, loglik double")
    best = fitted.groupBy(*by).agg(F.max_by(F.struct("n", *names, "loglik"), F.struct(F.round("loglik", 9), -F.col("restart"))).alias("b"))
    return best.select(*by, "b.*")


def hard_stats(df: DataFrame, fitted: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Count, mean and median of the values assigned to each component."""
    x = F.col(value).cast("double")
    score = lambda k: F.log(F.greatest(F.col(f"w_{k}"), F.lit(1e-300))) - F.log(F.col(f"sd_{k}")) - (x - F.col(f"mu_{k}")) ** 2 / (2 * F.col(f"sd_{k}") ** 2)
    assigned = df.join(fitted, list(by)).withColumn("component", F.when(score(1) >= score(2), 1).otherwise(2))
    return assigned.groupBy(*by, "component").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def parabola_offset(left: Column, mid: Column, right: Column) -> Column:
    """Sub-bin offset of a peak in [-1, 1]; 0 where degenerate."""
    off = F.coalesce(F.try_divide((left - right) * 0.5, left - 2 * mid + right), F.lit(0.0))
    return F.least(F.greatest(off, F.lit(-1.0)), F.lit(1.0))


def histogram(df: DataFrame, value: str, by: Sequence[str], bins: int, low_q: float = 0.01, high_q: float = 0.99) -> DataFrame:
    """``by, bin, n, low, high`` with every bin between the percentiles, empty ones too."""
    p = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(low_q), F.lit(high_q))).alias("__p")).select(*by, F.col("__p")[0].alias("low"), F.col("__p")[1].alias("high")).filter("high > low")
    inside = df.join(p, list(by)).filter(F.col(value).between(F.col("low"), F.col("high")))
    counted = inside.groupBy(*by, F.least(F.floor((F.col(value) - F.col("low")) * bins / (F.col("high") - F.col("low"))), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return p.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counted, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def local_maxima(df: DataFrame, value: str, order: str, radius: int, by: Sequence[str]) -> DataFrame:
    """Rows that are the largest within the radius; of a plateau the first stays."""
    w = Window.partitionBy(*by).orderBy(order)
    top = df.withColumn("__top", F.max(value).over(w.rowsBetween(-radius, radius))).withColumn("__prior", F.max(value).over(w.rowsBetween(-radius, -1)))
    return top.filter((F.col(value) == F.col("__top")) & (F.col(value) > 0) & (F.coalesce("__prior", F.lit(-1.0)) < F.col(value))).drop("__top", "__prior")


def two_peaks(df: DataFrame, value: str, by: Sequence[str], bins: int = 64, smooth: int = 5, radius: int = 4, apart: int = 8) -> DataFrame:
    """``peak_low, peak_high``: the two strongest maxima at least ``apart`` bins from each other, refined."""
    from gridloom.operators.raster import moving_average

    h = moving_average(histogram(df, value, by, bins), "bin", "n", smooth, "s", by)
    w = Window.partitionBy(*by).orderBy("bin")
    refined = h.withColumn("off", parabola_offset(F.lag("s").over(w), F.col("s"), F.lead("s").over(w)))
    peaks = local_maxima(refined, "s", "bin", radius, by)
    at = F.col("low") + (F.col("bin") + 0.5 + F.col("off")) * (F.col("high") - F.col("low")) / bins
    ranked = peaks.withColumn("at", at)
    first = ranked.groupBy(*by).agg(F.min_by(F.struct("bin", "at"), F.struct(-F.col("s"), F.col("bin"))).alias("p1"))
    rest = ranked.join(first, list(by)).filter(F.abs(F.col("bin") - F.col("p1.bin")) >= apart)
    second = rest.groupBy(*by).agg(F.min_by("at", F.struct(-F.col("s"), F.col("bin"))).alias("p2"))
    return first.join(second, list(by), "left").select(*by, F.least(F.col("p1.at"), F.coalesce("p2", "p1.at")).alias("peak_low"), F.greatest(F.col("p1.at"), F.coalesce("p2", "p1.at")).alias("peak_high"))


def empirical_mode(df: DataFrame, value: str, by: Sequence[str], bins: int = 32) -> DataFrame:
    """Middle of the fullest bin over the whole range, refined by its neighbours."""
    h = histogram(df, value, by, bins, 0.0, 1.0)
    w = Window.partitionBy(*by).orderBy("bin")
    off = parabola_offset(F.coalesce(F.lag("n").over(w), F.lit(0)).cast("double"), F.col("n").cast("double"), F.coalesce(F.lead("n").over(w), F.lit(0)).cast("double"))
    at = F.col("low") + (F.col("bin") + 0.5 + F.col("off")) * (F.col("high") - F.col("low")) / bins
    return h.withColumn("off", off).withColumn("at", at).groupBy(*by).agg(F.min_by("at", F.struct(-F.col("n"), F.col("bin"))).alias("mode"))


def region_measures(pixels: DataFrame, rectangles: dict[str, tuple[int, int, int, int]], value: str = "v", by: Sequence[str] = ("z",)) -> DataFrame:
    """``<name>_n, _mean, _median, _std`` of named rectangles ``y0, y1, x0, x1`` per slice, in one pass."""
    aggs = []
    for name, (y0, y1, x0, x1) in rectangles.items():
        v = F.when((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1), F.col(value))
        aggs += [F.count(v).alias(f"{name}_n"), F.avg(v).alias(f"{name}_mean"), F.median(v).alias(f"{name}_median"), F.stddev_pop(v).alias(f"{name}_std")]
    return pixels.groupBy(*by).agg(*aggs)


def landmarks(df: DataFrame, value: str, by: Sequence[str], method: str, manual: tuple[float, float] | None = None, **options) -> DataFrame:
    """``by, low, high, method``; the manual pair where the method gives none or a degenerate one.

    Without a manual pair such a group raises when it is read.
    """
    if method == "gmm":
        got = gmm(df, value, by, **options).select(*by, F.col("mu_1").alias("low"), F.col("mu_2").alias("high"))
    elif method == "histogram":
        got = two_peaks(df, value, by, **options).select(*by, F.col("peak_low").alias("low"), F.col("peak_high").alias("high"))
    elif method == "regions":
        names = list(options["rectangles"])
        got = region_measures(df, options["rectangles"], value, by).select(*by, F.col(f"{names[0]}_median").alias("low"), F.col(f"{names[1]}_median").alias("high"))
    elif method == "manual" and manual:
        return df.select(*by).distinct().select(*by, F.lit(float(manual[0])).alias("low"), F.lit(float(manual[1])).alias("high"), F.lit("manual").alias("method"))
    else:
        raise ValueError("methods are gmm, histogram, regions and manual with a pair")
    ok = F.col("low").isNotNull() & F.col("high").isNotNull() & (F.col("low") < F.col("high"))
    other = (lambda k: F.lit(float(manual[k]))) if manual else (lambda k: F.raise_error(F.lit("degenerate landmarks and no manual pair")).cast("double"))
    return got.select(*by, F.when(ok, F.col("low")).otherwise(other(0)).alias("low"), F.when(ok, F.col("high")).otherwise(other(1)).alias("high"), F.when(ok, F.lit(method)).otherwise(F.lit("manual")).alias("method"))


def normalize(df: DataFrame, marks: DataFrame, value: str, by: Sequence[str], out: str = "normalized", clamp: bool = False) -> DataFrame:
    from gridloom.operators.planes import two_point

    return df.join(marks.select(*by, "low", "high"), list(by), "left").withColumn(out, two_point(F.col(value).cast("double"), F.col("low"), F.col("high"), clamp)).drop("low", "high")
