"""Training sets, folds, models, metrics and proposals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.durable import durable
from gridloom.plans.ranking import global_rank


def labeled_set(table: DataFrame, label: str = "class") -> DataFrame:
    """Rows with a class above 0; raises with fewer than two classes."""
    rows = table.filter(F.col(label) > 0)
    if rows.select(label).distinct().limit(2).count() < 2:
        raise ValueError("training needs at least two classes")
    return rows


def edge_set(ends: DataFrame, a: str = "class_a", b: str = "class_b") -> DataFrame:
    """Pairs with both ends labelled and ``differs`` 0 or 1."""
    return ends.filter((F.col(a) > 0) & (F.col(b) > 0)).withColumn("differs", (F.col(a) != F.col(b)).cast("int"))


def assign_folds(rows: DataFrame, key: str, label: str, k: int = 5, group: str | None = None, seed: int = 0) -> DataFrame:
    """Adds ``fold``: whole groups where there are at least three, else stratified by label; repeatable."""
    if group is not None and rows.select(group).distinct().limit(3).count() >= 3:
        return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), group), F.lit(k)).cast("int"))
    rarest = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    k = max(2, min(k, rarest))
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), key), key)
    return rows.withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("int"))


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: rows over classes times the class's rows."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    every = counts.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    return rows.join(counts.crossJoin(F.broadcast(every)), label).withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")


def metrics(scored: DataFrame, label: str = "y", p: str = "p", by: Sequence[str] = (), cut: float = 0.5, eps: float = 1e-15) -> DataFrame:
    """Confusion cells, accuracy, balanced accuracy, precision, recall, F1, log-loss and AUC by rank sums.

    Scores are held ``eps`` away from 0 and 1 for the log-loss.  With an ``eps``
    of 0 they are not, and logarithms of 0 are minus infinity: then a row scored
    as sure makes the log-loss NaN, or infinite if the score is wrong.
    """
    y, q = F.col(label), F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    ln = lambda v: F.when(v == 0, F.lit(float("-inf"))).otherwise(F.log(v))
    hit = F.col(p) >= cut
    # Mean ranks: ties share the average of their places.
    ties = scored.groupBy(*by, p).agg(F.count("*").alias("k"), F.sum(label).alias("pos"))
    w = Window.partitionBy(*by).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    ranks = ties.withColumn("rank", F.coalesce(F.sum("k").over(w), F.lit(0)) + (F.col("k") + 1) / 2)
    auc = ranks.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("__r"), F.sum("pos").alias("__p"), F.sum("k").alias("__k"))
    auc = auc.select(*by, F.try_divide(F.col("__r") - F.col("__p") * (F.col("__p") + 1) / 2, F.col("__p") * (F.col("__k") - F.col("__p"))).alias("auc"))
    cells = scored.groupBy(*by).agg(
        F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"), F.count_if(~hit & (y == 1)).alias("fn"), F.count_if(~hit & (y == 0)).alias("tn"),
        F.avg(-(y * ln(q) + (1 - y) * ln(1 - q))).alias("log_loss"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = cells.select(
        *by, "tp", "fp", "fn", "tn", "log_loss", div(tp + tn, tp + fp + fn + tn).alias("accuracy"), ((div(tp, tp + fn) + div(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
    return out.join(auc, list(by)) if by else out.crossJoin(F.broadcast(auc))


def finite(columns: Sequence[str]) -> Column:
    """The columns as one array; nulls, NaN and infinities become 0, so that no row is lost."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    values = [F.col(c).cast("double") for c in columns]
    return F.array(*[F.when(bad(v), F.lit(0.0)).otherwise(v) for v in values])


@dataclass(frozen=True)
class Fitted:
    """What a fit has learned: linear scores of standardised columns, or a dense network."""

    columns: tuple[str, ...]
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[tuple[float, ...], ...] = ()
    bias: tuple[float, ...] = ()
    constant: int | None = None
    network: object = None

    def probabilities(self) -> Column:
        """``p ARRAY<DOUBLE>`` of a linear model, as one expression over the columns."""
        if self.constant is not None:
            return F.array(*[F.lit(float(k == self.constant)) for k in range(max(2, self.constant + 1))])
        x = finite(self.columns)
        rows = []
        for w, b in zip(self.weights, self.bias):
            score = F.lit(float(b))
            for k, (c, m, s) in enumerate(zip(w, self.mean, self.scale)):
                score = score + F.lit(float(c)) * (F.get(x, F.lit(k)) - F.lit(float(m))) * F.lit(float(s))
            rows.append(score)
        if len(rows) == 1:
            p = 1 / (1 + F.exp(-rows[0]))
            return F.array(1 - p, p)
        # A softmax against the largest score, so that nothing overflows.
        top = F.greatest(*rows)
        powers = [F.exp(r - top) for r in rows]
        return F.transform(F.array(*powers), lambda e: e / sum(powers[1:], powers[0]))


def fit_classifier(rows: DataFrame, columns: Sequence[str], label: str, kind: str = "logistic", weight: str | None = None, layers: Sequence[int] = (16,), reg: float = 0.01, seed: int = 0) -> Fitted:
    """Standardise, then logistic regression or a dense network, fitted on the cluster.

    Values that aren't finite count as 0.  Of rows with one label only the model
    is that label; without rows it is label 0.
    """
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    if kind not in ("logistic", "mlp"):
        raise ValueError("kinds are logistic and mlp")
    low, high = rows.agg(F.min(label), F.max(label)).first()
    if low == high:
        return Fitted(tuple(columns), constant=int(high or 0))
    raw = rows.filter(F.col(label).isNotNull()).withColumn("__raw", array_to_vector(finite(columns)))
    scaler = StandardScaler(inputCol="__raw", outputCol="__features", withMean=True).fit(raw)
    mean, scale = tuple(scaler.mean), tuple(1 / s if s else 0.0 for s in scaler.std)
    ready = scaler.transform(raw)
    if kind == "mlp":
        network = MultilayerPerceptronClassifier(labelCol=label, featuresCol="__features", layers=[len(columns), *layers, int(high) + 1], seed=seed, maxIter=100).fit(ready)
        return Fitted(tuple(columns), mean, scale, network=network)
    model = LogisticRegression(labelCol=label, featuresCol="__features", regParam=reg, maxIter=50)
    model = (model.setWeightCol(weight) if weight else model).fit(ready)
    return Fitted(tuple(columns), mean, scale, tuple(map(tuple, model.coefficientMatrix.toArray())), tuple(model.interceptVector))


def predict(model: Fitted, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``p ARRAY<DOUBLE>`` and ``predicted``, a row a row of ``rows``."""
    if model.network is not None:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        x = finite(model.columns)
        standard = F.array(*[(F.get(x, F.lit(k)) - F.lit(float(m))) * F.lit(float(s)) for k, (m, s) in enumerate(zip(model.mean, model.scale))])
        scored = model.network.transform(rows.withColumn("__features", array_to_vector(standard)))
        return scored.select(*keep, vector_to_array("probability").alias("p"), F.col("prediction").cast("int").alias("predicted"))
    scored = rows.withColumn("__p", model.probabilities())
    return scored.select(*keep, F.col("__p").alias("p"), (F.array_position("__p", F.array_max("__p")) - 1).cast("int").alias("predicted"))


def permutation_importance(rows: DataFrame, model: Fitted, label: str, key: str, repeats: int = 3) -> DataFrame:
    """``column, importance``: how much the accuracy falls, on average, when a column is shuffled."""
    hit = lambda df: df.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"))
    base = hit(predict(model, rows, [label])).select(F.col("accuracy").alias("base"))
    out = None
    for column in model.columns:
        for seed in range(repeats):
            one = hit(predict(model, permuted(rows, column, key, seed), [label])).withColumn("column", F.lit(column))
            out = one if out is None else out.union(one)
    return out.crossJoin(F.broadcast(base)).groupBy("column").agg(F.avg(F.col("base") - F.col("accuracy")).alias("importance"))


def cross_validate(rows: DataFrame, columns: Sequence[str], label: str, key: str, k: int = 3, **options) -> DataFrame:
    """Metrics per fold of a binary label; the folds are bounded by ``k``."""
    folded = durable(assign_folds(rows, key, label, k), "folds")
    parts = []
    for f in sorted(r[0] for r in folded.select("fold").distinct().collect()):
        model = fit_classifier(folded.filter(F.col("fold") != f), columns, label, **options)
        parts.append(predict(model, folded.filter(F.col("fold") == f), ["fold", label]).select("fold", F.col(label).alias("y"), F.get("p", F.lit(1)).alias("p")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return metrics(out, by=["fold"])


def permuted(rows: DataFrame, column: str, key: str, seed: int = 0) -> DataFrame:
    """``rows`` with one column shuffled by a seeded hash; the places are joined, not collected."""
    placed = global_rank(rows, key, out="__i")
    moved = global_rank(rows.select(F.col(column).alias("__v"), F.xxhash64(F.lit(seed), key).alias("__h"), F.col(key).alias("__k")), "__h", "__k", out="__i")
    return placed.join(moved.select("__i", "__v"), "__i").withColumn(column, F.col("__v")).drop("__i", "__v")


def stratified_fraction(rows: DataFrame, label: str, key: str, share: float, seed: int = 0) -> DataFrame:
    """About a share of each class, by a seeded hash."""
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), label, key), F.lit(10_000)) < share * 10_000)


def principal_components(rows: DataFrame, vector: str, k: int, whiten: bool = False) -> DataFrame:
    """Adds ``components ARRAY<DOUBLE>``: projections of an array column, signs fixed by the largest loading.

    The covariance is aggregated; only its matrix, of the vector's length
    squared, reaches the driver.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    vectors = rows.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    fitted = PCA(k=k, inputCol="__v", outputCol="__p").fit(vectors)
    loadings = fitted.pc.toArray()
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    mean = np.array(rows.agg(*[F.avg(F.get(F.col(vector), F.lit(i))) for i in range(loadings.shape[0])]).first(), float)
    dot = lambda w, m: F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(-float(m @ w)), lambda acc, v: acc + v)
    parts = F.array(*[dot(loadings[:, j], mean) for j in range(k)])
    if not whiten:
        return rows.withColumn("components", parts)
    projected = rows.withColumn("components", parts)
    sd = projected.agg(*[F.stddev_pop(F.get("components", F.lit(j))) for j in range(k)]).first()
    return projected.withColumn("components", F.array(*[F.get("components", F.lit(j)) / (sd[j] if sd[j] else 1.0) for j in range(k)]))


def propose(candidates: DataFrame, p: Column, boundary: Column, weights: dict[str, float], distance: float, most: int, half: int, width: int, height: int, item: str = "z") -> DataFrame:
    """Regions of interest: blended uncertainty, ranked, spaced, boxed and clamped."""
    from gridloom.functions.scalars import blend, confidence, entropy, margin
    from gridloom.operators.ordering import score_ranked, spaced

    score = blend({"entropy": entropy(p), "margin": margin(p), "confidence": confidence(p), "boundary": boundary}, weights)
    ranked = score_ranked(candidates.withColumn("score", F.round(score, 9)), "score", "label", 0, [item])
    picked = spaced(ranked, distance, most, item).join(ranked, [item, "label"])
    lo, hi = (lambda c: F.greatest(F.col(c) - half, F.lit(0))), (lambda c, m: F.least(F.col(c) + half, F.lit(m)))
    return picked.select(item, "label", "pick", "score", lo("ext_y").alias("y0"), hi("ext_y", height).alias("y1"), lo("ext_x").alias("x0"), hi("ext_x", width).alias("x1"))
