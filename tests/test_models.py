"""Fits and scores in one session with iterations, rows without finite values, samples and ring shapes."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import components, graph, learn, predicate


def labelled(spark, n=200):
    r = random.Random(1)
    rows = [(k, r.gauss(k % 2, 0.4), r.random(), k % 2) for k in range(n)]
    rows += [(n, None, 0.5, 1), (n + 1, math.nan, 0.5, 0), (n + 2, math.inf, None, 1)]
    return spark.createDataFrame(rows, "key long, a double, b double, y int")


def test_scores_after_an_iteration_keep_every_row(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    assert components.connected_components(edges).count() == 3
    df = labelled(spark)
    for kind in ("logistic", "mlp"):
        rows = learn.predict(learn.fit_classifier(df, ["a", "b"], "y", kind=kind), df, ["key", "y"]).collect()
        assert len(rows) == 203 and all(abs(sum(r.p) - 1) < 1e-9 for r in rows)
        assert sum(r.predicted == r.y for r in rows) > 160


def test_linear_scores_are_those_of_the_fitted_coefficients(spark):
    df = labelled(spark)
    m = learn.fit_classifier(df, ["a", "b"], "y")
    clean = lambda v: 0.0 if v is None or not math.isfinite(v) else v
    for r, x in zip(learn.predict(m, df, ["key"]).orderBy("key").collect(), df.orderBy("key").collect()):
        z = m.bias[0] + sum(w * (clean(v) - mu) * s for w, v, mu, s in zip(m.weights[0], (x.a, x.b), m.mean, m.scale))
        assert abs(r.p[1] - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == (r.p[1] > r.p[0])


def test_three_classes_one_class_and_no_rows(spark):
    df = labelled(spark).withColumn("y", (F.col("key") % 3).cast("int"))
    rows = learn.predict(learn.fit_classifier(df, ["a"], "y"), df, ["key"]).collect()
    assert {len(r.p) for r in rows} == {3} and all(abs(sum(r.p) - 1) < 1e-9 for r in rows)
    one = learn.predict(learn.fit_classifier(df.filter("y = 1"), ["a"], "y"), df, ["key"]).collect()
    assert {r.predicted for r in one} == {1} and len(one) == 203
    none = df.limit(0)
    assert learn.predict(learn.fit_classifier(none, ["a"], "y"), df, ["key"]).count() == 203


def test_importance_is_that_of_the_column_that_matters(spark):
    df = labelled(spark)
    got = {r.column: r.importance for r in learn.permutation_importance(df, learn.fit_classifier(df, ["a", "b"], "y"), "y", "key", repeats=2).collect()}
    assert got["a"] > 0.2 > abs(got["b"])


def test_subsamples_are_exact(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert predicate.subsample(df, "k", 7).count() == 142
    assert predicate.subsample(df, "k", 500).count() == 10 and predicate.subsample(df.limit(4), "k", 3).count() == 4
    assert predicate.subsample(df, "k", 1).count() == 1000
    assert sorted(predicate.subsample(df, "k", 50, 1).collect()) == sorted(predicate.subsample(df.repartition(3), "k", 50, 1).collect())


def test_ring_shapes_match_a_spanning_tree(spark):
    r = random.Random(3)
    points = {k: [r.random(), r.random()] for k in range(40)}
    arcs = {tuple(sorted(r.sample(range(38), 2))) for _ in range(150)} | {(0, k) for k in range(1, 34)}
    rows = spark.createDataFrame([(0, k, v) for k, v in points.items()], "z int, label int, latent array<double>")
    df = spark.createDataFrame([(0, a, b) for a, b in sorted(arcs)], "z int, a int, b int")
    d = lambda a, b: math.dist(points[a], points[b])
    both = [d(a, b) for a, b in arcs] * 2
    limit = np.mean(both) + np.std(both)
    for x in graph.neighbour_shapes(rows, df, most=24).collect():
        near = sorted({b for a, b in arcs if a == x.label} | {a for a, b in arcs if b == x.label}, key=lambda n: (d(x.label, n), n))[:24]
        tree, left, merges = {x.label}, set(near), []
        while left:
            step, k = min((d(a, b), b) for a in tree for b in left)
            merges.append(step)
            tree.add(k)
            left.discard(k)
        merges.sort(reverse=True)
        want = (merges[0], merges[0] / merges[1] if len(merges) > 1 else 1.0, d(x.label, near[0]), 1 + sum(m > limit for m in merges)) if merges else (0.0, 1.0, 0.0, 1)
        assert np.allclose((x.h0_largest, x.h0_ratio, x.h0_attach, x.h0_components), want)


def test_metrics_of_sure_scores_match_their_sql(spark, tmp_path):
    """In slice 0 all scores are 1, in slice 1 none, in slice 2 some."""
    import duckdb

    from gridloom.queries import oracle_sql, queries

    value = lambda z, y, x: [500.0, 20.0 + y * 11, 100.0 + (y // 4) * 60 + x][z]
    cells = [(y, x, z + 1, value(z, y, x), 0.1, 0.02) for z in range(3) for y in range(32) for x in range(32)]
    spark.createDataFrame(cells, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.sql(oracle_sql()["mod05_metrics"]).fetchall())
    got = sorted(map(tuple, queries()["mod05_metrics"](spark, str(tmp_path)).collect()))
    assert [math.isnan(r[5]) for r in want] == [True, False, True]
    assert repr(got) == repr(want)


def test_ring_of_latents_matches_a_plain_evaluation(spark):
    """Two items, a hub, vectors of other lengths and arcs without a row at one end."""
    r = np.random.default_rng(4)
    rows = [(z, k, r.normal(size=5).tolist()) for z in (0, 1) for k in range(40)] + [(1, 40, [1.0, 2.0]), (1, 41, None)]
    arcs = [(z, k, (k * 7 + 3) % 40) for z in (0, 1) for k in range(40)] + [(0, 0, k) for k in range(1, 30)] + [(1, 3, 40), (1, 4, 41), (1, 5, 77)]
    at, near, found = {(z, k): v for z, k, v in rows}, {}, {}
    for z, a, b in arcs:
        u, v = at.get((z, a)), at.get((z, b))
        if u and v and len(u) == len(v):
            d = float(np.linalg.norm(np.subtract(u, v)))
            found.setdefault(z, []).append(d)
            near.setdefault((z, a), []).append((d, v))
            near.setdefault((z, b), []).append((d, u))
    df = spark.createDataFrame(rows, "z int, label long, latent array<double>")
    got = {(x.z, x.label): x for x in graph.latent_ring(df, spark.createDataFrame(arcs, "z int, a long, b long")).collect()}
    for k, ends in near.items():
        w = np.exp([-d / np.median(found[k[0]]) for d, _ in ends])
        assert np.allclose([x for x in got[k].ring_latent if x is not None], w @ np.array([v for _, v in ends]) / w.sum()) and abs(got[k].ring_distance - np.mean([d for d, _ in ends])) < 1e-12
    assert set(got) - set(near) == {(1, 40), (1, 41)} and got[1, 40].ring_latent == got[1, 41].ring_latent == [None] * 5


def test_median_within_is_the_percentile(spark):
    from gridloom.plans.ranking import median_within

    r = random.Random(2)
    rows = [("one", r.random()) for _ in range(501)] + [("even", r.random()) for _ in range(400)] + [("ties", float(r.randrange(3))) for _ in range(300)] + [("single", 4.5), ("nulls", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = df.filter("v IS NOT NULL").groupBy("g").agg(F.median("v").alias("median"))
    assert {tuple(x) for x in median_within(df, ["g"], "v").collect()} == {tuple(x) for x in want.collect()}


def test_ring_of_latents_leaves_an_items_arcs_where_they_are(spark):
    """One item holds all arcs: no task may get them all, neither for the median nor for the sums."""
    n = 3000
    df = spark.range(n).select(F.lit(0).alias("z"), F.col("id").alias("label"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.rand(3) + k).alias("latent"))
    arcs = spark.range(n).select(F.lit(0).alias("z"), F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b"))
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        got = graph.latent_ring(df, arcs)
        sizes = [x["count"] for x in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == n and max(sizes) < n / 2
