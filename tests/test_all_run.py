"""Registered queries without SQL run in one session after an iteration, at a scale other than that of the oracles."""

from __future__ import annotations

import pytest

from gridloom.operators.components import connected_components
from gridloom.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def iterated(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    assert connected_components(edges).count() == 3
    return spark


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs_and_has_rows(iterated, name):
    got = queries()[name](iterated, SMALL)
    assert got.columns and got.count() > 0


@pytest.mark.parametrize("name", ["mod01_training_set", "mod03_balanced_weights", "mod03_logistic_model"])
def test_two_classes_at_every_scale(iterated, name):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        assert queries()[name](iterated, f"/root/testdata/{sf}").count() > 100
