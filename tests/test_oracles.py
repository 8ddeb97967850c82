"""Every registered query with SQL against DuckDB, on tables whose raster is complete."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from gridloom.queries import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return str([plain(x) for x in v])
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and math.isnan(v)):
            return None
        return round(float(v), 6) + 0.0 if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(repr(plain(v)) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, sf_dir, duck, name):
    got, want = queries()[name](spark, sf_dir).toPandas(), duck.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
