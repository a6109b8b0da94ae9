"""Every registered query of the engine against its SQL on the small tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from edgeproof.plans import registry


def rows(df):
    df = df[sorted(df.columns)]
    text = lambda v: "N" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else f"{v + 0.0:.8g}" if isinstance(v, (float, np.floating)) else str(v)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    assert not got.columns.duplicated().any()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
