"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from barloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        if kind.startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif kind == "object":
            df[c] = df[c].map(lambda x: None if x is None or x != x else str(x))
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    got, want = plain(got), plain(want)
    for c in got.columns:
        if got[c].dtype == object or want[c].dtype == object:
            assert got[c].where(got[c].notna(), None).tolist() == want[c].where(want[c].notna(), None).tolist(), c
        else:
            np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=2e-6, err_msg=c)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
