"""Every registered query of the library against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from geotab import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
Q, TWINS = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df):
    def plain(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not hasattr(v, "dtype"):
            return str(v)
        if pd.isna(v):
            return "null"
        if isinstance(v, bool) or str(getattr(v, "dtype", "")) == "bool":
            return str(bool(v))
        try:
            return f"{float(v) + 0.0:.5f}".replace("-0.00000", "0.00000")
        except (TypeError, ValueError):
            return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    got, want = Q[name](spark, DATA).toPandas(), duck.execute(TWINS[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    off = [(x, y) for x, y in zip(a, b) if x != y]
    close = [all(p == q or abs(float(p) - float(q)) < 2e-5 for p, q in zip(x, y)) for x, y in off if all(_number(v) for v in (*x, *y)) or x == y]
    assert len(off) == len(close) and all(close), off[:3]


def _number(v):
    try:
        float(v)
    except ValueError:
        return False
    return True
