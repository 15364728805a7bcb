"""Every query of the engine against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from veinlode import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want
