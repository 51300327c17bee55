"""Every registered query of the engine against its SQL."""

import glob
import math
import os

import duckdb
import pytest

from rowtide.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return float(f"{v:.12g}") if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, SF)
    found = duck.execute(sql)
    order = sorted(d[0] for d in found.description)
    assert sorted(df.columns) == order
    at = {d[0]: i for i, d in enumerate(found.description)}
    want = sorted((tuple(plain(r[at[c]]) for c in order) for r in found.fetchall()), key=str)
    # by position: names may hold dots and brackets
    mine = {c: i for i, c in enumerate(df.columns)}
    have = sorted((tuple(plain(r[mine[c]]) for c in order) for r in df.collect()), key=str)
    assert have == want
