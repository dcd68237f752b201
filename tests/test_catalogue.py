"""Every query with an oracle agrees with DuckDB at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
QUERIES = {k: v for k, v in __spark_entry__.catalogue.QUERIES.items() if k in __spark_entry__.catalogue.ORACLES}
SLOW = {"live_pagerank", "pagerank", "pagerank_personalised", "l1_compare", "pagerank_check", "sssp_histogram", "cc_check", "sssp_check", "temporal_check", "temporal_ordinals"}  # covered by others here


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return None if v is None or v != v else round(float(v), 9) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SLOW))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(__spark_entry__.catalogue.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    key = lambda r: [(x is not None, x) for x in r]
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=key)
    b = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in want.fetchall()), key=key)
    assert a == b
