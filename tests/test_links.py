"""Edges dealt by source for many rounds, with sources that hold most of them."""

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import pagerank, paths
from tidegraph.operators.links import components
from tidegraph.plans import links, storage


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_hub(spark, monkeypatch, small):
    monkeypatch.setattr(links, "SMALL", small)
    rows = [(1, k, 1.0) for k in range(2, 200)] + [(k, k + 200, 2.0) for k in range(2, 60)] + [(3, 1, 1.0)]
    e = spark.createDataFrame(rows, "src long, dst long, weight double")
    held = links.Links(e, ["src"])
    state = spark.createDataFrame([(1, 10.0), (3, 5.0)], "src long, x double")
    got = held.send(state, lambda d: d.select("src", "dst", (F.col("x") + F.col("weight")).alias("y")))
    want = sorted((s, t, {1: 10.0, 3: 5.0}[s] + w) for s, t, w in rows if s in (1, 3))
    assert sorted(map(tuple, got.collect())) == want
    assert (held.hot is not None) == (small == 0)
    held.close()
    v = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    near = {r["id"]: r["distance"] for r in paths.shortest_paths(e, v, {1: 0.0}).collect()}
    assert near == {1: 0.0} | {k: 1.0 for k in range(2, 200)} | {k + 200: 3.0 for k in range(2, 60)} | {k: 1.0 for k in range(2, 200)}
    score = pagerank.pagerank(e, v, rounds=3).agg(F.sum("score")).first()[0]
    assert abs(score - 1) < 1e-9


def test_round_tables_go(spark):
    a = storage.cut(spark.range(5), watch={"n": F.count(F.lit(1)), "top": F.max("id")})
    assert storage.watched(a) == {"n": 5, "top": 4}
    b = storage.cut(a.select((F.col("id") * 2).alias("id")), a)
    assert [r[0] for r in b.orderBy("id").collect()] == [0, 2, 4, 6, 8]
    with pytest.raises(Exception):  # noqa: B017  the files of the round before are gone
        a.collect()


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_hub_components(spark, monkeypatch, small):
    monkeypatch.setattr("tidegraph.operators.links.SMALL", small)
    rows = [(0, k) for k in range(1, 300)] + [(900, k) for k in range(500, 800)] + [(299, 500), (1000, 1001), (1001, 1002), (7, 7), (2000, 2000)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {k: 0 for k in [*range(300), *range(500, 800), 900]} | {1000: 1000, 1001: 1000, 1002: 1000, 2000: 2000}
