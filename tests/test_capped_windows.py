"""Capped windows against all walks, and on a log where windows and edges of a vertex are many."""

import random

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import temporal

SCHEMA = "event_idx long, src long, dst long, ts long, end_ts long"


@pytest.mark.parametrize("seed", range(4))
def test_all_walks(spark, seed):
    rnd, big, rows = random.Random(seed), temporal.FOREVER, []
    for k in range(60):
        ts = rnd.randint(0, 25)
        rows.append((k, rnd.randrange(7), rnd.randrange(7), ts, rnd.choice([None, *[ts + rnd.randint(-1, 12)] * 15])))
    seen, front, hops = {(0, 0, big): 0}, {(0, 0, big)}, 0
    while front:
        hops += 1
        new = {(v, ts, min(end, big if e is None else e)) for u, start, end in front for _, s, v, ts, e in rows if s == u and v != 0 and start < ts < end}
        front = new - seen.keys()
        seen |= dict.fromkeys(front, hops)
    covered = lambda w: any(x != w and x[0] == w[0] and x[1] <= w[1] and x[2] >= w[2] for x in seen)
    want = sorted((*w, h) for w, h in seen.items() if not covered(w))
    got = temporal.capped_windows(spark.createDataFrame(rows, SCHEMA), 0).collect()
    assert sorted((r["id"], r["start"], big if r["end"] is None else r["end"], r["hops"]) for r in got) == want and len(want) > 8
    assert temporal.capped_windows(spark.createDataFrame([], SCHEMA), 0).count() == 1


def test_many_windows_and_edges(spark, monkeypatch):
    """20,000 edges between three vertices, all open at once: windows are not paired with edges, and no rounds are written."""
    written = []
    monkeypatch.setattr(temporal, "cut", lambda df, *a, cut=temporal.cut, **k: written.append(1) or cut(df, *a, **k))
    e = spark.range(1, 20_001).select(F.col("id").alias("event_idx"), (F.col("id") % 3).alias("src"), ((F.col("id") + 1) % 3).alias("dst"), F.col("id").alias("ts"), (F.col("id") + 50_000).alias("end_ts"))
    got = temporal.capped_windows(e, 0)
    assert got.count() == 1 + 2 * 6666 and len(written) == 1
