"""Neighbours of an id that holds more vectors than are asked for."""

import numpy as np
import pytest

from tidegraph.llm import neighbours


@pytest.mark.parametrize("block", [8192, 16])
def test_many_vectors_of_one_id(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.normal(size=3)]) for k in range(1, 90)]
    rows += [(40, [float(x) for x in 5 + rng.normal(size=3)]) for _ in range(30)]
    rows += [(k, rows[-1][1]) for k in (60, 71, 72)] + [(20, rows[-9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.top_k(df, k=7).collect())
    ok = {(i, tuple(int(np.floor(np.float64(np.float32(x)) * 64)) for x in v)) for i, v in rows}
    want = []
    for i, q in ok:
        if i % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in ok if j != i)
            want += [(i, k + 1, j, -v) for k, (v, j) in enumerate(s[:7])]
    assert got == sorted(want)
