import heapq
import random

import numpy as np
import pytest
from conftest import MULTI, TOY
from pyspark.sql import functions as F

from tidegraph import sinks
from tidegraph.functions import columns
from tidegraph.functions.ranking import compare, overlap_report, picked_differences, rank_biased_overlap
from tidegraph.operators import groups, pagerank, paths, snapshots, temporal, topology
from tidegraph.plans.program import VertexProgram, run
from tidegraph.sources import text
from tidegraph.streaming.live import LiveGraph, colour_step, components_step, event_stream, pagerank_step, program_step, sssp_step, temporal_step, triangles_step


def graph(spark, pairs, **more):
    e = text.events_of(spark, [("ADD", *p) for p in pairs])
    return e, topology.vertices(e)


def as_dict(df, value):
    return {r["id"]: r[value] for r in df.collect()}


def exact_pagerank(pairs, ids, d=0.85):
    """Dense solve with dangling rank going to the other vertices."""
    n, at = len(ids), {v: k for k, v in enumerate(ids)}
    m = np.zeros((n, n))
    for s, t in pairs:
        m[at[t], at[s]] += 1
    for k in range(n):
        out = m[:, k].sum()
        m[:, k] = m[:, k] / out if out else [0 if j == k else 1 / (n - 1) for j in range(n)]
    return dict(zip(ids, np.linalg.solve(np.eye(n) - d * m, np.full(n, (1 - d) / n)), strict=True))


def test_sssp_toy(spark):
    e, v = graph(spark, TOY)
    got = as_dict(paths.shortest_paths(e, v, {1: 1.0}), "distance")
    assert [got[k] for k in range(7)] == [4, 1, 3, 3, 2, 3, None]
    assert paths.shorter_edges(paths.shortest_paths(e, v, {1: 1.0}), e).count() == 0


def test_sssp_random_and_sources(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(20), rnd.randrange(20), rnd.randint(1, 9)) for _ in range(60)]
    e, v = graph(spark, pairs)
    dist = {}
    heap = [(0.0, 0), (2.5, 7)]
    while heap:
        x, u = heapq.heappop(heap)
        if u in dist:
            continue
        dist[u] = x
        for s, t, w in pairs:
            if s == u and t not in dist:
                heapq.heappush(heap, (x + w, t))
    ids = [r["id"] for r in v.collect()]
    got = as_dict(paths.shortest_paths(e, v, {0: 0.0, 7: 2.5}), "distance")
    assert got == {k: dist.get(k) for k in ids}


def test_components_toy_and_programs(spark):
    e, v = graph(spark, MULTI)
    want = dict(enumerate([0, 1, 1, 0, 1, 1, 1, 0, 0, 0]))
    r = groups.connected_components(e, v)
    assert as_dict(r, "component") == want
    assert as_dict(run(groups.least_label_program(), e, v), "label") == want
    assert groups.split_edges(r, e).count() == 0
    chain, cv = graph(spark, [(k, k + 1) for k in range(70)])
    assert set(as_dict(groups.connected_components(chain, cv), "component").values()) == {0}


def test_pagerank(spark):
    e, v = graph(spark, TOY)
    want = {0: 0.211176, 1: 0.140311, 2: 0.174715, 3: 0.118566, 4: 0.185322, 5: 0.103853, 6: 0.066058}
    got = as_dict(pagerank.pagerank(e, v, 80, tolerance=1e-10), "score")
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
    m, mv = graph(spark, [p[::-1] for p in MULTI] + MULTI + [(5, 5), (5, 5)])
    got = as_dict(pagerank.pagerank_from(m, mv, epsilon=1e-10), "score")
    exact = exact_pagerank([p[::-1] for p in MULTI] + MULTI + [(5, 5), (5, 5)], list(range(10)))
    assert all(abs(got[k] - exact[k]) < 1e-7 for k in exact)
    own = as_dict(pagerank.pagerank(e, v, 60, sources=[4]), "score")
    assert abs(sum(own.values()) - 1) < 1e-9 and max(own, key=own.get) == 4


def test_triangles_and_leaders(spark):
    e, _ = graph(spark, MULTI + [(4, 4), (1, 2)])
    assert sorted(tuple(r) for r in groups.triangles(e).collect()) == [(0, 3, 7, 7), (1, 2, 4, 4)]
    rnd = random.Random(5)
    pairs = [(rnd.randrange(9), rnd.randrange(9)) for _ in range(60)]
    first = {}
    for k, (s, t) in enumerate(pairs):
        if s != t:
            first.setdefault(frozenset((s, t)), (k, s))
    want = {}
    for a in range(9):
        for b in range(a):
            for c in range(b):
                three = [first.get(frozenset(x)) for x in ((a, b), (a, c), (b, c))]
                if all(three):
                    lead = max(three)[1]
                    want[lead] = want.get(lead, 0) + 1
    assert as_dict(groups.triangle_leaders(graph(spark, pairs)[0]), "triangles") == want


def test_colouring(spark):
    e, v = graph(spark, MULTI)
    assert as_dict(groups.colour(e, v), "colour") == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 0, 6: 0, 7: 2, 8: 0, 9: 1}
    for priority in ("hash", "create_event"):
        assert groups.colour_violations(groups.colour(e, v, priority), e, v).count() == 0
    bad = groups.colour(e, v).withColumn("colour", F.lit(0))
    assert groups.colour_violations(bad, e, v).count() > 0


TEMPORAL = [(1, 2, 1, 5), (1, 2, 5, 9), (2, 3, 3, None), (2, 4, 5, None), (2, 5, 7, 8), (3, 2, 2, None)]


def test_temporal_windows(spark):
    e = spark.createDataFrame([(k, *r) for k, r in enumerate(TEMPORAL)], "event_idx long, src long, dst long, ts long, end_ts long")
    w = temporal.reachable_windows(e, 1)
    assert sorted((r["id"], r["start"], r["end"]) for r in w.collect()) == [(1, 0, None), (2, 1, 5), (2, 5, 9), (3, 3, None), (5, 7, 8)]
    assert temporal.window_violations(w, e, 1).count() == 0
    c = temporal.capped_windows(e, 1)
    assert (3, 3, 5) in {(r["id"], r["start"], r["end"]) for r in c.collect()}
    assert temporal.window_violations(c, e, 1, extend=False).count() == 0


@pytest.mark.parametrize(("seed", "local"), [(1, 0), (2, 0), (1, 50_000), (2, 50_000), (3, 10)])
def test_temporal_random(spark, monkeypatch, seed, local):
    monkeypatch.setattr(temporal, "LOCAL_EDGES", local)
    rnd = random.Random(seed)
    rows = []
    for k in range(40):
        ts = rnd.randint(1, 30)
        rows.append((k, rnd.randrange(6), rnd.randrange(6), ts, rnd.choice([None, ts + rnd.randint(1, 10)])))
    big = 10**9
    reach = {k for k, s, _, ts, _ in rows if s == 0 and ts > 0}
    while True:
        more = {k for k, s, _, ts, _ in rows for f in reach if rows[f][2] == s and rows[f][2] != 0 and rows[f][3] < ts < (rows[f][4] or big)} - reach
        if not more:
            break
        reach |= more
    want = [(0, 0, None)]
    for v in range(1, 6):
        spans = []
        for a, b in sorted((rows[k][3], rows[k][4] or big) for k in reach if rows[k][2] == v):
            if spans and a < spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        want += [(v, a, None if b == big else b) for a, b in spans]
    e = spark.createDataFrame(rows, "event_idx long, src long, dst long, ts long, end_ts long")
    got = sorted((r["id"], r["start"], r["end"]) for r in temporal.reachable_windows(e, 0).collect())
    assert got == sorted(want)


def test_order_of_events_does_not_matter(spark):
    rnd = random.Random(6)
    shuffled = TOY[:]
    rnd.shuffle(shuffled)
    (a, va), (b, vb) = graph(spark, TOY), graph(spark, shuffled)
    assert as_dict(paths.shortest_paths(a, va, {1: 0.0}), "distance") == as_dict(paths.shortest_paths(b, vb, {1: 0.0}), "distance")
    assert compare(pagerank.pagerank(a, va, 20), pagerank.pagerank(b, vb, 20), "score").first()["max_l1"] < 1e-12


def test_live_equals_recomputed(spark, tmp_path):
    e, v = graph(spark, MULTI)
    bounds = snapshots.every_events(e, 4)
    live = LiveGraph(spark, {"sssp": sssp_step({8: 0.0}), "cc": components_step, "pr": pagerank_step(1e-6)}, path=f"file://{tmp_path}/live")
    live.replay(e, bounds)
    assert as_dict(live.state("sssp"), "distance") == as_dict(paths.shortest_paths(e, v, {8: 0.0}), "distance")
    assert as_dict(live.state("cc"), "component") == as_dict(groups.connected_components(e, v), "component")
    got, want = as_dict(live.state("pr"), "score"), exact_pagerank(MULTI, list(range(10)))
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)  # epsilon / (1 - damping)
    again = LiveGraph(spark, {}, path=f"file://{tmp_path}/live")
    assert again.batches.keys() == live.batches.keys()
    with pytest.raises(ValueError):
        live.process(text.events_of(spark, [("DEL", 9, 0)]), 99)


def test_live_with_deletions(spark):
    """Colours, triangles, windows and an own program after random batches equal those of the whole log."""
    rnd = random.Random(11)
    log, there = [], []
    for t in range(60):
        if there and t > 20 and rnd.random() < 0.4:
            log.append(("DEL", *there.pop(rnd.randrange(len(there))), 1.0, t))
        else:
            pair = (rnd.randrange(9), rnd.randrange(9))
            there.append(pair)
            log.append(("ADD", *pair, 1.0, t))
    e = text.events_of(spark, log)
    live = LiveGraph(spark, {"colour": colour_step, "windows": temporal_step(0)})
    live.replay(e, [(19, 0), (39, 0)])
    edges, v = topology.live_edges(e), topology.vertices(e)
    assert as_dict(live.state("colour"), "colour") == as_dict(groups.colour(edges, v), "colour")
    want = sorted(tuple(r)[:2] for r in temporal.reachable_windows(topology.range_edges(e), 0).collect())
    assert sorted(tuple(r)[:2] for r in live.state("windows").collect()) == want
    bounds = [(k, k) for k in (19, 39, 59)]
    rows = {(r["snapshot_id"], r["event_idx"]) for r in snapshots.unfolded_edges(e, bounds).collect()}
    assert rows == {(k, r["event_idx"]) for k, (at, _) in enumerate(bounds) for r in topology.live_edges(e, at).collect()}
    degrees = {(r["snapshot_id"], r["id"]): r["out_degree"] for r in snapshots.degree_series(e, bounds).collect()}
    for k, (at, _) in enumerate(bounds):
        got = {v: n for (s, v), n in degrees.items() if s == k}
        assert got == as_dict(topology.live_edges(e, at).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")), "n")


def test_live_growing(spark):
    rnd = random.Random(12)
    pairs = [(rnd.randrange(12), rnd.randrange(12)) for _ in range(60)]
    e, v = graph(spark, pairs)
    live = LiveGraph(spark, {"triangles": triangles_step, "labels": program_step(groups.least_label_program())})
    live.replay(e, [(9, 0), (30, 0)])
    assert as_dict(live.state("triangles"), "triangles") == as_dict(groups.triangle_leaders(e), "triangles")
    assert as_dict(live.state("labels"), "label") == as_dict(groups.connected_components(e, v), "component")
    for k, name in enumerate(("triangles", "labels")):
        one = LiveGraph(spark, {name: live.steps[name]})
        one.replay(e, [(9, 0), (30, 0)])
        with pytest.raises(ValueError):
            one.process(text.events_of(spark, [("DEL", *next(p for p in pairs if p[0] != p[1]))]), 99 + k)


def test_structured_streaming(spark, tmp_path):
    e, v = graph(spark, MULTI)
    source = tmp_path / "in"
    for lo in (0, 6):
        e.where(f"event_idx >= {lo} and event_idx < {lo + 6}").coalesce(1).write.mode("append").parquet(str(source))
    live = LiveGraph(spark, {"cc": components_step}, path=f"file://{tmp_path}/live")
    q = live.follow(event_stream(spark, str(source)), availableNow=True)
    q.awaitTermination(120)
    assert as_dict(live.state("cc"), "component") == as_dict(groups.connected_components(e, v), "component")


def test_snapshots(spark):
    e = text.events_of(spark, [("ADD", k % 3, (k + 1) % 5, 1.0, t) for k, t in enumerate([1, 2, 10, 11, 19, 20, 45])])
    assert snapshots.ratchet(e, 9) == [(2, 10), (4, 19), (6, 45)]
    assert [b[0] for b in snapshots.every_events(e, 3)] == [2, 5]
    c = snapshots.counts(e, snapshots.ratchet(e, 9)).orderBy("snapshot_id").collect()
    assert [r["edge_count"] for r in c] == [3, 5, 7]
    bounds = snapshots.ratchet(e, 9)
    series = snapshots.pagerank_series(e, bounds, 40)
    last = {r["id"]: r["score"] for r in series.where("snapshot_id = 2").collect()}
    want = exact_pagerank([(k % 3, (k + 1) % 5) for k in range(7)], sorted(last))
    assert all(abs(last[k] - want[k]) < 1e-3 for k in want)
    assert snapshots.top_series(series, 2).count() == 6


def test_tables_and_files(spark, tmp_path):
    e = text.events_of(spark, [("ADD", 1, 2, 1.0, 86_400), ("ADD", 2, 3, 1.0, 2 * 86_400), ("DEL", 1, 2, 1.0, 3 * 86_400), ("ADD", 3, 1, 1.0, 4 * 86_400)])
    bounds = snapshots.every_events(e, 2)
    rows = sinks.reach_table(snapshots.reach_series(e, bounds, 1)).collect()
    assert [(r["date"], r["te"], r["de"], r["MaxReach"]) for r in rows] == [("1970-01-03", 2, 0, 3), ("1970-01-05", 3, 1, 3)]
    series = snapshots.pagerank_series(e, bounds, 5)
    wide = sinks.pagerank_table(snapshots.counts(e, bounds), series, [1, 2, 3])
    sinks.write_table(wide, str(tmp_path / "series"))
    back = spark.read.csv(str(tmp_path / "series"), header=True).collect()
    assert [r["e"] for r in back] == ["2", "2"] and {"ts", "date", "v", "1", "2", "3"} <= set(back[0].asDict())
    sinks.write_properties(series.where("snapshot_id = 1").select("id", "score"), str(tmp_path / "props"))
    assert spark.read.text(str(tmp_path / "props")).count() == 3
    stable = snapshots.stability(snapshots.solve_each(e, bounds, groups.colour), "colour")
    assert sinks.colour_table(snapshots.counts(e, bounds), stable).count() == 2
    v = topology.vertices(e)
    report = overlap_report(pagerank.pagerank(e, v, 3), pagerank.pagerank(e, v, 30))
    assert sinks.comparison_table([report, report]).columns == ["AvgL1", "P95L1", "1000.RBO6", "10.RBO5"]


def test_own_program(spark):
    """Largest id that can reach a vertex, with a second wave on convergence."""
    program = VertexProgram(
        init=lambda v: v.select("id", F.col("id").alias("top")),
        message=lambda: F.col("top"),
        combine=F.max,
        update=lambda: {"top": F.greatest("top", "msg")},
        changed=lambda: F.col("top") > F.col("old_top"),
    )
    e, v = graph(spark, TOY)
    assert as_dict(run(program, e, v), "top") == {0: 6, 1: 6, 2: 6, 3: 6, 4: 6, 5: 6, 6: 6}


@pytest.mark.parametrize(("a", "b", "p", "want"), [("abcdefgh", "hgfedcba", 0.95, 0.771924), ("gafcz", "abcd", 0.8, 0.3786667), ("abcdefgh", "badfch", 0.8, 0.6869504), ("abcde", "bagheklc", 0.9, 0.6338971)])
def test_rank_biased_overlap(a, b, p, want):
    assert abs(rank_biased_overlap(list(a), list(b), p) - want) < 1e-6


@pytest.mark.parametrize(("numbers", "want"), [([], 0), ([0], 1), ([1], 0), ([0, 1], 2), ([0, 2], 1), ([1, 2, 3], 0), ([2, 4, 1, 0], 3), ([12, 0, 2, 2, 2, 3, 0, 1], 4), (list(range(129)), 129)])
def test_first_unused(spark, numbers, want):
    df = spark.createDataFrame([(numbers,)], "x array<int>")
    assert df.select(columns.first_unused(F.col("x"))).first()[0] == want


def test_percentiles(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.0, 2.0, 9.0],), ([7.0],), ([],)], "x array<double>")
    assert [r[0] for r in df.select(columns.percentile_at(F.col("x"), 50)).collect()] == [3.0, 1.5, 7.0, 0.0]
    a = spark.createDataFrame([(k, float(k)) for k in range(5)], "id long, score double")
    b = a.withColumn("score", F.lit(0.0))
    assert picked_differences(a, b, "score") == (1.5, 4.0)
