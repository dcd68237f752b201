import random
from collections import defaultdict, deque

import pytest
from conftest import TOY
from pyspark.sql import functions as F

from tidegraph.functions.order import in_order_within
from tidegraph.graph import Graph
from tidegraph.operators import topology as T
from tidegraph.schema import Options
from tidegraph.sources import tables, text


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def random_log(seed, n=120, ids=5):
    rnd, live, out = random.Random(seed), [], []
    for k in range(n):
        if live and rnd.random() < 0.35:
            s, d = live.pop(rnd.randrange(len(live)))
            out.append(("DEL", s, d, 1.0, k))
        else:
            s, d = rnd.randrange(ids), rnd.randrange(ids)
            live.append((s, d))
            out.append(("ADD", s, d, 1.0, k))
    return out


def queues(log):
    """First-in-first-out deletion by simulation: live event numbers, and the end of each edge."""
    live, end = defaultdict(deque), {}
    for k, (kind, s, d, _, ts) in enumerate(log):
        if kind == "ADD":
            live[s, d].append(k)
            end[k] = None
        else:
            end[live[s, d].popleft()] = ts
    return sorted(k for q in live.values() for k in q), end


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_deletes_remove_the_first_live_instance(spark, seed):
    log = random_log(seed)
    events = text.events_of(spark, log)
    live, end = queues(log)
    assert [r[0] for r in rows(T.live_edges(events), "event_idx")] == live
    assert {r["event_idx"]: r["end_ts"] for r in T.range_edges(events).collect()} == end
    c = T.edge_counts(events).first()
    assert c["live"] == len(live) and c["adds"] - c["deletes"] == len(live)


def test_delete_without_edge_fails(spark):
    with pytest.raises(Exception, match="deletion without an edge"):
        T.live_edges(text.events_of(spark, [("ADD", 1, 2), ("DEL", 1, 3)])).collect()
    with pytest.raises(Exception, match="deletion without an edge"):
        T.live_edges(text.events_of(spark, [("DEL", 1, 2), ("ADD", 1, 2)])).collect()


def test_window_and_order(spark):
    e = text.events_of(spark, [("ADD", 1, 2, 1.0, 10), ("ADD", 2, 3, 1.0, 15), ("ADD", 3, 4, 1.0, 20)])
    assert rows(T.window_edges(e, 10), "src") == [(2,), (3,)]
    assert rows(T.window_edges(e, 10, at_ts=15), "src") == [(1,), (2,)]
    late = text.events_of(spark, [("ADD", 1, 2, 1.0, 10), ("ADD", 2, 3, 1.0, 5)])
    with pytest.raises(Exception, match="out of time order"):
        T.window_edges(late, 10).collect()


def test_stats_and_positions(spark):
    e = text.events_of(spark, [("ADD", *p) for p in TOY])
    v = T.vertices(e)
    assert rows(T.degrees(e, v), "id", "out_degree") == [(0, 0), (1, 1), (2, 2), (3, 1), (4, 3), (5, 0), (6, 1)]
    s = T.graph_stats(e, v).first()
    assert (s["vertices"], s["edges"], s["sinks"], s["max_out"]) == (7, 8, 2, 3)
    assert [r["pos"] for r in T.in_positions(e).where("dst = 0").orderBy("event_idx").collect()] == [0, 1]
    assert T.structure_differences(e, e).count() == 0
    assert [r["id"] for r in T.structure_differences(e, e.where("event_idx > 0")).collect()] == [1]
    assert T.batches_by_source(e).where("src = 4").first()["events"][0]["dst"] == 2


def test_text_sources(spark, tmp_path):
    f = tmp_path / "g.txt"
    f.write_text("# note\n1 4\t2.5 100\n\n  2   0 0.5 200\r\n3 0")
    o = Options(graph=str(f), weight_pos=1, time_pos=2)
    got = [tuple(r) for r in text.read_events(spark, o).orderBy("event_idx").collect()]
    assert got == [(0, "ADD", 1, 4, 2.5, 100), (1, "ADD", 2, 0, 0.5, 200), (2, "ADD", 3, 0, 1.0, None)]
    m = text.read_events(spark, Options(graph=str(f), undirected=True, transpose=True, logical_time=True)).orderBy("event_idx").collect()
    assert [(r["event_idx"], r["src"], r["dst"], r["ts"]) for r in m][:3] == [(0, 4, 1, 0), (1, 1, 4, 1), (2, 0, 2, 2)]
    f.write_text("a 1 2\na 1 2\nd 1 2\n")
    g = Graph.read(spark, Options(graph=str(f), change_log=True))
    assert rows(g.edges(), "event_idx") == [(1,)]
    f.write_text("1 x2\n")
    with pytest.raises(Exception, match="not a vertex id"):
        text.read_events(spark, Options(graph=str(f))).collect()
    f.write_text("1 2 30\n3 4 4\n5 6 100\n")
    assert [r[0] for r in text.sort_lines(spark, str(f)).collect()] == ["3 4 4", "1 2 30", "5 6 100"]
    assert [r[0] for r in text.sort_lines(spark, str(f), as_text=True).collect()] == ["5 6 100", "1 2 30", "3 4 4"]
    assert sorted(r[0] for r in text.shuffle_lines(spark, str(f), 3).collect()) == ["1 2 30", "3 4 4", "5 6 100"]


@pytest.mark.parametrize("line", ["hello world this is a test", " hello  world this\tis a test ", "hello\tworld\tthis\tis\ta\ttest\r", "\x0bhello\x0cworld this is a test"])
def test_fields(spark, line):
    got = spark.createDataFrame([(line,)], "value string").select(text.fields(F.col("value")).alias("p")).first()["p"]
    assert got == ["hello", "world", "this", "is", "a", "test"]


def test_options():
    assert Options(snapshot_events=3).dynamic
    assert Options(previous_only=True).synchronous
    with pytest.raises(ValueError):
        Options(dynamic=True, synchronous=True)
    with pytest.raises(ValueError):
        Options(window_days=1)


def test_sql_views_and_deletes_stream(spark):
    e = text.events_of(spark, [("ADD", 1, 2)] * 5)
    g = Graph(tables.with_deletes(e, 2))
    g.views()
    assert spark.sql("select count(*) from graph_edges").first()[0] == 3
    assert spark.sql("select count(*) from graph_vertices").first()[0] == 2


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
def test_positions_of_a_hub(spark, width):
    rnd = random.Random(width)
    rows = [(k, rnd.choice([0, 0, 0, 1, 2])) for k in rnd.sample(range(500), 200)]
    want, seen = {}, defaultdict(int)
    for k, d in sorted(rows):
        want[k] = seen[d]
        seen[d] += 1
    df = spark.createDataFrame(rows, "event_idx long, dst long")
    got = in_order_within(df, "dst", "event_idx", width)
    assert got.columns == ["event_idx", "dst", "pos"] and {r["event_idx"]: r["pos"] for r in got.collect()} == want
    assert in_order_within(df.limit(0), "dst", "event_idx", width).count() == 0
