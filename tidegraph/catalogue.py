"""All queries of the graph engine by name, and the SQL that states the same results.

Streams: visits between users (`ev`: one dense graph), customers to suppliers (`cs`: every supplier is a sink), parts to
customers (`pc`: many components). Sums of doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.functions.order import in_sorted_order
from tidegraph.functions.ranking import compare, overlap_report, top_n
from tidegraph.operators import groups, pagerank, paths, snapshots, temporal, topology
from tidegraph.sources import tables, text
from tidegraph.streaming.live import LiveGraph, colour_step, components_step, pagerank_step, program_step, sssp_step, temporal_step, triangles_step

MICROS = 1_000_000
DAY = 86_400 * MICROS
WEEK = 7 * DAY
ROUNDS = 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EV = """ev AS (SELECT * FROM (
  SELECT row_number() OVER (ORDER BY event_id) - 1 AS event_idx, user_id AS src, lead(user_id) OVER (ORDER BY event_id) AS dst,
         value AS weight, epoch_us(ts) AS ts FROM events) WHERE dst IS NOT NULL),
v AS (SELECT id, min(event_idx) AS create_event FROM (SELECT src AS id, event_idx FROM ev UNION ALL SELECT dst, event_idx FROM ev) GROUP BY id)"""
CS = f"""ev AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS event_idx, o_custkey AS src, l_suppkey + {tables.OFFSET} AS dst,
  l_quantity AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v AS (SELECT id FROM (SELECT src AS id FROM ev UNION SELECT dst FROM ev))"""
PC = f"""ev AS (SELECT l_partkey + {tables.OFFSET} AS src, o_custkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity = 50),
v AS (SELECT id FROM (SELECT src AS id FROM ev UNION SELECT dst FROM ev))"""
DEL = """adds AS (SELECT *, 2 * event_idx AS e2, row_number() OVER (PARTITION BY src, dst ORDER BY event_idx) AS k FROM ev),
dels AS (SELECT src, dst, e2 + 1 AS del_event, ts AS del_ts, row_number() OVER (PARTITION BY src, dst ORDER BY e2) AS k FROM adds WHERE k % 2 = 0),
ranges AS (SELECT e2 AS event_idx, src, dst, weight, ts, del_event, del_ts AS end_ts FROM adds LEFT JOIN dels USING (src, dst, k))"""
DIST = """d(id, distance) USING KEY (id) AS (
  SELECT 0::BIGINT, 0::DOUBLE
  UNION
  SELECT e.dst, min(d.distance + {w}) FROM d JOIN ev e ON e.src = d.id LEFT JOIN recurring.d r ON r.id = e.dst
  GROUP BY e.dst, r.distance HAVING r.distance IS NULL OR min(d.distance + {w}) < r.distance)"""
LABELS = """both_ways AS (SELECT src AS a, dst AS b FROM ev UNION SELECT dst, src FROM ev),
lab(id, component) USING KEY (id) AS (
  SELECT id, id FROM v
  UNION
  SELECT b.b, min(lab.component) FROM lab JOIN both_ways b ON b.a = lab.id LEFT JOIN recurring.lab r ON r.id = b.b
  GROUP BY b.b, r.component HAVING min(lab.component) < r.component)"""
RANKS = """n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER ({target})::DOUBLE AS k FROM v),
outs AS (SELECT src, count(*)::DOUBLE AS o FROM ev GROUP BY src),
links AS (SELECT src, dst, count(*) / any_value(o) AS share FROM ev JOIN outs USING (src) GROUP BY src, dst),
base AS (SELECT id, n.n, CASE WHEN {target} THEN 1 / n.k ELSE 0 END AS jump, outs.src IS NULL AS sink FROM v CROSS JOIN n LEFT JOIN outs ON outs.src = v.id),
pr(it, id, score) AS (
  SELECT 0, id, jump FROM base
  UNION ALL
  SELECT pr.it + 1, pr.id, 0.15::DOUBLE * jump + 0.85::DOUBLE * (coalesce(f.flow, 0) + (l.lost - CASE WHEN sink THEN pr.score ELSE 0 END) / (n - 1))
  FROM pr JOIN base USING (id)
  LEFT JOIN (SELECT links.dst AS id, sum(p.score * links.share) AS flow FROM pr p JOIN links ON links.src = p.id GROUP BY links.dst) f ON f.id = pr.id
  CROSS JOIN (SELECT coalesce(sum(p.score), 0) AS lost FROM pr p JOIN base b ON b.id = p.id WHERE b.sink) l
  WHERE pr.it < {rounds})"""
PAIRS = """first AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(event_idx) AS e, arg_min(src, event_idx) AS s, count(*) AS n FROM ev WHERE src <> dst GROUP BY ALL)"""
TRI = """tri AS (SELECT x.a, x.b, y.b AS c, CASE greatest(x.e, y.e, z.e) WHEN x.e THEN x.s WHEN y.e THEN y.s ELSE z.s END AS leader
  FROM first x JOIN first y ON y.a = x.a AND y.b > x.b JOIN first z ON z.a = x.b AND z.b = y.b)"""
BOUNDS = f"""b(snapshot_id, at_event, at_ts) AS (
  SELECT 0, min(event_idx), arg_min(ts, event_idx) FROM ev WHERE ts >= {{step}}
  UNION ALL
  SELECT b.snapshot_id + 1, min(ev.event_idx), arg_min(ev.ts, ev.event_idx) FROM b JOIN ev ON ev.ts >= b.at_ts + {{step}} AND ev.event_idx > b.at_event GROUP BY b.snapshot_id)"""
REACH = """r AS (SELECT event_idx, dst, ts, coalesce(end_ts, {open}) AS en FROM ranges WHERE src = 0 AND ts > 0
  UNION
  SELECT e.event_idx, e.dst, e.ts, coalesce(e.end_ts, {open}) FROM r JOIN ranges e ON e.src = r.dst AND r.dst <> 0 AND r.ts < e.ts AND e.ts < r.en),
marked AS (SELECT dst AS id, ts, en, CASE WHEN ts >= max(en) OVER (PARTITION BY dst ORDER BY ts, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM r WHERE dst <> 0),
isl AS (SELECT id, ts, en, sum(new) OVER (PARTITION BY id ORDER BY ts, en ROWS UNBOUNDED PRECEDING) AS k FROM marked),
windows AS (SELECT id, min(ts) AS start, max(en) AS en FROM isl GROUP BY id, k UNION ALL SELECT 0, 0, {open})"""
COLOURS = """ranked AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM v),
near AS (SELECT y.r, list(DISTINCT x.r) AS l FROM ev JOIN ranked x ON x.id = least(src, dst) JOIN ranked y ON y.id = greatest(src, dst) WHERE src <> dst GROUP BY y.r),
col(r, l) AS (
  SELECT 0::BIGINT, []::INTEGER[]
  UNION ALL
  SELECT col.r + 1, list_append(col.l, list_filter(range(0, len(coalesce(near.l, [])) + 1), lambda c: NOT list_contains(list_transform(coalesce(near.l, []), lambda k: col.l[k]), c))[1]::INTEGER)
  FROM col LEFT JOIN near ON near.r = col.r + 1 WHERE col.r < (SELECT count(*) FROM v)),
done AS (SELECT l FROM col ORDER BY r DESC LIMIT 1),
coloured AS (SELECT ranked.id, done.l[ranked.r] AS colour FROM ranked, done)"""
OPEN = (1 << 63) - 1


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def ev(s: SparkSession, d: str) -> DataFrame:
    return tables.visits(s, d)


def _weekly(events: DataFrame) -> DataFrame:
    return topology.range_edges(events, WEEK)


# Topology


@query("edge_stats", _with(CS, "o AS (SELECT id, count(src) AS o FROM v LEFT JOIN ev ON ev.src = v.id GROUP BY id)", "i AS (SELECT id, count(dst) AS i FROM v LEFT JOIN ev ON ev.dst = v.id GROUP BY id)") + """
SELECT count(*) AS vertices, max(id) AS max_id, sum(o)::BIGINT AS edges, count(*) FILTER (o = 0) AS sinks, round(100.0::DOUBLE * count(*) FILTER (o = 0) / count(*), 4) AS sink_pct,
  max(o) AS max_out, median(o)::DOUBLE AS median_out, count(*) FILTER (i = 0) AS heads, round(100.0::DOUBLE * count(*) FILTER (i = 0) / count(*), 4) AS head_pct, max(i) AS max_in, median(i)::DOUBLE AS median_in
FROM o JOIN i USING (id)""")  # fmt: skip
def edge_stats(s, d):
    e = tables.customer_supplier(s, d)
    return topology.graph_stats(topology.live_edges(e), topology.vertices(e))


@query("out_degree", _with(EV) + "SELECT id, count(src) AS out_degree FROM v LEFT JOIN ev ON src = id GROUP BY id")
def out_degree(s, d):
    e = ev(s, d)
    return topology.degrees(e, topology.vertices(e)).select("id", "out_degree")


@query("in_degree", _with(EV) + "SELECT id, count(dst) AS in_degree FROM v LEFT JOIN ev ON dst = id GROUP BY id")
def in_degree(s, d):
    e = ev(s, d)
    return topology.degrees(e, topology.vertices(e)).select("id", "in_degree")


@query("degree_median", _with(CS, "i AS (SELECT dst, count(*) AS n FROM ev GROUP BY dst)") + "SELECT count(*) AS vertices, max(n) AS max_in, median(n)::DOUBLE AS median_in FROM i")
def degree_median(s, d):
    return topology.in_edge_stats(tables.customer_supplier(s, d))


@query("undirected_edges", _with(EV) + "SELECT 2 * event_idx AS event_idx, src, dst, ts FROM ev UNION ALL SELECT 2 * event_idx + 1, dst, src, ts FROM ev")
def undirected_edges(s, d):
    return text.mirror(ev(s, d)).select("event_idx", "src", "dst", "ts")


@query("undirected_pairs", _with(EV, PAIRS) + "SELECT a, b, n, e AS first_event, s AS first_src FROM first")
def undirected_pairs(s, d):
    return topology.undirected_pairs(ev(s, d))


@query("transpose_edges", _with(EV) + "SELECT event_idx, dst AS src, src AS dst, weight FROM ev")
def transpose_edges(s, d):
    return text.transpose(ev(s, d)).select("event_idx", "src", "dst", "weight")


@query("in_event_pos", _with(EV) + "SELECT event_idx, dst, row_number() OVER (PARTITION BY dst ORDER BY event_idx) - 1 AS pos FROM ev")
def in_event_pos(s, d):
    return topology.in_positions(ev(s, d)).select("event_idx", "dst", "pos")


@query("vertex_create_event", _with(EV) + "SELECT id, create_event FROM v")
def vertex_create_event(s, d):
    return topology.vertices(ev(s, d))


@query("edge_counts", _with(EV, DEL) + "SELECT (SELECT count(*) FROM adds) AS adds, (SELECT count(*) FROM dels) AS deletes, (SELECT count(*) FROM adds) - (SELECT count(*) FROM dels) AS live")
def edge_counts(s, d):
    return topology.edge_counts(tables.with_deletes(ev(s, d), 2))


@query("fifo_delete_live_edges", _with(EV, DEL) + "SELECT event_idx, src, dst, weight FROM ranges WHERE del_event IS NULL")
def fifo_delete_live_edges(s, d):
    return topology.live_edges(tables.with_deletes(ev(s, d), 2)).select("event_idx", "src", "dst", "weight")


@query("time_range_edges", _with(EV, DEL) + "SELECT event_idx, src, dst, ts, end_ts FROM ranges")
def time_range_edges(s, d):
    return topology.range_edges(tables.with_deletes(ev(s, d), 2)).select("event_idx", "src", "dst", "ts", "end_ts")


@query("window_expiry_live_edges", _with(EV) + f"SELECT event_idx, src, dst, ts, ts + {WEEK} AS end_ts FROM ev WHERE ts + {WEEK} > (SELECT max(ts) FROM ev)")
def window_expiry_live_edges(s, d):
    return topology.window_edges(ev(s, d), WEEK).select("event_idx", "src", "dst", "ts", "end_ts")


@query("structure_differences", _with(EV) + "SELECT 0::BIGINT AS differing")
def structure_differences(s, d):
    """Mirrored both ways round, the structures agree."""
    e = ev(s, d)
    a, b = text.mirror(e), text.mirror(text.transpose(e))
    return topology.structure_differences(a, b).agg(F.count("*").alias("differing"))


@query("sort_events", _with(EV) + "SELECT row_number() OVER (ORDER BY weight, event_idx) - 1 AS pos, event_idx, src, dst, weight FROM ev")
def sort_events(s, d):
    """Stable order by weight, null last: positions by range partitions, then by offsets of the partitions."""
    return in_sorted_order(ev(s, d).select("event_idx", "src", "dst", "weight"), F.asc_nulls_last("weight"), "event_idx")


# Paths


@query("sssp_weighted", _with(EV, DIST.format(w="e.weight"), recursive=True) + "SELECT v.id, round(d.distance, 4) AS distance FROM v LEFT JOIN d USING (id)")
def sssp_weighted(s, d):
    e = ev(s, d)
    return paths.shortest_paths(e, topology.vertices(e), {0: 0.0}).select("id", F.round("distance", 4).alias("distance"))


@query("sssp_hops", _with(CS, DIST.format(w="1::DOUBLE"), recursive=True) + "SELECT v.id, d.distance FROM v LEFT JOIN d USING (id)")
def sssp_hops(s, d):
    e = tables.customer_supplier(s, d)
    return paths.shortest_paths(e, topology.vertices(e), {0: 0.0}, weighted=False)


@query("sssp_histogram", _with(EV, DIST.format(w="e.weight"), recursive=True) + "SELECT floor(d.distance)::BIGINT AS bucket, count(*) AS vertices FROM v JOIN d USING (id) GROUP BY 1")
def sssp_histogram(s, d):
    e = ev(s, d)
    got = paths.shortest_paths(e, topology.vertices(e), {0: 0.0}).where("distance is not null")
    return got.groupBy(F.floor("distance").alias("bucket")).agg(F.count("*").alias("vertices"))


@query("sssp_report", _with(EV, DIST.format(w="e.weight"), recursive=True) + "SELECT count(*) AS vertices, count(d.distance) AS visited, round(100.0::DOUBLE * count(d.distance) / count(*), 4) AS visited_pct, round(max(d.distance), 4) AS max_distance FROM v LEFT JOIN d USING (id)")
def sssp_report(s, d):
    e = ev(s, d)
    return paths.distance_report(paths.shortest_paths(e, topology.vertices(e), {0: 0.0}))


@query("sssp_check", "SELECT 0::BIGINT AS violations")
def sssp_check(s, d):
    e = ev(s, d)
    return paths.shorter_edges(paths.shortest_paths(e, topology.vertices(e), {0: 0.0}), e).agg(F.count("*").alias("violations"))


# Components, triangles, colours


@query("cc_labels", _with(PC, LABELS, recursive=True) + "SELECT id, component FROM lab")
def cc_labels(s, d):
    e = tables.part_customer(s, d)
    return groups.connected_components(e, topology.vertices(e))


@query("cc_sizes", _with(PC, LABELS, recursive=True) + "SELECT component, count(*) AS vertices FROM lab GROUP BY component")
def cc_sizes(s, d):
    return cc_labels(s, d).groupBy("component").agg(F.count("*").alias("vertices"))


@query("cc_program", _with(PC, LABELS, recursive=True) + "SELECT id, component AS label FROM lab")
def cc_program(s, d):
    """The same labels from a vertex program that spreads the least one."""
    from tidegraph.plans.program import run

    e = tables.part_customer(s, d)
    return run(groups.least_label_program(), e, topology.vertices(e))


@query("cc_check", "SELECT 0::BIGINT AS violations")
def cc_check(s, d):
    e = tables.part_customer(s, d)
    return groups.split_edges(groups.connected_components(e, topology.vertices(e)), e).agg(F.count("*").alias("violations"))


@query("triangle_total", _with(EV, PAIRS, TRI) + "SELECT count(*) AS triangles FROM tri")
def triangle_total(s, d):
    return groups.triangles(ev(s, d)).agg(F.count("*").alias("triangles"))


@query("triangle_leaders", _with(EV, PAIRS, TRI) + "SELECT leader AS id, count(*) AS triangles FROM tri GROUP BY leader")
def triangle_leaders(s, d):
    return groups.triangle_leaders(ev(s, d))


def _coloured(s, d):
    e = tables.part_customer(s, d)
    v = topology.vertices(e)
    return e, v, groups.colour(e, v)


@query("colouring", _with(PC, COLOURS, recursive=True) + "SELECT id, colour FROM coloured")
def colouring(s, d):
    return _coloured(s, d)[2]


@query("colouring_histogram", _with(PC, COLOURS, recursive=True) + "SELECT colour, count(*) AS vertices FROM coloured GROUP BY colour")
def colouring_histogram(s, d):
    return groups.colour_histogram(_coloured(s, d)[2])


@query("colouring_check", _with(PC) + "SELECT (SELECT count(*) FROM v) AS vertices, 0::BIGINT AS violations")
def colouring_check(s, d):
    e, v, c = _coloured(s, d)
    bad = groups.colour_violations(c, e, v).agg(F.count("*").alias("violations"))
    return c.agg(F.count("colour").alias("vertices")).join(F.broadcast(bad), F.lit(True))


# PageRank


@query("pagerank", _with(CS, RANKS.format(target="TRUE", rounds=ROUNDS), recursive=True) + f"SELECT id, round(score, 8) AS score FROM pr WHERE it = {ROUNDS}")
def pagerank_(s, d):
    e = tables.customer_supplier(s, d)
    return pagerank.pagerank(e, topology.vertices(e), ROUNDS).select("id", F.round("score", 8).alias("score"))


@query("pagerank_topn", _with(EV, RANKS.format(target="TRUE", rounds=ROUNDS), recursive=True) + f"SELECT row_number() OVER (ORDER BY round(score, 8) DESC, id)::INTEGER AS rank, id, round(score, 8) AS score FROM pr WHERE it = {ROUNDS} QUALIFY rank <= 10")
def pagerank_topn(s, d):
    e = ev(s, d)
    return top_n(pagerank.pagerank(e, topology.vertices(e), ROUNDS).select("id", F.round("score", 8).alias("score")), 10)


@query("pagerank_personalised", _with(EV, RANKS.format(target="id IN (1, 2, 3)", rounds=ROUNDS), recursive=True) + f"SELECT id, round(score, 8) AS score FROM pr WHERE it = {ROUNDS}")
def pagerank_personalised(s, d):
    e = ev(s, d)
    return pagerank.pagerank(e, topology.vertices(e), ROUNDS, sources=[1, 2, 3]).select("id", F.round("score", 8).alias("score"))


@query("pagerank_check", "SELECT true AS whole")
def pagerank_check(s, d):
    e = ev(s, d)
    return pagerank.mass(pagerank.pagerank(e, topology.vertices(e), ROUNDS)).select((F.col("off") < 1e-9).alias("whole"))


@query("l1_compare", _with(EV, RANKS.format(target="TRUE", rounds=ROUNDS), recursive=True) + f"SELECT count(*) AS vertices, round(avg(abs(a.score - b.score)), 8) AS avg_l1, round(quantile_cont(abs(a.score - b.score), 0.5), 8) AS median_l1, round(quantile_cont(abs(a.score - b.score), 0.95), 8) AS p95_l1, round(max(abs(a.score - b.score)), 8) AS max_l1 FROM pr a JOIN pr b USING (id) WHERE a.it = 1 AND b.it = {ROUNDS}")
def l1_compare(s, d):
    """How far one round is from the result."""
    e = ev(s, d)
    v = topology.vertices(e)
    got = compare(pagerank.pagerank(e, v, 1), pagerank.pagerank(e, v, ROUNDS), "score")
    return got.select("vertices", *[F.round(c, 8).alias(c) for c in got.columns[1:]])


@query("rbo_compare")
def rbo_compare(s, d):
    """Differences and rank overlap of a result after two rounds with the settled one."""
    e = ev(s, d)
    v = topology.vertices(e)
    return overlap_report(pagerank.pagerank(e, v, 2), pagerank.pagerank(e, v, ROUNDS))


# Time


def _temporal(s, d):
    e = _weekly(ev(s, d))
    return e, temporal.reachable_windows(e, 0)


@query("temporal_windows", _with(EV, f"ranges AS (SELECT event_idx, src, dst, ts, ts + {WEEK} AS end_ts FROM ev)", REACH.format(open=OPEN), recursive=True) + f'SELECT id, start, CASE WHEN en < {OPEN} THEN en END AS "end" FROM windows')
def temporal_windows(s, d):
    return _temporal(s, d)[1].drop("hops")


@query("temporal_windows_rounds", ORACLES["temporal_windows"])
def temporal_windows_rounds(s, d):
    """The same, with every round distributed: the driver finishes none."""
    return temporal.reachable_windows(_weekly(ev(s, d)), 0, local_edges=0).drop("hops")


@query("temporal_reach_stats", _with(EV, DEL, REACH.format(open=OPEN), f"per AS (SELECT id, count(*) AS w, bool_or(en = {OPEN}) AS still FROM windows GROUP BY id)", "act AS (SELECT DISTINCT src AS id FROM ranges WHERE end_ts IS NULL)", "j AS (SELECT v.id, w, coalesce(still, false) AS still, act.id IS NOT NULL AS act FROM v LEFT JOIN per USING (id) LEFT JOIN act USING (id))", recursive=True) + """
SELECT count(*) AS vertices, count(w) AS could, count(*) FILTER (still) AS still, count(*) FILTER (act) AS active, count(*) FILTER (act AND still) AS active_visitable,
  round(100.0::DOUBLE * count(w) / count(*), 4) AS could_pct, round(100.0::DOUBLE * count(*) FILTER (still) / count(w), 4) AS still_pct, coalesce(max(w), 0) AS max_windows, median(w)::DOUBLE AS median_windows FROM j""")  # fmt: skip
def temporal_reach_stats(s, d):
    events = tables.with_deletes(ev(s, d), 2)
    e = topology.range_edges(events)
    return temporal.reach_report(temporal.reachable_windows(e, 0), e, topology.vertices(events))


@query("temporal_capped_windows")
def temporal_capped_windows(s, d):
    return temporal.capped_windows(_weekly(ev(s, d)), 0).drop("hops")


@query("temporal_ordinals", _with(EV, f"ranges AS (SELECT event_idx, src, dst, ts, ts + {WEEK} AS end_ts FROM ev)", REACH.format(open=OPEN), "o AS (SELECT id, start, row_number() OVER (PARTITION BY id ORDER BY start) AS ordinal FROM windows)", recursive=True) + "SELECT ordinal::INTEGER AS ordinal, count(*) AS vertices, min(start) FILTER (start <> 0) AS min_start, max(start) AS max_start FROM o GROUP BY ordinal")
def temporal_ordinals(s, d):
    return temporal.ordinal_report(_temporal(s, d)[1]).select("ordinal", "vertices", "min_start", "max_start")


@query("temporal_check", "SELECT 0::BIGINT AS violations")
def temporal_check(s, d):
    e, w = _temporal(s, d)
    return temporal.window_violations(w, e, 0).agg(F.count("*").alias("violations"))


@query("snapshot_boundaries_ts", _with(EV, BOUNDS.format(step=DAY), recursive=True) + "SELECT snapshot_id::INTEGER AS snapshot_id, at_event, at_ts FROM b WHERE at_event IS NOT NULL")
def snapshot_boundaries_ts(s, d):
    return snapshots.boundary_frame(s, snapshots.ratchet(ev(s, d), DAY))


@query("snapshot_boundaries_count", _with(EV) + "SELECT ((event_idx + 1) // 250 - 1)::INTEGER AS snapshot_id, event_idx AS at_event, ts AS at_ts FROM ev WHERE (event_idx + 1) % 250 = 0")
def snapshot_boundaries_count(s, d):
    return snapshots.every_events_frame(ev(s, d), 250)


@query("snapshot_counts", _with(EV, BOUNDS.format(step=DAY), recursive=True) + "SELECT snapshot_id::INTEGER AS snapshot_id, at_event, at_ts, (SELECT count(*) FROM v WHERE create_event <= at_event) AS vertex_count, (SELECT count(*) FROM ev WHERE event_idx <= at_event) AS edge_count, 0::BIGINT AS edge_deletes FROM b WHERE at_event IS NOT NULL")
def snapshot_counts(s, d):
    e = ev(s, d)
    return snapshots.counts(e, snapshots.ratchet(e, DAY))


SERIES = """outs AS (SELECT b.snapshot_id, src, count(*)::DOUBLE AS o FROM b JOIN ev ON ev.event_idx <= at_event GROUP BY ALL),
links AS (SELECT b.snapshot_id, ev.src, dst, count(*) / any_value(o) AS share FROM b JOIN ev ON ev.event_idx <= at_event JOIN outs ON outs.snapshot_id = b.snapshot_id AND outs.src = ev.src GROUP BY ALL),
sv AS (SELECT b.snapshot_id, id, count(*) OVER (PARTITION BY b.snapshot_id)::DOUBLE AS n, outs.src IS NULL AS sink FROM b JOIN v ON create_event <= at_event LEFT JOIN outs ON outs.snapshot_id = b.snapshot_id AND outs.src = id),
pr(it, snapshot_id, id, score) AS (
  SELECT 0, snapshot_id, id, 1 / n FROM sv
  UNION ALL
  SELECT pr.it + 1, pr.snapshot_id, pr.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(f.flow, 0) + (coalesce(l.lost, 0) - CASE WHEN sink THEN pr.score ELSE 0 END) / (n - 1))
  FROM pr JOIN sv ON sv.snapshot_id = pr.snapshot_id AND sv.id = pr.id
  LEFT JOIN (SELECT k.snapshot_id, k.dst AS id, sum(p.score * k.share) AS flow FROM pr p JOIN links k ON k.src = p.id AND k.snapshot_id = p.snapshot_id GROUP BY ALL) f ON f.id = pr.id AND f.snapshot_id = pr.snapshot_id
  LEFT JOIN (SELECT p.snapshot_id, sum(p.score) AS lost FROM pr p JOIN sv q ON q.id = p.id AND q.snapshot_id = p.snapshot_id WHERE q.sink GROUP BY ALL) l ON l.snapshot_id = pr.snapshot_id
  WHERE pr.it < 10),
series AS (SELECT snapshot_id, id, round(score, 8) AS score FROM pr WHERE it = 10),
ever AS (SELECT DISTINCT id FROM (SELECT id, row_number() OVER (PARTITION BY snapshot_id ORDER BY score DESC, id) AS rank FROM series) WHERE rank <= 10)"""


def _series(s, d):
    e = ev(s, d)
    bounds = snapshots.ratchet(e, WEEK)
    got = snapshots.pagerank_series(e, bounds, 10).select("snapshot_id", "id", F.round("score", 8).alias("score"))
    return bounds, snapshots.waterfall(got, 10)


@query("pagerank_waterfall", _with(EV, BOUNDS.format(step=WEEK), SERIES, recursive=True) + "SELECT snapshot_id::INTEGER AS snapshot_id, id, score FROM series JOIN ever USING (id)")
def pagerank_waterfall(s, d):
    return _series(s, d)[1]


@query("pagerank_derivative", _with(EV, BOUNDS.format(step=WEEK), SERIES, recursive=True) + f"""
SELECT x.snapshot_id::INTEGER AS snapshot_id, x.id, round(100.0::DOUBLE * (z.score - y.score) / ((bz.at_ts - yb.at_ts) / {float(DAY)}::DOUBLE), 6) AS slope
FROM series x JOIN ever USING (id) JOIN series y ON y.id = x.id AND y.snapshot_id = x.snapshot_id - 1 JOIN series z ON z.id = x.id AND z.snapshot_id = x.snapshot_id + 1
JOIN b yb ON yb.snapshot_id = y.snapshot_id JOIN b bz ON bz.snapshot_id = z.snapshot_id""")  # fmt: skip
def pagerank_derivative(s, d):
    bounds, series = _series(s, d)
    return snapshots.derivative(series, bounds, DAY).select("snapshot_id", "id", F.round("slope", 6).alias("slope"))


@query("degree_stability", _with(EV, BOUNDS.format(step=WEEK), "s AS (SELECT snapshot_id, src AS id, count(*) AS o FROM b JOIN ev ON event_idx <= at_event GROUP BY ALL)", "j AS (SELECT x.snapshot_id, x.o, y.o AS po FROM s x LEFT JOIN s y ON y.id = x.id AND y.snapshot_id = x.snapshot_id - 1)", recursive=True) + """
SELECT snapshot_id::INTEGER AS snapshot_id, count(po) AS matched, count(*) FILTER (o = po) AS same, count(*) FILTER (o <> po) AS different,
  round(CASE WHEN count(po) > 0 THEN 100.0::DOUBLE * count(*) FILTER (o = po) / count(po) END, 4) AS pct_same, count(DISTINCT o) AS distinct_values FROM j GROUP BY snapshot_id""")  # fmt: skip
def degree_stability(s, d):
    e = ev(s, d)
    return snapshots.stability(snapshots.degree_series(e, snapshots.ratchet(e, WEEK)), "out_degree")


@query("snapshot_degrees", _with(EV, DEL, BOUNDS.format(step=WEEK), recursive=True) + """
SELECT snapshot_id::INTEGER AS snapshot_id, src AS id, count(*) AS out_degree FROM b JOIN ranges ON event_idx <= 2 * at_event AND (del_event IS NULL OR del_event > 2 * at_event) GROUP BY ALL""")  # fmt: skip
def snapshot_degrees(s, d):
    """Out-degrees at weekly snapshots of a log with deletions."""
    events = tables.with_deletes(ev(s, d), 2)
    return snapshots.degree_series(events, snapshots.ratchet(events, WEEK))


@query("snapshot_edges", _with(EV, DEL, BOUNDS.format(step=WEEK), recursive=True) + """
SELECT snapshot_id::INTEGER AS snapshot_id, event_idx, src, dst FROM b JOIN ranges ON event_idx <= 2 * at_event AND (del_event IS NULL OR del_event > 2 * at_event)""")  # fmt: skip
def snapshot_edges(s, d):
    """The live edges at weekly snapshots of a log with deletions."""
    events = tables.with_deletes(ev(s, d), 2)
    return snapshots.unfolded_edges(events, snapshots.ratchet(events, WEEK)).select("snapshot_id", "event_idx", "src", "dst")


@query("colour_stability")
def colour_stability(s, d):
    """Colours of three snapshots, each solved from scratch."""
    e = tables.part_customer(s, d).withColumn("ts", F.col("event_idx"))
    step = max(1, e.count() // 3)
    return snapshots.stability(snapshots.solve_each(e, snapshots.every_events(e, step), groups.colour), "colour")


# Live


def _live(s, events: DataFrame, name: str, step, pieces: int = 3) -> DataFrame:
    n = events.count()
    bounds = snapshots.every_events(events, max(1, n // pieces))[: pieces - 1]
    live = LiveGraph(s, {name: step})
    live.replay(events, bounds)
    return live.state(name)


@query("live_sssp", ORACLES["sssp_weighted"])
def live_sssp(s, d):
    """Shortest paths kept up over three batches equal those of the whole log."""
    return _live(s, ev(s, d), "sssp", sssp_step({0: 0.0})).select("id", F.round("distance", 4).alias("distance"))


@query("live_components", ORACLES["cc_labels"])
def live_components(s, d):
    e = tables.part_customer(s, d)
    return _live(s, e, "cc", components_step)


@query("live_program", ORACLES["cc_program"])
def live_program(s, d):
    """A vertex program that goes on from the messages of each batch."""
    return _live(s, tables.part_customer(s, d), "labels", program_step(groups.least_label_program()))


@query("live_triangles", ORACLES["triangle_leaders"])
def live_triangles(s, d):
    return _live(s, ev(s, d), "triangles", triangles_step)


@query("live_temporal", _with(EV, DEL, REACH.format(open=OPEN), recursive=True) + f'SELECT id, start, CASE WHEN en < {OPEN} THEN en END AS "end" FROM windows')
def live_temporal(s, d):
    """Windows of the log with deletions, kept up over two batches."""
    return _live(s, tables.with_deletes(ev(s, d), 2), "temporal", temporal_step(0), 2).drop("hops")


@query("live_colouring", _with(PC) + "SELECT (SELECT count(*) FROM v) AS vertices, 0::BIGINT AS differing")
def live_colouring(s, d):
    """Colours kept up over three batches, the last of which deletes edges, against colours of the graph that is left."""
    adds = tables.part_customer(s, d).withColumn("event_idx", F.col("event_idx") * 2)
    dels = adds.where("event_idx % 10 = 0").withColumn("type", F.lit("DEL"))
    end = adds.agg(F.max("event_idx")).first()[0] + 1
    events = adds.unionByName(dels.withColumn("event_idx", F.col("event_idx") + end))
    live = LiveGraph(s, {"colour": colour_step})
    live.replay(events, [(end // 2, 0), (end, 0)])
    whole = groups.colour(topology.live_edges(events), topology.vertices(events))
    both = live.state("colour").join(whole.select("id", F.col("colour").alias("other")), "id", "full")
    return both.agg(F.count("*").alias("vertices"), F.count_if(~F.col("colour").eqNullSafe(F.col("other"))).alias("differing"))


@query("live_pagerank", _with(EV, RANKS.format(target="TRUE", rounds=60), recursive=True) + "SELECT id, round(score, 6) AS score FROM pr WHERE it = 60")
def live_pagerank(s, d):
    return _live(s, ev(s, d), "pagerank", pagerank_step(1e-10), 2).select("id", F.round("score", 6).alias("score"))


@query("top_degree", _with(EV, "o AS (SELECT src AS id, count(*) AS n FROM ev GROUP BY src)") + "SELECT row_number() OVER (ORDER BY n DESC, id)::INTEGER AS rank, id, n AS degree FROM o QUALIFY rank <= 20")
def top_degree(s, d):
    got = ev(s, d).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(20)
    return got.select(F.row_number().over(Window.orderBy(F.desc("degree"), "id")).cast("int").alias("rank"), "id", "degree")
