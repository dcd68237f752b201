"""Temporal reachability: when can a walk that follows edges in time be where."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tidegraph.plans.storage import cut, drop, watched

FOREVER = (1 << 63) - 1
#: Unreached edges from which on the rest is solved on the driver: long tails of rounds with a few edges each cost more than they hold.
LOCAL_EDGES = 50_000


def merge_windows(rows: DataFrame) -> DataFrame:
    """(id, start, end, hops) of maximal stretches of overlapping windows; windows that only touch stay apart. end null: open."""
    order = Window.partitionBy("id").orderBy("start", "_e")
    open_end = rows.withColumn("_e", F.coalesce("end", F.lit(FOREVER)))
    before = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = open_end.withColumn("_new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0))
    island = marked.withColumn("_k", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy("id", "_k").agg(F.min("start").alias("start"), F.max("_e").alias("_e"), F.min_by("hops", F.struct("start", "hops")).alias("hops"))
    return merged.select("id", "start", F.when(F.col("_e") == FOREVER, None).otherwise(F.col("_e")).alias("end"), "hops")


def reachable_windows(edges: DataFrame, source, max_rounds: int = 10_000, local_edges: int | None = None) -> DataFrame:
    """(id, start, end, hops): disjoint windows in which a vertex is reachable from `source`, itself [0, open).

    An edge [ts, end_ts) can be walked from a window that holds its ts strictly inside; it opens [ts, end_ts) at its
    target. hops is the least number of edges to a window's start. Every edge is reached at most once, and a round
    joins the new windows of a vertex, merged, with its unreached edges, so parallel ways do not multiply. Once at most
    `local_edges` (LOCAL_EDGES) edges are unreached the driver does the remaining rounds.
    """
    local_edges = LOCAL_EDGES if local_edges is None else local_edges
    todo = table = cut(edges.select("event_idx", "src", "dst", "ts", "end_ts"))
    spark = todo.sparkSession
    front = spark.range(1).select(F.lit(source).cast(edges.schema["src"].dataType).alias("id"), F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    reached = None
    for hops in range(1, max_rounds):
        inside = (F.col("src") == F.col("id")) & (F.col("ts") > F.col("start")) & (F.col("end").isNull() | (F.col("ts") < F.col("end")))
        marked = todo.join(front, inside, "left").select("event_idx", "src", "dst", "ts", "end_ts", F.col("id").isNotNull().alias("hit"))  # a vertex's windows are disjoint: at most one holds ts
        table = cut(marked, table, {"hit": F.count_if("hit"), "left": F.count_if(~F.col("hit"))})
        size = watched(table)
        if not size["hit"]:
            break
        rows = cut(table.where("hit").select(F.col("dst").alias("id"), F.col("ts").alias("start"), F.col("end_ts").alias("end"), F.lit(hops).cast("long").alias("hops")))
        reached = rows if reached is None else reached.union(rows)
        front = merge_windows(rows.where(F.col("id") != source)).drop("hops")
        todo = table.where("not hit").drop("hit")
        if size["left"] <= local_edges:
            # a window is sent only if it holds an edge, and an edge lies in one window of a vertex at most
            rest = _finish([tuple(r) for r in todo.collect()], [tuple(r) for r in front.join(todo.select("src", "ts"), inside, "left_semi").collect()], source, hops)
            reached = reached.union(spark.createDataFrame(rest, rows.schema))
            break
    else:
        raise RuntimeError(f"temporal windows: not done after {max_rounds} rounds")
    drop(table)
    own = spark.range(1).select(F.lit(source).cast(edges.schema["src"].dataType).alias("id"), F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(0).cast("long").alias("hops"))
    return own if reached is None else own.union(merge_windows(reached.where(F.col("id") != source)))


def _finish(edges: list[tuple], front: list[tuple], source, hops: int) -> list[tuple]:
    """The remaining rounds on at most LOCAL_EDGES edges (event_idx, src, dst, ts, end_ts), from windows (id, start, end)."""
    by: dict = {}
    for e in sorted(edges, key=lambda e: e[3]):
        by.setdefault(e[1], []).append(e)
    times = {v: [e[3] for e in es] for v, es in by.items()}
    taken: set[int] = set()
    out = []
    while front:
        hops += 1
        new = []
        for v, start, end in front:
            if v in by:
                for e in by[v][bisect_right(times[v], start) : len(by[v]) if end is None else bisect_left(times[v], end)]:
                    if e[0] not in taken:
                        taken.add(e[0])
                        new.append(e)
        out += [(e[2], e[3], e[4], hops) for e in new]
        front = [(e[2], e[3], e[4]) for e in new if e[2] != source]
    return out


def undominated(rows: DataFrame) -> DataFrame:
    """Windows (id, start, end, ...) that no other window of the vertex covers; of equal ones the first by hops."""
    order = Window.partitionBy("id").orderBy("start", F.desc("_e"), "hops")
    marked = rows.withColumn("_e", F.coalesce("end", F.lit(FOREVER))).withColumn("_top", F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return marked.where("_top is null or _e > _top").drop("_e", "_top")


def capped_windows(edges: DataFrame, source) -> DataFrame:
    """(id, start, end, hops) when a window ends with the edge or with the window it came from, whichever is first.

    Windows that another one covers are dropped; those that merely overlap stay, as their ends differ in what they allow.
    hops is the least number of edges to a window. A walk goes on strictly later, so one pass over the edges in order of
    time settles every window at its start: of a vertex it needs only how late a window with so many hops ends. Of
    parallel edges at one time the longest stands for all. Time is one order, so the pass is one task, over sorted rows
    that Spark spills; it holds the vertices' open windows by hops, and never pairs windows with edges.
    """
    kind = edges.schema["src"].dataType
    own = edges.sparkSession.range(1).select(F.lit(source).cast(kind).alias("id"), F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(0).cast("long").alias("hops"))
    last = F.max(F.coalesce("end_ts", F.lit(FOREVER))).alias("e")
    links = edges.where(F.col("dst") != source).where("src is not null and ts > 0").groupBy("src", "dst", "ts").agg(last)
    start = own.first()["id"]

    def run(batches):
        ends = {start: [(0, FOREVER)]}  # by vertex: (hops, latest end) of open windows that start before `now`, both rising
        tops, now, met = {}, None, {}
        out = [], [], [], []
        for batch in batches:
            for u, v, ts, e in zip(*(batch.column(c).to_pylist() for c in ("src", "dst", "ts", "e")), strict=True):
                if ts != now:
                    _settle(ends, tops, met, now, out)
                    now, met = ts, {}
                for hops, end in ends.get(u, ()):
                    if end > ts:
                        met.setdefault(v, []).append((hops + 1, min(end, e)))
                        if end >= e:
                            break
            yield _windows(out, schema)
            out = [], [], [], []
        _settle(ends, tops, met, now, out)
        yield _windows(out, schema)

    schema = to_arrow_schema(own.schema)
    return own.union(cut(links.repartition(1).sortWithinPartitions("ts").select("src", "dst", "ts", "e").mapInArrow(run, own.schema)))


def _settle(ends: dict, tops: dict, met: dict, now: int, out: tuple[list, ...]) -> None:
    """Enter the offers (hops, end) that vertices met at the time `now`, and give out the window of each that none covers.

    tops: how late any window of a vertex so far ends.
    """
    for v, offers in met.items():
        late, hops = max((end, -hops) for hops, end in offers)
        if v not in tops or late > tops[v]:
            tops[v] = late
            for column, x in zip(out, (v, now, late if late < FOREVER else None, -hops), strict=True):
                column.append(x)
        top, rising = now, []
        for x in sorted([*ends.get(v, ()), *offers], key=lambda x: (x[0], -x[1])):
            if x[1] > top:
                top = x[1]
                rising.append(x)
        ends[v] = rising


def _windows(out: tuple[list, ...], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def reach_report(windows: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: vertices, those reached ever (could) and still (an open window), active ones (an open out-edge), shares, windows a vertex."""
    per = windows.groupBy("id").agg(F.count("*").alias("windows"), F.max(F.col("end").isNull()).alias("still"))
    active = edges.where("end_ts is null").select(F.col("src").alias("id")).distinct().withColumn("active", F.lit(True))
    rows = vertices.select("id").join(per, "id", "left").join(active, "id", "left")
    could, still, act = F.count("windows"), F.count_if("still"), F.count("active")
    pct = lambda a, b: F.round(F.when(b > 0, 100.0 * a / b).otherwise(0.0), 4)
    return rows.agg(
        F.count("*").alias("vertices"),
        could.alias("could"),
        still.alias("still"),
        act.alias("active"),
        F.count_if(F.col("still") & F.col("active").isNotNull()).alias("active_visitable"),
        pct(could, F.count("*")).alias("could_pct"),
        pct(still, could).alias("still_pct"),
        F.coalesce(F.max("windows"), F.lit(0)).alias("max_windows"),
        F.coalesce(F.percentile("windows", F.lit(0.5)), F.lit(0.0)).alias("median_windows"),
    )


def ordinal_report(windows: DataFrame) -> DataFrame:
    """By ordinal of a vertex's window: least non-zero, median and highest start, end and hops."""
    rows = windows.withColumn("ordinal", F.row_number().over(Window.partitionBy("id").orderBy("start")))
    of = lambda c: [F.min(F.when(F.col(c) != 0, F.col(c))).alias(f"min_{c}"), F.percentile(c, F.lit(0.5)).alias(f"median_{c}"), F.max(c).alias(f"max_{c}")]
    return rows.groupBy("ordinal").agg(F.count("*").alias("vertices"), *of("start"), *of("end"), *of("hops"))


def window_violations(windows: DataFrame, edges: DataFrame, source, extend: bool = True) -> DataFrame:
    """Windows that overlap (extend) or cover one another, and edges whose offer no window of their target holds; none if right."""
    a = windows.select("id", "start", F.coalesce("end", F.lit(FOREVER)).alias("e"))
    order = Window.partitionBy("id").orderBy("start", F.desc("e"))
    top = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    wrong = (F.col("start") < top) if extend else (F.col("e") <= top)
    shape = a.withColumn("bad", wrong).where("bad").select("id", F.lit("windows collide").alias("what"))
    src = a.select(F.col("id").alias("src"), F.col("start").alias("s1"), F.col("e").alias("e1"))
    own_end = F.coalesce("end_ts", F.lit(FOREVER))
    offers = edges.join(src, "src").where("ts > s1 and ts < e1").where(F.col("dst") != source).select("dst", "ts", (own_end if extend else F.least(own_end, "e1")).alias("oe"))
    dst = a.select(F.col("id").alias("dst"), F.col("start").alias("s2"), F.col("e").alias("e2"))
    missing = offers.join(dst, (offers["dst"] == dst["dst"]) & (F.col("s2") <= F.col("ts")) & (F.col("e2") >= F.col("oe")), "left_anti")
    return shape.union(missing.select(F.col("dst").alias("id"), F.lit("better window offered").alias("what")))
