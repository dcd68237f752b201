"""The graph at points of its log: boundaries, counts, results over time and what becomes of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.functions.order import slot_of
from tidegraph.operators.pagerank import pagerank
from tidegraph.operators.temporal import reach_report, reachable_windows
from tidegraph.operators.topology import adds, live_edges, paired_deletes, range_edges, vertices
from tidegraph.plans.storage import drop, materialise, watched
from tidegraph.schema import ADD, DELETE

#: Most snapshots of one run: their boundaries are held on the driver.
MOST = 10_000
#: Events of a part of the log that is searched for boundaries on the driver (16 bytes each).
PART = 1 << 18


def ratchet(events: DataFrame, interval: int, first: int | None = None, part: int = PART) -> list[tuple[int, int]]:
    """(event_idx, ts) of the events that trigger a snapshot: the first at or past the target; then target = its ts + interval.

    The first target is the interval itself unless given. A boundary's time exceeds all before it, so it is the first
    event of the whole log at or past its target, and lies in the first part of the log whose latest time reaches that.
    One pass finds the latest time of each part of `part` events (or more, so that there are a million parts at most);
    then only parts that hold boundaries are read, each once, by ranges of event_idx.
    """
    log = events.select("event_idx", "ts").where("ts is not null").repartitionByRange("event_idx").sortWithinPartitions("event_idx")
    log = materialise(log, "times", {"n": F.count(F.lit(1)), "last": F.max("event_idx")})
    part = max(part, ((watched(log)["last"] or 0) >> 20) + 1)
    tops = log.groupBy(F.floor(F.col("event_idx") / part).alias("p")).agg(F.max("ts").alias("top")).orderBy("p").toArrow()
    parts, reach = tops.column("p").to_numpy(), np.maximum.accumulate(tops.column("top").to_numpy()) if len(tops) else np.zeros(0)
    target, out = interval if first is None else first, []
    while (k := int(np.searchsorted(reach, target))) < len(parts):
        rows = log.where(F.col("event_idx").between(int(parts[k]) * part, int(parts[k] + 1) * part - 1)).toArrow().sort_by("event_idx")
        at, times = rows.column("event_idx").to_numpy(), rows.column("ts").to_numpy()
        high = np.maximum.accumulate(times)
        while (j := int(np.searchsorted(high, target))) < len(at):
            if len(out) == MOST:
                raise ValueError(f"more than {MOST} snapshots; choose a longer interval")
            out.append((int(at[j]), int(times[j])))
            target = out[-1][1] + interval
    drop(log)
    return out


def every_events_frame(events: DataFrame, n: int) -> DataFrame:
    """(snapshot_id, at_event, at_ts) after n, 2n, ... events, any number of them: nothing is collected or ordered."""
    rows = events.where((F.col("event_idx") + 1) % n == 0)
    return rows.select((F.floor((F.col("event_idx") + 1) / n) - 1).cast("int").alias("snapshot_id"), F.col("event_idx").alias("at_event"), F.col("ts").alias("at_ts"))


def every_events(events: DataFrame, n: int) -> list[tuple[int, int]]:
    """(event_idx, ts) after n, 2n, ... events; mirrored and deleting events count too."""
    rows = events.where((F.col("event_idx") + 1) % n == 0).select("event_idx", "ts").orderBy("event_idx").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} snapshots; choose a larger step")
    return [(r[0], r[1]) for r in rows]


def boundary_frame(spark, bounds: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(k, e, t) for k, (e, t) in enumerate(bounds)], "snapshot_id int, at_event long, at_ts long")


def assigned(rows: DataFrame, bounds: list[tuple[int, int]], column: str = "event_idx") -> DataFrame:
    """Add snapshot_id, the first snapshot that holds the row; rows past the last one are dropped."""
    slot = slot_of(F.col(column), [e for e, _ in bounds])
    return rows.withColumn("snapshot_id", slot.cast("int")).where(F.col("snapshot_id") < len(bounds))


def counts(events: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """(snapshot_id, at_event, at_ts, vertex_count, edge_count, edge_deletes): one pass over events, then running sums over snapshots."""
    e = assigned(events, bounds).groupBy("snapshot_id").agg(F.count_if(F.col("type") == ADD).alias("a"), F.count_if(F.col("type") == DELETE).alias("d"))
    v = assigned(vertices(events), bounds, "create_event").groupBy("snapshot_id").agg(F.count("*").alias("v"))
    frame = boundary_frame(events.sparkSession, bounds)
    upto = Window.orderBy("snapshot_id").rowsBetween(Window.unboundedPreceding, 0)  # a row for each snapshot
    run = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(upto)
    return frame.join(e, "snapshot_id", "left").join(v, "snapshot_id", "left").select("snapshot_id", "at_event", "at_ts", run("v").alias("vertex_count"), (run("a") - run("d")).alias("edge_count"), run("d").alias("edge_deletes"))


def unfolded(rows: DataFrame, bounds: list[tuple[int, int]], column: str) -> DataFrame:
    """Every row once for each snapshot from its first on."""
    return assigned(rows, bounds, column).withColumn("snapshot_id", F.explode(F.sequence(F.col("snapshot_id"), F.lit(len(bounds) - 1))))


def unfolded_edges(events: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """(snapshot_id, event_idx, src, dst): every edge once for each snapshot that it is live in."""
    if not events.where(F.col("type") == DELETE).take(1):
        return unfolded(adds(events).select("event_idx", "src", "dst"), bounds, "event_idx")
    last = F.when(F.col("del_event").isNull(), len(bounds)).otherwise(slot_of(F.col("del_event"), [e for e, _ in bounds])).cast("int") - 1
    rows = assigned(paired_deletes(events), bounds).select("event_idx", "src", "dst", "snapshot_id", last.alias("_last")).where("snapshot_id <= _last")
    return rows.select(F.explode(F.sequence("snapshot_id", "_last")).alias("snapshot_id"), "event_idx", "src", "dst")


def pagerank_series(events: DataFrame, bounds: list[tuple[int, int]], rounds: int = 15, interest: list | None = None) -> DataFrame:
    """(snapshot_id, id, score): all snapshots are solved together, the snapshot's id being part of every key."""
    e = unfolded_edges(events, bounds)
    v = unfolded(vertices(events), bounds, "create_event")
    scores = pagerank(e, v.select("snapshot_id", "id"), rounds, by=["snapshot_id"])
    return scores.where(F.col("id").isin(interest)) if interest else scores


def degree_series(events: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """(snapshot_id, id, out_degree) of vertices with live out-edges, added up over snapshots."""
    new = assigned(events, bounds).groupBy("src", "snapshot_id").agg(F.sum(F.when(F.col("type") == ADD, 1).otherwise(-1)).alias("n"))
    every = new.select("src", F.explode(F.sequence("snapshot_id", F.lit(len(bounds) - 1))).alias("snapshot_id"), "n")
    return every.groupBy("snapshot_id", F.col("src").alias("id")).agg(F.sum("n").alias("out_degree")).where("out_degree > 0")


def top_series(series: DataFrame, n: int, value: str = "score") -> DataFrame:
    """(snapshot_id, rank, id, value): the n highest of each snapshot, ties to the smaller id."""
    order = Window.partitionBy("snapshot_id").orderBy(F.desc(value), "id")
    return series.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= n).select("snapshot_id", "rank", "id", value)


def waterfall(series: DataFrame, n: int, value: str = "score") -> DataFrame:
    """The series of every vertex that is ever among the n highest."""
    ever = top_series(series, n, value).select("id").distinct()
    return series.join(F.broadcast(ever), "id", "left_semi").select("snapshot_id", "id", value)  # at most n ids a snapshot


def derivative(series: DataFrame, bounds: list[tuple[int, int]], unit: float, value: str = "score") -> DataFrame:
    """(snapshot_id, id, slope): 100 * (next - last) / time between them in `unit`s; none at the ends or next to a gap."""
    times = boundary_frame(series.sparkSession, bounds).select("snapshot_id", "at_ts")
    own = Window.partitionBy("id").orderBy("snapshot_id")
    rows = series.join(F.broadcast(times), "snapshot_id")
    near = {f"{x}{c}": f(c).over(own) for x, f in (("last_", F.lag), ("next_", F.lead)) for c in ("snapshot_id", "at_ts", value)}
    full = rows.withColumns(near).where((F.col("last_snapshot_id") == F.col("snapshot_id") - 1) & (F.col("next_snapshot_id") == F.col("snapshot_id") + 1))
    return full.select("snapshot_id", "id", (100.0 * (F.col(f"next_{value}") - F.col(f"last_{value}")) / ((F.col("next_at_ts") - F.col("last_at_ts")) / unit)).alias("slope"))


def stability(series: DataFrame, value: str) -> DataFrame:
    """(snapshot_id, matched, same, different, pct_same, distinct_values): vertices that the snapshot before has too."""
    own = Window.partitionBy("id").orderBy("snapshot_id")
    rows = series.withColumns({"_s": F.lag("snapshot_id").over(own), "_v": F.lag(value).over(own)})
    seen = F.col("_s") == F.col("snapshot_id") - 1
    same, other = F.count_if(seen & (F.col(value) == F.col("_v"))), F.count_if(seen & (F.col(value) != F.col("_v")))
    return rows.groupBy("snapshot_id").agg(F.count_if(seen).alias("matched"), same.alias("same"), other.alias("different"), F.round(F.when(same + other > 0, 100.0 * same / (same + other)), 4).alias("pct_same"), F.count_distinct(value).alias("distinct_values"))


def solve_each(events: DataFrame, bounds: list[tuple[int, int]], solve) -> DataFrame:
    """Results of `solve(edges, vertices)` at each snapshot, from scratch, with snapshot_id; for programs that cannot be solved together."""
    out = None
    v = vertices(events)
    for k, (at, _) in enumerate(bounds):
        one = solve(live_edges(events, at), v.where(F.col("create_event") <= at)).withColumn("snapshot_id", F.lit(k))
        out = one if out is None else out.union(one)
    return out


def reach_series(events: DataFrame, bounds: list[tuple[int, int]], source, window: int | None = None) -> DataFrame:
    """The reach statistics of each snapshot, with snapshot_id, live and ended edges: edges that end later are still open in it."""
    out, v = None, vertices(events)
    for k, (at, now) in enumerate(bounds):
        edges = range_edges(events.where(F.col("event_idx") <= at), window)
        edges = materialise(edges.withColumn("end_ts", F.when(F.col("end_ts") <= now, F.col("end_ts"))), "ranges")
        size = edges.agg(F.count("*").alias("edges"), F.count("end_ts").alias("ended"))
        report = reach_report(reachable_windows(edges, source), edges, v.where(F.col("create_event") <= at))
        one = report.join(F.broadcast(size), F.lit(True)).select(F.lit(k).alias("snapshot_id"), F.lit(at).cast("long").alias("at_event"), F.lit(now).cast("long").alias("at_ts"), "edges", "ended", *report.columns)
        out = one if out is None else out.union(one)
    return out
