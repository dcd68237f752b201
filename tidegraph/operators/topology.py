"""From an event log to the graph at a point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.functions.order import in_order_within
from tidegraph.schema import ADD, DELETE


def adds(events: DataFrame) -> DataFrame:
    return events.where(F.col("type") == ADD)


def vertices(events: DataFrame) -> DataFrame:
    """(id, create_event): a vertex exists from the first event that names it, as src or dst, and is never removed."""
    ends = F.explode(F.array("src", "dst"))
    return adds(events).select("event_idx", ends.alias("id")).groupBy("id").agg(F.min("event_idx").alias("create_event"))


def in_positions(events: DataFrame) -> DataFrame:
    """ADD events with pos, the arrival number of the edge at its destination; deletions do not lower it."""
    return in_order_within(adds(events), "dst", "event_idx")


def paired_deletes(events: DataFrame, by_time: bool = False) -> DataFrame:
    """Every ADD with del_event and del_ts: the k-th deletion of a pair ends its k-th addition (null while it lives).

    A deletion without an addition before it stops the run. by_time: additions of a pair are taken in order of
    their timestamps instead of their arrival.
    """
    key = ["ts", "event_idx"] if by_time else ["event_idx"]
    starts = adds(events).withColumn("_k", F.row_number().over(Window.partitionBy("src", "dst").orderBy(*key)))
    ends = events.where(F.col("type") == DELETE).withColumn("_k", F.row_number().over(Window.partitionBy("src", "dst").orderBy("event_idx")))
    ends = ends.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("_k").alias("_dk"), F.col("event_idx").alias("del_event"), F.col("ts").alias("del_ts"))
    on = (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")) & (F.col("_k") == F.col("_dk"))
    both = starts.join(ends, on, "full")
    wrong = F.col("event_idx").isNull() | (F.col("del_event") < F.col("event_idx"))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("deletion without an edge: event "), F.col("del_event").cast("string"))).cast("long")).otherwise(F.col("del_event"))
    return both.withColumn("del_event", checked).drop("_k", "_s", "_d", "_dk")


def live_edges(events: DataFrame, at: int | None = None, by_time: bool = False) -> DataFrame:
    """Edges that are there after event `at` (all events if none): deletions remove the first live instance of their pair."""
    log = events if at is None else events.where(F.col("event_idx") <= at)
    return paired_deletes(log, by_time).where("del_event is null").select("event_idx", "src", "dst", "weight", "ts")


def range_edges(events: DataFrame, window: int | None = None, by_time: bool = False) -> DataFrame:
    """All edges ever added with end_ts: when they were deleted, or `window` after their start, whichever is first; null if open."""
    end = F.col("del_ts")
    if window:
        end = F.least(end, F.col("ts") + window)
    return paired_deletes(events, by_time).select("event_idx", "src", "dst", "weight", "ts", end.alias("end_ts"))


def window_edges(events: DataFrame, window: int, at_ts=None) -> DataFrame:
    """Edges live at time `at_ts` (the last event's if none) when each expires `window` after its start.

    The log must be in time order; an event that goes back in time stops the run.
    """
    edges = range_edges(checked_order(events), window)
    if at_ts is None:
        last = events.agg(F.max("ts").alias("_now"))
        return edges.join(F.broadcast(last), F.lit(True)).where("ts <= _now and (end_ts is null or end_ts > _now)").drop("_now")  # one row
    return edges.where((F.col("ts") <= at_ts) & (F.col("end_ts").isNull() | (F.col("end_ts") > at_ts)))


def checked_order(events: DataFrame, width: int = 1 << 16) -> DataFrame:
    """The same events; reading one whose time lies before an earlier event's fails."""
    block = F.floor(F.col("event_idx") / width)
    inside = Window.partitionBy("_blk").orderBy("event_idx")
    rows = events.withColumn("_blk", block)
    tops = rows.groupBy(F.col("_blk").alias("_bb")).agg(F.max("ts").alias("_top"))
    tops = tops.select("_bb", F.max("_top").over(Window.orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row for each block
    prior = F.greatest(F.max("ts").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    rows = rows.join(tops, F.col("_blk") == F.col("_bb")).withColumn("_prior", prior)
    ok = F.when(F.col("ts") < F.col("_prior"), F.raise_error(F.concat(F.lit("out of time order: event "), F.col("event_idx").cast("string"))).cast("long")).otherwise(F.col("ts"))
    return rows.withColumn("ts", ok).select(*events.columns)


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """(a, b, n, first_event, first_src) of distinct undirected pairs a < b without self-loops; the first event decides."""
    rows = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "event_idx", "src")
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("event_idx").alias("first_event"), F.min_by("src", "event_idx").alias("first_src"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(src, dst) of every distinct undirected pair in both directions."""
    pairs = undirected_pairs(edges).select("a", "b")
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def degrees(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of all ids; parallel edges count each."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    counted = edges.select(ends.alias("x")).groupBy("x.id").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))
    return ids.select("id").join(counted, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def graph_stats(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: vertices, highest id, edges, sinks and heads (count, percent), highest and median degrees."""
    d = degrees(edges, ids)
    share = lambda c: F.round(F.lit(100.0) * F.count_if(F.col(c) == 0) / F.count("*"), 4)
    return d.agg(
        F.count("*").alias("vertices"),
        F.max("id").alias("max_id"),
        F.sum("out_degree").alias("edges"),
        F.count_if(F.col("out_degree") == 0).alias("sinks"),
        share("out_degree").alias("sink_pct"),
        F.max("out_degree").alias("max_out"),
        F.percentile("out_degree", F.lit(0.5)).alias("median_out"),
        F.count_if(F.col("in_degree") == 0).alias("heads"),
        share("in_degree").alias("head_pct"),
        F.max("in_degree").alias("max_in"),
        F.percentile("in_degree", F.lit(0.5)).alias("median_in"),
    )


def in_edge_stats(edges: DataFrame) -> DataFrame:
    """Highest and median in-degree over the vertices that have an in-edge."""
    return edges.groupBy("dst").agg(F.count("*").alias("n")).agg(F.count("*").alias("vertices"), F.max("n").alias("max_in"), F.percentile("n", F.lit(0.5)).alias("median_in"))


def edge_counts(events: DataFrame) -> DataFrame:
    """One row: additions, deletions and what is left."""
    a, d = F.count_if(F.col("type") == ADD), F.count_if(F.col("type") == DELETE)
    return events.agg(a.alias("adds"), d.alias("deletes"), (a - d).alias("live"))


def structure_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids whose out-degree differs between two edge tables, or that only one has; none if the structures agree."""
    of = lambda e, name: degrees(e, e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()).select("id", F.col("out_degree").alias(name))
    return of(a, "left").join(of(b, "right"), "id", "full").where(~F.col("left").eqNullSafe(F.col("right")))


def batches_by_source(events: DataFrame) -> DataFrame:
    """(src, events): a batch's events of each source in stream order, as incremental programs take them."""
    return events.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("event_idx", "type", "dst", "weight", "ts"))).alias("events"))


def keep_first_edges(edges: DataFrame, also: Column | None = None) -> DataFrame:
    """Edges without self-loops and without repeats of a directed pair; the first stays."""
    first = Window.partitionBy("src", "dst").orderBy("event_idx")
    rows = edges.where("src <> dst") if also is None else edges.where((F.col("src") != F.col("dst")) & also)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
