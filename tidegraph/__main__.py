"""python -m tidegraph PROGRAM -g FILE [options]: run one program on a text graph and show or write its result."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidegraph import sinks
from tidegraph.functions.ranking import compare, overlap_report, top_n
from tidegraph.graph import Graph
from tidegraph.operators import groups, pagerank, paths, snapshots, temporal, topology
from tidegraph.plans.storage import materialise
from tidegraph.schema import DAY, Options
from tidegraph.sources import text
from tidegraph.streaming.live import LiveGraph, colour_step, components_step, pagerank_step, sssp_step, temporal_step, triangles_step

log = logging.getLogger("tidegraph")
PROGRAMS = ("pagerank", "sssp", "cc", "triangles", "colour", "temporal", "stats", "sort", "shuffle")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tidegraph", description=__doc__)
    p.add_argument("program", choices=PROGRAMS)
    p.add_argument("-g", dest="graph", required=True, help="edge list or change log")
    p.add_argument("-u", dest="undirected", action="store_true")
    p.add_argument("-tr", dest="transpose", action="store_true")
    p.add_argument("-pw", dest="weight_pos", type=int, default=0)
    p.add_argument("-pt", dest="time_pos", type=int, default=0)
    p.add_argument("-changes", dest="change_log", action="store_true")
    p.add_argument("-w", dest="window_days", type=float, default=0)
    p.add_argument("-d", dest="dynamic", action="store_true")
    p.add_argument("-s", dest="synchronous", action="store_true")
    p.add_argument("-sprev", dest="previous_only", action="store_true")
    p.add_argument("-dt", dest="snapshot_days", type=float, default=0)
    p.add_argument("-de", dest="snapshot_events", type=int, default=0)
    p.add_argument("-dr", dest="rate", type=float, default=0)
    p.add_argument("-c", dest="check", action="store_true")
    p.add_argument("-o", dest="compare", action="store_true")
    p.add_argument("-p", dest="write_properties", action="store_true")
    p.add_argument("-i", dest="sources", type=int, nargs="*", default=[1])
    p.add_argument("-n", dest="top_n", type=int, default=10)
    p.add_argument("-plot", action="store_true", help="write a row for each snapshot (needs -dt or -de)")
    p.add_argument("-plotdt", action="store_true", help="the same for pagerank, with slopes instead of scores")
    p.add_argument("-ia", dest="interest", type=int, nargs="*", default=[], help="vertices to report instead of the top ones")
    p.add_argument("-v", dest="verbose", action="count", default=0)
    return p.parse_args(argv)


def series(g: Graph, program: str, a: argparse.Namespace):
    """The table of a program's results at each snapshot of the log."""
    bounds = g.boundaries()
    if program == "temporal":
        return sinks.reach_table(snapshots.reach_series(g.events, bounds, g.options.sources[0], g.options.window or None))
    counts = snapshots.counts(g.events, bounds)
    if program == "colour":
        return sinks.colour_table(counts, snapshots.stability(snapshots.solve_each(g.events, bounds, groups.colour), "colour"))
    scores = materialise(snapshots.pagerank_series(g.events, bounds, 50), "series")
    if a.interest:
        shown, ids = scores.where(F.col("id").isin(a.interest)), sorted(a.interest)
    else:
        shown = snapshots.waterfall(scores, a.top_n)
        ids = sorted(r["id"] for r in shown.select("id").distinct().collect())  # at most top_n for each snapshot
    if a.plotdt:
        shown = snapshots.derivative(shown, bounds, DAY).withColumnRenamed("slope", "score")
    return sinks.pagerank_table(counts, shown, ids)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(a.verbose, 2)])
    spark = SparkSession.builder.appName("tidegraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.program in ("sort", "shuffle"):
        out = text.sort_lines(spark, a.graph, a.time_pos or 2) if a.program == "sort" else text.shuffle_lines(spark, a.graph)
        out.write.mode("overwrite").text(f"{a.graph}.{'sorted' if a.program == 'sort' else 'shuffled'}")
        return 0
    o = Options(**{k: v for k, v in vars(a).items() if k in Options.__dataclass_fields__})
    if a.plot or a.plotdt:
        if a.program not in ("pagerank", "colour", "temporal"):
            raise ValueError("series are written of pagerank, colour and temporal")
        if not (o.snapshot_days or o.snapshot_events):
            raise ValueError("a series needs -dt or -de")
    if a.program in ("cc", "triangles", "colour"):
        o.undirected = True
    o.time_range = a.program == "temporal"
    g, began = Graph.read(spark, o), time.time()
    solve = {
        "pagerank": lambda: g.pagerank(200, tolerance=1e-9),
        "sssp": lambda: g.sssp({k: 0.0 for k in o.sources}),
        "cc": g.components,
        "triangles": g.triangles,
        "colour": g.colours,
        "temporal": lambda: g.windows(o.sources[0]),
        "stats": g.stats,
    }[a.program]
    steps = {"pagerank": pagerank_step(), "sssp": sssp_step({k: 0.0 for k in o.sources}), "cc": components_step, "colour": colour_step, "triangles": triangles_step, "temporal": temporal_step(o.sources[0], o.window or None)}
    if o.dynamic and a.program in steps:
        live = LiveGraph(spark, {a.program: steps[a.program]})
        live.replay(g.events, g.boundaries() if o.snapshot_days or o.snapshot_events else [])
        result = live.state(a.program)
        snapshots.counts(g.events, g.boundaries()).show(50) if o.snapshot_days or o.snapshot_events else None
        if o.compare:
            value = {"sssp": "distance", "cc": "component", "colour": "colour", "triangles": "triangles"}
            if a.program == "temporal":
                keys = ["id", "start", "end"]
                print(f"differing windows: {result.select(keys).exceptAll(solve().select(keys)).count()}")
            else:
                (overlap_report(result, solve()) if a.program == "pagerank" else compare(result, solve(), value[a.program])).show()
    else:
        result = solve()
    log.info("solved in %.1f s", time.time() - began)
    if o.check:
        bad = {"sssp": lambda: paths.shorter_edges(result, g.edges()), "cc": lambda: groups.split_edges(result, g.edges()), "colour": lambda: groups.colour_violations(result, g.edges(), g.vertices()), "pagerank": lambda: pagerank.mass(result).where("off > 1e-6"), "temporal": lambda: temporal.window_violations(result, topology.range_edges(g.events, o.window or None), o.sources[0])}
        wrong = bad[a.program]().count() if a.program in bad else 0
        print(f"violations: {wrong}")
        if wrong:
            return 1
    if a.plot or a.plotdt:
        sinks.write_table(series(g, a.program, a), sinks.series_name(o.graph, a.program))
    if o.write_properties:
        sinks.write_properties(result, sinks.properties_name(o.graph, o.dynamic))
    if a.program == "pagerank":
        top_n(result, o.top_n).show(o.top_n)
    else:
        result.orderBy(*[F.col(c) for c in result.columns[:1]]).show(o.top_n)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
