"""A graph over an event log: the facade that programs and SQL start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.operators import groups, pagerank, paths, snapshots, temporal, topology
from tidegraph.plans.program import VertexProgram, run
from tidegraph.schema import Options
from tidegraph.sources import text


class Graph:
    def __init__(self, events: DataFrame, options: Options | None = None):
        self.events, self.options = events, options or Options()

    @classmethod
    def read(cls, spark: SparkSession, options: Options) -> Graph:
        return cls(text.read_events(spark, options), options)

    def edges(self, at: int | None = None) -> DataFrame:
        """Live edges after event `at` (the whole log if none), with the options' window."""
        log = self.events if at is None else self.events.where(self.events["event_idx"] <= at)
        if self.options.time_range:
            return topology.range_edges(log, self.options.window or None)
        if self.options.window:
            return topology.window_edges(log, self.options.window)
        return topology.live_edges(log)

    def vertices(self, at: int | None = None) -> DataFrame:
        v = topology.vertices(self.events)
        return v if at is None else v.where(v["create_event"] <= at)

    def views(self) -> None:
        """Temporary views graph_events, graph_edges and graph_vertices for SQL."""
        self.events.createOrReplaceTempView("graph_events")
        self.edges().createOrReplaceTempView("graph_edges")
        self.vertices().createOrReplaceTempView("graph_vertices")

    def run(self, program: VertexProgram) -> DataFrame:
        return run(program, self.edges(), self.vertices())

    def stats(self) -> DataFrame:
        return topology.graph_stats(self.edges(), self.vertices())

    def pagerank(self, rounds: int = 50, sources: list | None = None, tolerance: float = 0.0) -> DataFrame:
        return pagerank.pagerank(self.edges(), self.vertices(), rounds, sources=sources, tolerance=tolerance)

    def sssp(self, sources: dict | None = None) -> DataFrame:
        return paths.shortest_paths(self.edges(), self.vertices(), sources or {k: 0.0 for k in self.options.sources})

    def components(self) -> DataFrame:
        return groups.connected_components(self.edges(), self.vertices())

    def triangles(self) -> DataFrame:
        return groups.triangle_leaders(self.edges())

    def colours(self, priority: str = "id") -> DataFrame:
        return groups.colour(self.edges(), self.vertices(), priority)

    def windows(self, source, extend: bool = True) -> DataFrame:
        edges = topology.range_edges(self.events, self.options.window or None)
        return temporal.reachable_windows(edges, source) if extend else temporal.capped_windows(edges, source)

    def boundaries(self) -> list[tuple[int, int]]:
        if self.options.snapshot_events:
            return snapshots.every_events(self.events, self.options.snapshot_events)
        return snapshots.ratchet(self.events, self.options.snapshot_interval)

    def snapshot_counts(self) -> DataFrame:
        return snapshots.counts(self.events, self.boundaries())
