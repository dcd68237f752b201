"""Live graphs: event batches update versioned state, and incremental programs follow.

A batch is appended to the log, then each program takes the batch's edges and its own last state to a new one. State
is a Parquet version per batch in the shared folder; a batch that a restart repeats writes its version again. The same
code drives Structured Streaming (foreachBatch) and the replay of a static log.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import groups
from tidegraph.operators.links import components
from tidegraph.operators.pagerank import pagerank_from
from tidegraph.operators.paths import shortest_program
from tidegraph.operators.temporal import reachable_windows
from tidegraph.operators.topology import live_edges, range_edges, undirected_pairs, vertices
from tidegraph.plans.program import VertexProgram, run
from tidegraph.plans.storage import cut, shared_path
from tidegraph.schema import ADD, DELETE, EVENTS

#: (log so far with the batch, batch, last state or None) -> new state
Step = Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame]


def _no_deletes(batch: DataFrame) -> None:
    if batch.where(F.col("type") == DELETE).take(1):
        raise ValueError("this program only grows; recompute after deletions")


def sssp_step(sources: dict) -> Step:
    """Distances after each batch: only vertices at the batch's edges send first."""

    def step(log: DataFrame, batch: DataFrame, before: DataFrame | None) -> DataFrame:
        _no_deletes(batch)
        program = shortest_program(sources)
        light = log.groupBy("src", "dst").agg(F.min(F.coalesce("weight", F.lit(1.0))).alias("weight"))
        fresh = program.init(vertices(log)).select("id", "distance")
        if before is None:
            return run(program, light, vertices(log))
        state = fresh.join(before.select("id", F.col("distance").alias("known")), "id", "left").select("id", F.coalesce("known", "distance").alias("distance"))
        return run(program, light, vertices(log), state=state, active=batch.select(F.col("src").alias("id")))

    return step


def components_step(log: DataFrame, batch: DataFrame, before: DataFrame | None) -> DataFrame:
    """Components after each batch: the batch's edges join old labels, and only the graph of labels is searched."""
    _no_deletes(batch)
    ends = batch.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    labels = ends.withColumn("component", F.col("id"))
    if before is not None:
        labels = before.unionByName(ends.join(before, "id", "left_anti").withColumn("component", F.col("id")))
    of = lambda c, n: labels.select(F.col("id").alias(c), F.col("component").alias(n))
    joined = components(batch.join(of("src", "a"), "src").join(of("dst", "b"), "dst").select("a", "b"), "a", "b")
    moved = joined.select(F.col("id").alias("component"), F.col("component").alias("to"))
    return labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))


def pagerank_step(epsilon: float = 1e-9) -> Step:
    """Scores after each batch, from the last ones by residuals; deletions are edges that are gone."""
    return lambda log, batch, before: pagerank_from(live_edges(log), vertices(log), before, epsilon)


def colour_step(log: DataFrame, batch: DataFrame, before: DataFrame | None) -> DataFrame:
    """Colours by id after each batch, deletions included: the larger end of each changed edge chooses first."""
    edges, ids = live_edges(log), vertices(log)
    if before is None:
        return groups.colour(edges, ids)
    return groups.recolour(edges, ids, before, batch.where("src <> dst").select(F.greatest("src", "dst").alias("id")).distinct())


def triangles_step(log: DataFrame, batch: DataFrame, before: DataFrame | None) -> DataFrame:
    """(id, triangles) by leader after each batch: a new triangle's last pair is new, so only new pairs are searched from."""
    _no_deletes(batch)
    pairs = cut(undirected_pairs(log).select("a", "b", "first_event", "first_src"))
    first = batch.agg(F.min("event_idx").alias("_lo"))
    found = groups.closed_triangles(pairs, pairs.join(F.broadcast(first), F.col("first_event") >= F.col("_lo")).drop("_lo"))
    return found if before is None else before.unionByName(found).groupBy("id").agg(F.sum("triangles").alias("triangles"))


def temporal_step(source, window: int | None = None) -> Step:
    """Windows of reachability after each batch, solved anew: a deletion can close any window that was open."""
    return lambda log, batch, before: reachable_windows(range_edges(log, window), source)


def program_step(program: VertexProgram) -> Step:
    """Any vertex program: with on_delta its state goes on from the messages of a batch, without it is solved anew.

    The state is the program's own; finish is left to the reader.
    """
    program = replace(program, finish=None)
    shaped = program.edge_transform or (lambda edges: edges)

    def step(log: DataFrame, batch: DataFrame, before: DataFrame | None) -> DataFrame:
        edges, ids = live_edges(log), vertices(log)
        if before is None or program.on_delta is None:
            return run(program, edges, ids)
        state = before.unionByName(program.init(ids).join(before, "id", "left_anti").select(before.columns))
        added, removed = (shaped(batch.where(F.col("type") == kind)) for kind in (ADD, DELETE))
        return run(program, edges, ids, state=state, mail=program.on_delta(added, removed, state))

    return step


class LiveGraph:
    """The log of a live graph and the state of its programs, by batch."""

    def __init__(self, spark: SparkSession, steps: dict[str, Step], path: str | None = None):
        self.spark, self.steps = spark, steps
        self.path = path or shared_path(spark, "live")
        self.versions: dict[str, str] = {}
        self.batches: dict[int, str] = {}
        self.metrics: list[dict] = []
        self.resume()

    def log(self) -> DataFrame:
        paths = [p for _, p in sorted(self.batches.items())]
        return self.spark.read.schema(EVENTS).parquet(*paths) if paths else self.spark.createDataFrame([], EVENTS)

    def state(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(self.versions[name]) if name in self.versions else None

    def _marks(self):
        jvm = self.spark.sparkContext._jvm
        return jvm, jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def resume(self) -> None:
        """Take up after the last batch whose mark was written, if the path holds one."""
        jvm, fs = self._marks()
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/marks")):
            marks = [json.loads(r[0]) for r in self.spark.read.text(f"{self.path}/marks").collect()]  # a line for each batch
            for m in sorted(marks, key=lambda m: m["batch"]):
                self.batches[m["batch"]] = m["log"]
                self.versions.update(m["versions"])

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Append a batch and bring every program up to it; a batch that is known already changes nothing."""
        if batch_id in self.batches:
            return
        began = time.time()
        at = f"{self.path}/events/{batch_id}"
        batch.select(*[F.col(f.name).cast(f.dataType) for f in EVENTS.fields]).write.mode("overwrite").parquet(at)
        rows = self.spark.read.schema(EVENTS).parquet(at)
        self.batches[batch_id] = at
        new = {}
        if rows.take(1):
            for name, step in self.steps.items():
                to = f"{self.path}/{name}/{batch_id}"
                step(self.log(), rows, self.state(name)).write.mode("overwrite").parquet(to)
                new[name] = to
        self.versions.update(new)
        mark = json.dumps({"batch": batch_id, "log": at, "versions": self.versions})
        self.spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/marks")
        took = time.time() - began
        self.metrics.append({"batch": batch_id, "events": (n := rows.count()), "latency_ms": int(1000 * took), "events_per_second": n / max(took, 1e-9)})

    def follow(self, stream: DataFrame, checkpoint: str | None = None, **trigger):
        """Start a streaming query over an event stream; trigger as for writeStream.trigger."""
        writer = stream.writeStream.foreachBatch(lambda df, k: self.process(df, int(k))).option("checkpointLocation", checkpoint or f"{self.path}/progress")
        return (writer.trigger(**trigger) if trigger else writer).start()

    def replay(self, events: DataFrame, bounds: list[tuple[int, int]]) -> None:
        """Feed a static log in slices that end at the boundaries (and one for the rest)."""
        last = -1
        for k, at in enumerate([e for e, _ in bounds] + [None]):
            piece = events.where(F.col("event_idx") > last)
            self.process(piece if at is None else piece.where(F.col("event_idx") <= at), k)
            last = at


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Event files that appear under a path; files_per_batch limits the rate."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def counts_stream(events: DataFrame, seconds: str = "1 day", late: str = "1 day") -> DataFrame:
    """Additions and deletions by window of event time; rows later than `late` are dropped."""
    timed = events.withColumn("time", F.timestamp_seconds("ts")).withWatermark("time", late)
    return timed.groupBy(F.window("time", seconds)).agg(F.count_if(F.col("type") == "ADD").alias("adds"), F.count_if(F.col("type") == "DEL").alias("deletes"))
