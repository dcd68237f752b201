"""Vertex programs as columns: state, messages along edges, a combining aggregate, and a loop until nothing changes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.plans.links import Links
from tidegraph.plans.storage import cut, watched


@dataclass
class VertexProgram:
    """A program over (id, state columns) and edges (src, dst, ...).

    init: vertices -> state. message: what an edge of a changed source carries, over the columns of both. combine: the
    aggregate of the messages of one target. update: new state columns from the old ones and `msg` (null without
    mail). changed: whether the vertex sends in the next round, over the new columns, `old_<column>` and `msg`.
    on_delta: added edges, removed edges, state -> messages (id, msg) that bring a live graph's state up to a batch.
    """

    init: Callable[[DataFrame], DataFrame]
    message: Callable[[], Column]
    combine: Callable[[Column], Column]
    update: Callable[[], dict[str, Column]]
    changed: Callable[[], Column]
    edge_transform: Callable[[DataFrame], DataFrame] | None = None
    on_converged: Callable[[DataFrame], DataFrame | None] | None = None
    finish: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    check: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    on_delta: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None


def run(program: VertexProgram, edges: DataFrame, vertices: DataFrame, max_rounds: int = 10_000, state: DataFrame | None = None, active: DataFrame | None = None, mail: DataFrame | None = None) -> DataFrame:
    """The fixpoint: rounds in which only changed vertices send, each written once; messages combine before the shuffle.

    state and active continue an earlier result: `state` instead of init, sending first from the ids of `active`.
    mail (id, msg) does so too: it is delivered first, and only vertices that it changes send. Edges are dealt by source
    once for all rounds; a round's table is deleted when the next is there. Without a fixpoint after max_rounds it stops
    with an error.
    """
    edges = program.edge_transform(edges) if program.edge_transform else edges
    now = program.init(vertices) if state is None else state
    columns = [c for c in now.columns if c not in ("id", "_active")]
    if active is not None:
        now = now.join(active.select("id", F.lit(True).alias("_a")).distinct(), "id", "left").withColumn("_active", F.col("_a").isNotNull()).drop("_a")
    elif "_active" not in now.columns:
        now = now.withColumn("_active", F.lit(mail is None))
    now = cut(now, watch=_active()) if mail is None else _step(program, now, mail.select("id", F.col("msg").alias("_m")), columns)
    if not watched(now)["active"] and not program.on_converged:
        return program.finish(now.drop("_active"), edges) if program.finish else now.drop("_active")
    links = Links(edges, ["src"])
    try:
        for _ in range(max_rounds):
            sent = links.send(now.where("_active").withColumn("src", F.col("id")), lambda x: x.select(F.col("dst").alias("id"), program.message().alias("_m")))
            now = _step(program, now, sent, columns, now)
            if not watched(now)["active"]:
                more = program.on_converged(now.drop("_active")) if program.on_converged else None
                if more is None or not more.take(1):
                    break
                now = _step(program, now, more.select("id", F.col("msg").alias("_m")), columns, now)
        else:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    finally:
        links.close(keep_table=program.finish is not None)
    out = now.drop("_active")
    return program.finish(out, links.table) if program.finish else out


def _active() -> dict:
    """What a round tells about itself as it is written."""
    return {"active": F.count_if("_active")}


def _step(program: VertexProgram, now: DataFrame, sent: DataFrame, columns: list[str], old: DataFrame | None = None) -> DataFrame:
    mail = sent.groupBy("id").agg(program.combine(F.col("_m")).alias("msg"))
    met = now.drop("_active").join(mail, "id", "left")
    new = met.select("id", "msg", *[F.col(c).alias(f"old_{c}") for c in columns], *[v.alias(c) for c, v in {**{c: F.col(c) for c in columns}, **program.update()}.items()])
    return cut(new.select("id", *columns, (F.col("msg").isNotNull() & program.changed()).alias("_active")), old, _active())
