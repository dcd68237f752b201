"""Connected components, triangles and colouring of the undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.columns import first_unused
from tidegraph.operators.links import components
from tidegraph.operators.topology import neighbours, undirected_pairs
from tidegraph.plans.program import VertexProgram
from tidegraph.plans.links import Links
from tidegraph.plans.storage import cut, drop, watched


def connected_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component): the least id of the weakly connected component."""
    found = components(edges, "src", "dst")
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def least_label_program() -> VertexProgram:
    """The same labels by spreading the least id along undirected edges, as a vertex program."""
    return VertexProgram(
        init=lambda v: v.select("id", F.col("id").alias("label")),
        message=lambda: F.col("label"),
        combine=F.min,
        update=lambda: {"label": F.least("label", "msg")},
        changed=lambda: F.col("label") < F.col("old_label"),
        edge_transform=neighbours,
        on_delta=_labels_over,
    )


def _labels_over(added: DataFrame, removed: DataFrame, state: DataFrame) -> DataFrame:
    if removed.take(1):
        raise ValueError("labels only shrink; recompute after deletions")
    return added.join(state, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), F.col("label").alias("msg"))


def split_edges(result: DataFrame, edges: DataFrame, label: str = "component") -> DataFrame:
    """Edges whose ends have different labels, or none: no rows in a right result."""
    a = result.select(F.col("id").alias("src"), F.col(label).alias("x"))
    b = result.select(F.col("id").alias("dst"), F.col(label).alias("y"))
    return edges.select("src", "dst").join(a, "src", "left").join(b, "dst", "left").where(~F.col("x").eqNullSafe(F.col("y")) | F.col("x").isNull())


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c, leader) of every triangle of distinct vertices, once.

    Repeated edges and self-loops count for nothing. The leader is the stream source of the triangle's last edge to
    arrive, by first arrivals. Edges point from lower to higher degree, which bounds the wedges at a hub.
    """
    pairs = cut(undirected_pairs(edges).select("a", "b", "first_event", "first_src"))
    ends = F.explode(F.array("a", "b"))
    degree = pairs.select(ends.alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    ranked = pairs.join(degree.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(degree.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    forward = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    arcs = cut(ranked.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v"), F.col("first_event").alias("e"), F.col("first_src").alias("s")))
    other = arcs.select("u", F.col("v").alias("w"), F.col("e").alias("e2"), F.col("s").alias("s2"))
    wedges = arcs.join(other, "u").where("v < w")
    closing = pairs.select(F.col("a").alias("v"), F.col("b").alias("w"), F.col("first_event").alias("e3"), F.col("first_src").alias("s3"))
    found = wedges.join(closing, ["v", "w"])
    last = F.greatest("e", "e2", "e3")
    leader = F.when(last == F.col("e"), F.col("s")).when(last == F.col("e2"), F.col("s2")).otherwise(F.col("s3"))
    return found.select(F.least("u", "v", "w").alias("a"), (F.col("u") + F.col("v") + F.col("w") - F.least("u", "v", "w") - F.greatest("u", "v", "w")).alias("b"), F.greatest("u", "v", "w").alias("c"), leader.alias("leader"))


def triangle_leaders(edges: DataFrame) -> DataFrame:
    """(id, triangles): how many triangles each leader closes; vertices without any are left out."""
    return triangles(edges).groupBy(F.col("leader").alias("id")).agg(F.count("*").alias("triangles"))


def closed_triangles(pairs: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id, triangles): the triangles whose last pair to arrive is one of `fresh`, by that pair's stream source.

    Both hold (a, b, first_event, first_src) of distinct undirected pairs. Each fresh pair is widened at its end of
    lower degree, so a hub's neighbours are read only between hubs.
    """
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("w"), F.col("first_event").alias("e2")).union(pairs.select("b", "a", "first_event"))
    degree = both.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("n"))
    ranked = fresh.join(degree.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(degree.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    low = F.col("na") <= F.col("nb")
    arcs = ranked.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v"), F.col("first_event").alias("e"), F.col("first_src").alias("s"))
    wedges = arcs.join(both, "u").where("e2 < e and w <> v").select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b"), "e", "s")
    closing = pairs.select("a", "b", F.col("first_event").alias("e3"))
    return wedges.join(closing, ["a", "b"]).where("e3 < e").groupBy(F.col("s").alias("id")).agg(F.count("*").alias("triangles"))


def colour(edges: DataFrame, vertices: DataFrame, priority: str = "id", max_rounds: int = 10_000, start: DataFrame | None = None) -> DataFrame:
    """(id, colour): each vertex takes the smallest colour that no neighbour of higher priority has.

    In a round all vertices whose higher-priority neighbours have colours take theirs. priority: "id" (smaller first),
    "hash" (by a hash of the id, then id: shorter chains on paths) or "create_event" (needs that column). The result
    does not depend on rounds or partitions. start: colours of an earlier result to keep, where they are not null.
    """
    key = {"id": F.struct("id"), "hash": F.struct(F.xxhash64("id").alias("h"), "id"), "create_event": F.struct("create_event", "id") if "create_event" in vertices.columns else F.struct("id")}[priority]
    rank = vertices.select("id", key.alias("p"))
    pairs = neighbours(edges)
    a, b = rank.select(F.col("id").alias("src"), F.col("p").alias("ps")), rank.select(F.col("id").alias("dst"), F.col("p").alias("pd"))
    before = Links(pairs.join(a, "src").join(b, "dst").where("ps < pd").select("src", "dst"), ["src"])  # src decides first
    waits = before.table.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("waits"))
    none = F.lit(None).cast("int")
    now = vertices.select("id").join(waits, "id", "left").select("id", F.coalesce("waits", F.lit(0)).alias("waits"))
    now = now.join(start, "id", "left").select("id", "waits", F.col("colour").cast("int").alias("colour")) if start is not None else now.withColumn("colour", none)
    now = now.withColumn("colour", F.when(F.col("waits") == 0, F.coalesce("colour", F.lit(0))).otherwise(F.col("colour")))
    now = cut(now.withColumn("used", F.array().cast("array<int>")).withColumn("heard", F.lit(0).cast("long")).withColumn("fresh", F.col("colour").isNotNull()))
    for _ in range(max_rounds):
        sent = before.send(now.where("fresh").select(F.col("id").alias("src"), "colour"), lambda x: x.select(F.col("dst").alias("id"), "colour"))
        said = sent.groupBy("id").agg(F.collect_set("colour").alias("more"), F.count("*").alias("n"))
        met = now.drop("fresh").join(said, "id", "left").withColumns({"used": F.when(F.col("n").isNull(), F.col("used")).otherwise(F.array_union("used", "more")), "heard": F.col("heard") + F.coalesce("n", F.lit(0))})
        ready = F.col("colour").isNull() & (F.col("heard") == F.col("waits"))
        now = cut(met.withColumn("fresh", ready).withColumn("colour", F.when(ready, first_unused(F.col("used"))).otherwise(F.col("colour"))).select("id", "waits", "colour", "used", "heard", "fresh"), now, {"fresh": F.count_if("fresh")})
        if not watched(now)["fresh"]:
            before.close()
            return now.select("id", "colour")
    raise RuntimeError(f"colours: not done after {max_rounds} rounds; priority=\"hash\" needs fewer")


def recolour(edges: DataFrame, vertices: DataFrame, start: DataFrame, dirty: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """What colour() gives by id, from the colours `start` of an earlier graph; dirty: vertices whose smaller neighbours changed.

    Dirty vertices and those without a colour choose again; one that changes makes its larger neighbours dirty. A vertex
    is right once its smaller neighbours are, so the rounds end, and a batch costs what it changes.
    """
    before = cut(neighbours(edges).where("src < dst").select("src", "dst"))  # src decides first
    now = cut(vertices.select("id").join(start.select("id", F.col("colour").cast("int").alias("colour")), "id", "left"))
    todo = cut(dirty.select("id").union(now.where("colour is null").select("id")).distinct())
    for _ in range(max_rounds):
        around = before.join(todo.select(F.col("id").alias("dst")), "dst").join(now.select(F.col("id").alias("src"), "colour"), "src")
        used = around.groupBy(F.col("dst").alias("id")).agg(F.collect_set("colour").alias("used"))
        chosen = todo.join(used, "id", "left").select("id", first_unused(F.coalesce("used", F.array().cast("array<int>"))).alias("new"))
        moved = cut(chosen.join(now, "id").where("colour is null or colour <> new").select("id", "new"), watch={"n": F.count(F.lit(1))})
        if not watched(moved)["n"]:
            drop(before, todo)
            return now
        now = cut(now.join(moved, "id", "left").select("id", F.coalesce("new", "colour").alias("colour")), now)
        todo = cut(before.join(moved.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct(), todo)
        drop(moved)
    raise RuntimeError(f"colours: no fixed point after {max_rounds} rounds")


def colour_violations(result: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices without a colour, neighbours with the same, colours above the number of neighbours; none if right."""
    pairs = neighbours(edges)
    a, b = result.select(F.col("id").alias("src"), F.col("colour").alias("x")), result.select(F.col("id").alias("dst"), F.col("colour").alias("y"))
    same = pairs.join(a, "src").join(b, "dst").where("x = y").select(F.col("src").alias("id"), F.lit("same as a neighbour").alias("what"))
    degree = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    rest = vertices.select("id").join(result, "id", "left").join(degree, "id", "left")
    bad = rest.where("colour is null or colour > coalesce(n, 0)").select("id", F.when(F.col("colour").isNull(), F.lit("no colour")).otherwise(F.lit("colour above degree")).alias("what"))
    return same.union(bad)


def colour_histogram(result: DataFrame) -> DataFrame:
    return result.groupBy("colour").agg(F.count("*").alias("vertices"))
