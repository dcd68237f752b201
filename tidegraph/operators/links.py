"""Connected components of an edge list of any size, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.plans.storage import cut, materialise, watched


#: Edges that one task could hold, so hubs are not looked for: that would cost more than it gains. Results are the same.
SMALL = 1 << 20


def _hung(rows: DataFrame, limit: int | None) -> DataFrame:
    """(u, v, m): rows (u, v) with the least v of their u. The few u with more than `limit` rows meet theirs by broadcast."""
    if limit is None:
        return rows.join(rows.groupBy("u").agg(F.min("v").alias("m")), "u")
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    heavy = F.broadcast(least.where(F.col("_n") > limit).drop("_n"))
    light = rows.join(heavy, "u", "left_anti").join(least.where(F.col("_n") <= limit).drop("_n"), "u")
    return light.unionByName(rows.join(heavy, "u"))


def _stars(edges: DataFrame, large: bool, limit: int | None) -> DataFrame:
    """One star step on edges u > v. large: every neighbour above u is hung on u's least neighbour; small: those below."""
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = _hung(around, limit).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        return hung.filter("u > v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("v"))
    return _hung(edges, limit).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """(id, component): the least id reachable from every id that an edge names.

    Large-star and small-star steps alternate until no edge changes, which takes a number of rounds
    logarithmic in the longest path. A step moves (id, id) pairs only; minima are pre-aggregated before the
    shuffle, and past SMALL edges a node with more than a quarter of a partition's share of all edges meets its minimum by broadcast
    (such nodes number eight times the partitions at most), so no task holds all links of a hub. Self-loops keep a lone
    id in the result; null ends are dropped. Each round is written once to the shared folder.
    """
    parts = 4 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    ends = materialise(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", {"n": F.count_if(F.col("u") > F.col("v"))})
    now, n = ends.where("u > v"), watched(ends)["n"]
    before = None
    for _ in range(max_rounds):
        limit = n // parts + 1 if n > SMALL else None
        now = cut(_stars(_stars(now, True, limit), False, limit), now, {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("u", "v"))})
        mark = watched(now)
        n = mark["n"]
        if mark == before or not n:
            break
        before = mark
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    ids = ends.select(F.col("u").alias("id")).union(ends.select(F.col("v").alias("id"))).distinct()
    return ids.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
