"""Shortest paths from one or more sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.plans.program import VertexProgram, run


def shortest_program(sources: dict, weighted: bool = True) -> VertexProgram:
    """Least distance from `sources` (id -> initial value); null while unreached. Negative cycles never settle."""

    def init(vertices: DataFrame) -> DataFrame:
        distance = F.lit(None).cast("double")
        for k, v in sources.items():
            distance = F.when(F.col("id") == k, float(v)).otherwise(distance)
        return vertices.select("id", distance.alias("distance")).withColumn("_active", F.col("distance").isNotNull())

    return VertexProgram(
        init=init,
        message=lambda: F.col("distance") + (F.coalesce(F.col("weight"), F.lit(1.0)) if weighted else F.lit(1.0)),
        combine=F.min,
        update=lambda: {"distance": F.least("distance", "msg")},
        changed=lambda: F.col("old_distance").isNull() | (F.col("distance") < F.col("old_distance")),
        check=lambda result, edges: shorter_edges(result, edges, weighted),
    )


def shortest_paths(edges: DataFrame, vertices: DataFrame, sources: dict, weighted: bool = True) -> DataFrame:
    """(id, distance) of all vertices; unreached ones are null. Of parallel edges the lightest counts."""
    light = edges.groupBy("src", "dst").agg(F.min(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    return run(shortest_program(sources, weighted), light, vertices)


def shorter_edges(result: DataFrame, edges: DataFrame, weighted: bool = True, within: float = 1e-9) -> DataFrame:
    """Edges along which a distance could still fall: none in a right result."""
    w = F.coalesce(F.col("weight"), F.lit(1.0)) if weighted else F.lit(1.0)
    a = result.select(F.col("id").alias("src"), F.col("distance").alias("d_src"))
    b = result.select(F.col("id").alias("dst"), F.col("distance").alias("d_dst"))
    return edges.join(a, "src").join(b, "dst").where(F.col("d_src").isNotNull() & (F.col("d_dst").isNull() | (F.col("d_dst") > F.col("d_src") + w + within)))


def distance_report(result: DataFrame) -> DataFrame:
    """One row: vertices, those reached and their percentage, the highest distance."""
    seen = F.count("distance")
    return result.agg(F.count("*").alias("vertices"), seen.alias("visited"), F.round(F.lit(100.0) * seen / F.count("*"), 4).alias("visited_pct"), F.round(F.max("distance"), 4).alias("max_distance"))
