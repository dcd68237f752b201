"""Results as files."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.columns import day


def properties_name(graph: str, dynamic: bool) -> str:
    return f"results/{PurePath(graph).stem}-props-{'dynamic' if dynamic else 'static'}.txt"


def series_name(graph: str, program: str) -> str:
    return f"results/{PurePath(graph).stem}-{program}-series"


def write_properties(result: DataFrame, path: str) -> None:
    """Lines `id,property`, one part file per partition."""
    result.write.mode("overwrite").option("nullValue", "").csv(path)


def pagerank_table(snapshots: DataFrame, series: DataFrame, ids: list, unit: int = 1) -> DataFrame:
    """A row per snapshot: ts, date, vertices, edges and one column for each id; `unit` ticks make a second."""
    wide = series.groupBy("snapshot_id").pivot("id", ids).agg(F.first("score"))
    seconds = F.floor(F.col("at_ts") / unit)
    head = snapshots.select("snapshot_id", seconds.alias("ts"), day(seconds).alias("date"), F.col("vertex_count").alias("v"), F.col("edge_count").alias("e"))
    return head.join(wide, "snapshot_id", "left").orderBy("snapshot_id").drop("snapshot_id")


def colour_table(snapshots: DataFrame, stable: DataFrame, unit: int = 1) -> DataFrame:
    """A row per snapshot: ts, date, vertices, edges, share of kept colours and the number of colours."""
    seconds = F.floor(F.col("at_ts") / unit)
    rows = snapshots.join(stable, "snapshot_id", "left").orderBy("snapshot_id")
    return rows.select(seconds.alias("ts"), day(seconds).alias("date"), F.col("vertex_count").alias("realVC"), F.col("edge_count").alias("EC"), F.col("pct_same").alias("pctSame"), F.col("matched").alias("matchedVertices"), "same", "different", F.col("distinct_values").alias("colourCount"))


def reach_table(series: DataFrame, unit: int = 1) -> DataFrame:
    """A row per snapshot of a reach series: ts, date, active and all vertices, live, ended and all edges, then the shares."""
    seconds = F.floor(F.col("at_ts") / unit)
    head = [seconds.alias("ts"), day(seconds).alias("date"), F.col("active").alias("av"), F.col("vertices").alias("v"), (F.col("edges") - F.col("ended")).alias("ae"), F.col("ended").alias("de"), F.col("edges").alias("te")]
    rest = [F.col("max_windows").alias("maxWC"), F.col("could").alias("MaxReach"), F.col("median_windows").alias("medianWC"), F.col("still_pct").alias("PctOfCouldStillCan"), F.col("could_pct").alias("PctCould")]
    return series.orderBy("snapshot_id").select(*head, *rest)


def comparison_table(reports: list[DataFrame]) -> DataFrame:
    """Oracle comparisons one below the other: AvgL1, P95L1, 1000.RBO6, 10.RBO5."""
    out = reports[0]
    for r in reports[1:]:
        out = out.union(r)
    return out.select(F.col("avg_l1").alias("AvgL1"), F.col("p95_l1").alias("P95L1"), F.col("rbo6_1000").alias("1000.RBO6"), F.col("rbo5_10").alias("10.RBO5"))


def write_table(rows: DataFrame, path: str) -> None:
    """One CSV file with a header: a row for each snapshot, so one task writes it."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
