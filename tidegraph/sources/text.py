"""Edge lists and change logs as text, event lists from code, any DataFrame; and tools for whole files of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.order import in_order, in_scan_order
from tidegraph.schema import ADD, DELETE, EVENTS, Options

_BLANK = "[\\t\\n\\x0B\\f\\r ]+"
DEFAULT_WEIGHT = 1.0


def fields(line: Column) -> Column:
    """The words of a line between runs of ASCII white space; none for a blank line."""
    return F.filter(F.split(line, _BLANK), lambda x: x != "")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no): lines that are neither comments (first character #) nor blank, numbered in file order."""
    text = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length(F.regexp_replace("value", _BLANK, "")) > 0))
    return in_scan_order(text, "line_no")


def _id(part: Column) -> Column:
    """An id must be digits; anything else stops the run instead of becoming some number."""
    bad = F.concat(F.lit("not a vertex id: "), F.coalesce(part, F.lit("(missing)")))
    return F.when(part.rlike("^[0-9]{1,18}$"), part.cast("long")).otherwise(F.raise_error(bad).cast("long"))


def _property(parts: Column, position: int, kind: str) -> Column:
    return F.get(parts, F.lit(position - 1)).try_cast(kind)


def read_events(spark: SparkSession, options: Options) -> DataFrame:
    """Events of the text at options.graph: `src dst [fields]` lines, or `a|d src dst [fields]` in a change log.

    A missing or unreadable weight is 1, a missing time is null. Transposition swaps the ends first; an undirected
    graph mirrors each event right after it; logical time is the event's index.
    """
    rows = lines(spark, options.graph).select("line_no", fields(F.col("value")).alias("p"))
    if options.change_log:
        kind = F.when(F.get("p", F.lit(0)) == "a", ADD).when(F.get("p", F.lit(0)) == "d", DELETE).otherwise(F.raise_error(F.concat(F.lit("not a change: "), F.get("p", F.lit(0)))))
        rows = rows.select("line_no", kind.alias("type"), F.slice("p", 2, 5).alias("p"))
    else:
        rows = rows.withColumn("type", F.lit(ADD))
    rest = F.slice("p", 3, 3)  # at most five fields a line
    weight = F.coalesce(_property(rest, options.weight_pos, "float").cast("double") if options.weight_pos else F.lit(None), F.lit(DEFAULT_WEIGHT))
    ts = _property(rest, options.time_pos, "long") if options.time_pos else F.lit(None).cast("long")
    events = rows.select(F.col("line_no").alias("event_idx"), "type", _id(F.get("p", F.lit(0))).alias("src"), _id(F.get("p", F.lit(1))).alias("dst"), weight.cast("double").alias("weight"), ts.alias("ts"))
    return arrange(events, options)


def arrange(events: DataFrame, options: Options) -> DataFrame:
    """Apply transposition, mirroring and logical time to an indexed event log."""
    if options.transpose:
        events = transpose(events)
    if options.undirected:
        events = mirror(events)
    if options.logical_time:
        events = events.withColumn("ts", F.col("event_idx"))
    return events


def transpose(events: DataFrame) -> DataFrame:
    return events.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def mirror(events: DataFrame) -> DataFrame:
    """Every event twice: as it is with the even index, and from dst to src with the odd one after it."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.lit(1).alias("k"), F.col("dst").alias("a"), F.col("src").alias("b"))))
    wide = events.withColumn("_m", both)
    return wide.withColumns({"event_idx": F.col("event_idx") * 2 + F.col("_m.k"), "src": F.col("_m.a"), "dst": F.col("_m.b")}).drop("_m")


def events_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Events from code: (type, src, dst[, weight[, ts]]) in stream order."""
    full = [(k, r[0], r[1], r[2], float(r[3]) if len(r) > 3 and r[3] is not None else DEFAULT_WEIGHT, r[4] if len(r) > 4 else None) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, EVENTS)


def from_frame(df: DataFrame, src: str, dst: str, order: str, weight: str | None = None, ts: str | None = None, kind: str | None = None) -> DataFrame:
    """Events from any DataFrame with an integer column that gives their order (of equal ones the other columns); ids may be strings."""
    rows = in_order(df.select(*dict.fromkeys(c for c in (order, src, dst, weight, ts, kind) if c)), order)
    return rows.select(
        "event_idx",
        (F.col(kind) if kind else F.lit(ADD)).alias("type"),
        F.col(src).alias("src"),
        F.col(dst).alias("dst"),
        F.coalesce(F.col(weight).cast("double") if weight else F.lit(None), F.lit(DEFAULT_WEIGHT)).alias("weight"),
        (F.col(ts).cast("long") if ts else F.lit(None).cast("long")).alias("ts"),
    )


def shuffle_lines(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """The lines of a file in a random order that the seed fixes."""
    return lines(spark, path).orderBy(F.xxhash64(F.lit(seed), "line_no"), "line_no").select("value")


def sort_lines(spark: SparkSession, path: str, position: int = 2, as_text: bool = False) -> DataFrame:
    """The lines of a file by the field at `position` (from 0), equal ones in file order; numbers unless as_text."""
    key = F.get(fields(F.col("value")), F.lit(position))
    return lines(spark, path).withColumn("_k", key if as_text else key.try_cast("long")).orderBy("_k", "line_no").select("value")
