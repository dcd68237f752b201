"""Global order without a global window: positions and neighbours in two levels of buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.plans.storage import cut

#: Key range of one bucket, which is sorted in one task, and of how many buckets a stretch consists.
WIDTH, STRETCH = 1 << 16, 1 << 12


def in_order(df: DataFrame, key: str, lead: tuple[str, ...] = (), width: int = WIDTH, out: str = "event_idx") -> DataFrame:
    """Add `out`, the 0-based position by the integer column `key`, and next_<c> for each c of `lead`.

    Rows with the same key stand in the order of their other columns, so every reading of `df` gives the same positions.
    Rows meet in buckets of `width` keys, bucket sizes and first rows in stretches of STRETCH buckets, and only one row
    for each stretch (WIDTH * STRETCH keys) is ordered as a whole.
    """
    rows = df.withColumn("_bucket", F.floor(F.col(key) / width))
    by = [key, *[c for c in df.columns if c != key]]
    inside = Window.partitionBy("_bucket").orderBy(*by)
    near, across = Window.partitionBy("_s").orderBy("_b"), Window.orderBy("_s")
    first = [F.min_by(c, F.struct(*by)).alias(f"_first_{c}") for c in lead]
    buckets = rows.groupBy(F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"), *first).withColumn("_s", F.floor(F.col("_b") / STRETCH))
    stretches = buckets.groupBy("_s").agg(F.sum("_n").alias("_all"), *[F.min_by(f"_first_{c}", "_b").alias(f"_head_{c}") for c in lead])
    stretches = stretches.select("_s", F.coalesce(F.sum("_all").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), *[F.lead(f"_head_{c}").over(across).alias(f"_past_{c}") for c in lead])
    buckets = buckets.withColumn("_in", F.coalesce(F.sum("_n").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumns({"_end": F.lead(F.lit(1)).over(near).isNull(), **{f"_next_{c}": F.lead(f"_first_{c}").over(near) for c in lead}})
    buckets = buckets.join(stretches, "_s").select("_b", (F.col("_base") + F.col("_in")).alias("_before"), *[F.when(F.col("_end"), F.col(f"_past_{c}")).otherwise(F.col(f"_next_{c}")).alias(f"_after_{c}") for c in lead])
    placed = rows.withColumn("_row", F.row_number().over(inside)).withColumns({f"next_{c}": F.lead(c).over(inside) for c in lead})
    last = F.lead(F.lit(1)).over(inside).isNull()
    placed = placed.withColumn("_last", last).join(buckets, F.col("_bucket") == F.col("_b"))
    nexts = {f"next_{c}": F.when(F.col("_last"), F.col(f"_after_{c}")).otherwise(F.col(f"next_{c}")) for c in lead}
    return placed.withColumn(out, F.col("_row") - 1 + F.col("_before")).withColumns(nexts).select(*df.columns, out, *[f"next_{c}" for c in lead])


def in_order_within(df: DataFrame, by: str, key: str, width: int = WIDTH, out: str = "pos") -> DataFrame:
    """Add `out`, the 0-based position by the unique integer column `key` among the rows with the same `by`.

    Rows meet in buckets of `width` keys, so a value of `by` that holds a third of all rows is still ranked by many tasks.
    """
    rows = df.withColumn("_bucket", F.floor(F.col(key) / width))
    upto = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(by, "_bucket", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_row", F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(key)))
    return placed.join(before, [by, "_bucket"]).select(*df.columns, (F.col("_row") - 1 + F.col("_before")).alias(out))


def in_sorted_order(df: DataFrame, *by: str | Column, out: str = "pos") -> DataFrame:
    """Add the 0-based position in the order `by`, which leaves no ties: range partitions are sorted, then numbered.

    Each row is written with the number of its partition: files are read back by size, not in the order they were written.
    """
    return _numbered(cut(df.orderBy(*by).withColumn("_id", F.monotonically_increasing_id())), df.columns, out)


def in_scan_order(df: DataFrame, out: str = "event_idx") -> DataFrame:
    """Add the 0-based position in scan order (partition, then row). `df` must give the same rows on every reading."""
    return _numbered(df.withColumn("_id", F.monotonically_increasing_id()), df.columns, out)


def _numbered(rows: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Positions from _id, which holds a partition's number above 33 bits for the row in it."""
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("_p", before.alias("_before")))  # one row per partition
    low = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(sizes, part == F.col("_p")).withColumn(out, low + F.col("_before")).select(*columns, out)


def slot_of(value: Column, bounds: list[int]) -> Column:
    """Number of bounds below the value: the first slot whose bound is not below it. `bounds` ascend."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < value))
