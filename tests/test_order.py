"""Positions that do not depend on how rows are stored, and boundaries of any number."""

import random

from pyspark.sql import functions as F

from tidegraph import catalogue
from tidegraph.functions.order import in_sorted_order
from tidegraph.operators import snapshots
from tidegraph.sources import tables


def test_equal_keys_have_one_order(spark, tmp_path):
    """Lines of one order with the same number: however the rows are stored, each line keeps its position."""
    rnd, got = random.Random(5), []
    lines = [(k // 6, k, k % 7, 1, 50.0) for k in range(240)]
    spark.createDataFrame([(k, k) for k in range(40)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/0/orders.parquet")
    for k in range(2):
        rnd.shuffle(lines)
        spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        if k:
            spark.read.parquet(f"{tmp_path}/0/orders.parquet").write.parquet(f"{tmp_path}/1/orders.parquet")
        got.append([tuple(r) for r in tables.part_customer(spark, f"{tmp_path}/{k}").orderBy("event_idx").collect()])
    assert got[0] == got[1] and [r[0] for r in got[0]] == list(range(240))


def test_sorted_positions_of_uneven_files(spark, tmp_path):
    """The parts of a sort differ in size: a later, larger file is read before an earlier one."""
    rows = spark.range(30_000).select(F.col("id").alias("event_id"), F.timestamp_micros("id").alias("ts"), (F.col("id") % 9).alias("user_id"), F.when(F.col("id") % 100 > 0, F.floor(F.sqrt("id")).cast("double")).alias("value"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    shown = sorted(((k % 100 == 0, float(int(k**0.5)) if k % 100 else 0.0, k) for k in range(29_999)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or one small partition holds all rows
    try:
        got = catalogue.sort_events(spark, str(tmp_path)).orderBy("pos").collect()
        uneven = spark.range(0, 4000, 1, 4).select((F.col("id") % 1000).alias("x"), F.col("id").alias("y"), F.repeat(F.lit("z"), (F.col("id") % 1000).cast("int")).alias("z"))
        few = in_sorted_order(uneven, "x", "y").orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [r["event_idx"] for r in got] == [k for _, _, k in shown] and [r["pos"] for r in got] == list(range(29_999))
    assert [(r["x"], r["y"], r["pos"]) for r in few] == [(k // 4, k // 4 + 1000 * (k % 4), k) for k in range(4000)]


def test_any_number_of_boundaries(spark):
    log = spark.range(30_001).select(F.col("id").alias("event_idx"), (F.col("id") * 3).alias("ts"))
    got = snapshots.every_events_frame(log, 2).orderBy("snapshot_id").collect()
    assert [tuple(r) for r in got] == [(k, 2 * k + 1, 6 * k + 3) for k in range(15_000)]
    some = log.where("event_idx < 100")
    assert [tuple(r)[1:] for r in snapshots.every_events_frame(some, 7).orderBy("snapshot_id").collect()] == snapshots.every_events(some, 7)
