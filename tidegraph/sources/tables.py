"""Edge streams derived from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.order import in_order
from tidegraph.schema import ADD

#: Keeps the ids of the second kind of vertex apart from the first.
OFFSET = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each event's user to the next event's user; weight is the value, ts the time in microseconds."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("src"), F.col("value").alias("weight"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    linked = in_order(rows, "event_id", lead=("src",)).where("next_src is not null")
    return linked.select("event_idx", F.lit(ADD).alias("type"), "src", F.col("next_src").alias("dst"), "weight", "ts")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _ranked(rows: DataFrame) -> DataFrame:
    """Index lines by (l_orderkey, l_linenumber), equal ones by their other columns: the key joins both, as a line number is below 1024."""
    return in_order(rows.withColumn("_key", F.col("l_orderkey") * 1024 + F.col("l_linenumber")), "_key")


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(_items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return rows.select("event_idx", F.lit(ADD).alias("type"), F.col("l_partkey").alias("src"), (F.col("l_suppkey") + OFFSET).alias("dst"), F.col("l_quantity").alias("weight"), F.col("event_idx").alias("ts"))


def customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From customers to suppliers, which have no edges of their own."""
    rows = _ranked(_items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return rows.join(orders, "l_orderkey").select("event_idx", F.lit(ADD).alias("type"), F.col("o_custkey").alias("src"), (F.col("l_suppkey") + OFFSET).alias("dst"), F.col("l_quantity").alias("weight"), F.col("event_idx").alias("ts"))


def part_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From parts to customers, for lines of quantity 50: many small components."""
    rows = _ranked(_items(spark, sf_dir).where("l_quantity = 50").select("l_orderkey", "l_linenumber", "l_partkey"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return rows.join(orders, "l_orderkey").select("event_idx", F.lit(ADD).alias("type"), (F.col("l_partkey") + OFFSET).alias("src"), F.col("o_custkey").alias("dst"), F.lit(1.0).alias("weight"), F.col("event_idx").alias("ts"))


def with_deletes(events: DataFrame, every: int = 5) -> DataFrame:
    """After each `every`-th ADD of a pair, in stream order, delete that pair once. Indices are doubled to make room."""
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("src", "dst").orderBy("event_idx"))
    adds = events.withColumn("_nth", nth).withColumn("event_idx", F.col("event_idx") * 2)
    dels = adds.where(F.col("_nth") % every == 0).withColumns({"event_idx": F.col("event_idx") + 1, "type": F.lit("DEL")})
    return adds.unionByName(dels).drop("_nth")
