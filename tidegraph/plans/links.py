"""Edges that many rounds read: shuffled by source once and kept there."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.plans.storage import cut, drop, shared_path, watched


#: Edges that are read as they were written, as dealing them would cost more than the rounds gain. Results are the same.
SMALL = 1 << 20


class Links:
    """Edges by their `keys` (a source, or a graph's id and a source), for the rounds of one computation.

    They are written to the shared folder as a table of as many buckets as a shuffle has partitions, so a round shuffles
    what it sends and the state, not the edges. A key with more than a quarter of a bucket's share of all edges would
    make one task long; such keys number four times the buckets at most, their edges stay in a plain table that is split
    anywhere, and the few rows of state that they need are broadcast.
    """

    def __init__(self, edges: DataFrame, keys: list[str]):
        spark = edges.sparkSession
        self.keys, self.name, self.hot = keys, None, None
        self.light = self.table = cut(edges, watch={"n": F.count(F.lit(1))})
        n = watched(self.table)["n"]
        if n <= SMALL:
            return
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sizes = self.table.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > n // (4 * width) + 1).select(*keys)
        heavy = sizes.collect()  # fewer than four times the buckets
        if heavy:
            self.heavy = spark.createDataFrame(heavy, sizes.schema)
            self.light = self.table.join(F.broadcast(self.heavy), keys, "left_anti")
            self.hot = cut(self.table.join(F.broadcast(self.heavy), keys, "left_semi"))
        self.name = f"tidegraph_links_{uuid.uuid4().hex}"
        self.light.repartition(width, *keys).write.format("parquet").option("path", shared_path(spark, "links")).bucketBy(width, *keys).saveAsTable(self.name)
        self.light = spark.table(self.name)

    def send(self, state: DataFrame, mail: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """`mail` of the rows of `state` (with the key columns) joined with their edges."""
        parts = [mail(state.join(self.light, self.keys))]
        if self.hot is not None:
            few = state.join(F.broadcast(self.heavy), self.keys, "left_semi")
            parts.append(mail(self.hot.join(F.broadcast(few), self.keys)))
        return reduce(DataFrame.union, parts)

    def close(self, keep_table: bool = False) -> None:
        """Drop the tables; the files of the buckets go when the application ends."""
        if self.name:
            self.table.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop(self.hot, None if keep_table else self.table)
