"""Helpers shared by the training-data operators: table access, shared storage, slicing of Arrow batches by size."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.plans.storage import materialise  # noqa: F401  (re-exported for the operators)

#: Text bytes that one numpy step works on; bounds the memory of a Python worker whatever an Arrow batch holds.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into consecutive runs of rows with about `limit` text bytes (one longer row stands alone)."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand Python about SLICE_BYTES at once.

    Spark's own limit is 64 MB for each task, held by a worker and by the JVM outside its heap, there up to three
    times while a vector doubles. Results are the same; the session's limit returns at the end.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, SLICE_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def raw_texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null reads as empty."""
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]


def map_rows(df: DataFrame, columns: list[str], schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | dict]) -> DataFrame:
    """Row-wise operator: `work` turns each slice into the columns of `schema`. No shuffle; whole texts."""

    def run(batches):
        out = None
        for batch in batches:
            for part in slices(batch):
                got = work(part)
                yield got if isinstance(got, pa.RecordBatch) else pa.RecordBatch.from_pydict(got)
                out = True
        return out

    return df.select(*columns).mapInArrow(run, schema)


def keep_rows(df: DataFrame, work: Callable[[pa.RecordBatch], list[bool] | np.ndarray], text: str = "text") -> DataFrame:
    """Filter whole rows by a vectorised test of their texts; every column passes through."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(np.asarray(work(part), dtype=bool)))

    return df.mapInArrow(run, df.schema)


def id_crc32(doc_id: int | None) -> int:
    """crc32 of the id as decimal text; a null id reads as the empty string."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def crc_mod(column: str, n: int):
    """The same remainder as a Column."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_part))


def bounded_sample(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """The `rows` rows with the smallest hash of `key`: the same rows on every run, at most `rows` of them."""
    return df.orderBy(F.xxhash64(F.lit("sample"), F.col(key)), F.col(key)).limit(rows)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
