"""Cutting lineage through the storage that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the context's. Without either, one process may use a temporary one; a cluster may not."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidegraph-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str = "t") -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/tidegraph/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def materialise(df: DataFrame, name: str = "t", watch: dict[str, Column] | None = None) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and return a scan of it: short lineage that survives lost executors.

    watch: aggregates that are taken while writing; `watched` gives their values.
    """
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, name)
    seen = Observation() if watch else None
    (df.observe(seen, *[c.alias(k) for k, c in watch.items()]) if watch else df).write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.__dict__.update(_shared_path=path, _watched=seen.get if seen else {})
    return out


def watched(df: DataFrame) -> dict:
    return df.__dict__["_watched"]


def drop(*tables: DataFrame | None) -> None:
    """Delete what `materialise` wrote for these; no later plan may read them."""
    for df in tables:
        path = df.__dict__.get("_shared_path") if df is not None else None
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, old: DataFrame | None = None, watch: dict[str, Column] | None = None) -> DataFrame:
    """A round's result, written and read again; `old`, the round before, is deleted once it is written.

    A checkpointed plan would hand its constraints on, and they multiply with every round.
    """
    out = materialise(df, "round", watch)
    drop(old)
    return out
