"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_RUNTIME_CONF = {
    # timestamps without zone are read as UTC instants everywhere
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a hot foreign key may hold a third of a table: split its join partition
    # even when that costs one more exchange for the aggregation above it
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator assumes; cluster sizing is left alone."""
    for key, value in _RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if spark.sparkContext.master.startswith("local"):
        if spark.conf.get("spark.sql.shuffle.partitions") == "200":
            spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A fresh sub-folder of the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder: on a
    cluster a machine-local folder would be lost with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = os.path.join(tempfile.gettempdir(), "relweave-scratch")
    return f"{base.rstrip('/')}/relweave-{uuid.uuid4().hex}"


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of the queries run inside go as each ends, not when the driver collects its garbage."""
    own = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if own is None else spark.conf.set(_FREED, own)


@contextmanager
def written(df: DataFrame):
    """The rows in the shared folder, for as long as the block inside runs."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    try:
        with shuffles_freed(spark):
            df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _delete(spark, path)


_WRITTEN: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and read it back: cuts lineage, survives lost executors.

    Results read such tables lazily, so they stay until ``release`` is called.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that nothing reads any more."""
    _WRITTEN.remove(df.written_to)
    _delete(df.sparkSession, df.written_to)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` wrote, once every result that reads them is stored."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
