"""Intermediate tables in the shared folder, and small helpers every operator uses."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relweave.session import shared_dir


class Scratch:
    """Writes intermediate tables below one shared folder and drops them when told to.

    A written table cuts the lineage: a lost executor costs only the tasks of the running
    stage. ``drop`` removes a table that nothing reads any more and lets the driver collect
    the shuffles behind it, so the folder holds what is in use and not the whole history.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, shared_dir(spark)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def save_shares(self, df: DataFrame, key: str, n: int) -> list[DataFrame]:
        """The rows in ``n`` parts by their keys, for work that takes one part at a time; all are one table for ``drop``."""
        share = F.pmod(F.col(key), F.lit(n)).cast("int")
        path = f"{self.base}/{uuid.uuid4().hex}"
        df.withColumn("share", share).write.partitionBy("share").parquet(path)
        out = self.spark.read.schema(df.withColumn("share", share).schema).parquet(path)
        parts = [out.filter(F.col("share") == i).drop("share") for i in range(n)]
        for part in parts:
            part.scratch_path = path
        return parts

    def delete(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        self.delete(*tables)
        for _ in range(2):  # what the first round frees still holds the last shuffles
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)


def clean(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns with fixed types and safe names; other columns are left behind.

    ``clean(docs, doc_id="long", text="string")`` protects an operator from extra columns
    whose names clash with its own.
    """
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def rows_per_task(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def unsigned_to_long(x):
    """Numpy 64-bit identifiers as Spark longs (same bits)."""
    return x.view("int64")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch; empty batches are skipped."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)


def add_blocks(partial: DataFrame, width: int, dtype: str, how: str = "sum") -> DataFrame:
    """Fold compressed array blocks ``(block int, data binary)`` into one row per block.

    Two rounds: blocks are first folded in parallel shares and then across shares, and a task
    keeps one array per block it meets, so memory does not depend on the number of inputs.
    ``how`` is ``sum``, ``or``, or ``twice`` for a pair of bit arrays (seen once, seen twice).
    """
    import zlib

    import numpy as np

    def fold(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist()):
                x = np.frombuffer(zlib.decompress(data), dtype=dtype)
                if block not in held:
                    held[block] = x.copy()
                elif how == "sum":
                    held[block] += x
                elif how == "or":
                    held[block] |= x
                else:
                    a, half = held[block], len(x) // 2
                    a[half:] |= x[half:] | (a[:half] & x[:half])
                    a[:half] |= x[:half]
        if held:
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(list(held), pa.int32()),
                "share": pa.array([0] * len(held), pa.int32()),
                "data": pa.array([zlib.compress(v.tobytes(), 1) for v in held.values()], pa.binary()),
            })

    schema = "block int, share int, data binary"
    n = rows_per_task(partial)
    first = partial.repartition(n, "block", "share").mapInArrow(fold, schema)
    return first.repartition(n, "block").mapInArrow(fold, schema).select("block", "data")


def arrow(schema: str, **columns) -> pa.RecordBatch:
    """A record batch with the types of a Spark schema string's simple columns."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
             "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32())}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    arrays = [columns[n] if isinstance(columns[n], pa.Array) else pa.array(columns[n], kinds[t]) for n, t in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def share_of(n: int) -> Column:
    """The partition's number modulo ``n``: spreads the partial blocks of one block over tasks."""
    return F.pmod(F.spark_partition_id(), F.lit(n)).cast("int")
