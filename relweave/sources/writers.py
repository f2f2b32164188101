"""Table writers and the on-disk dataset layout: parquet folders plus a JSON schema sidecar."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from relweave.functions.scalar import col
from relweave.model import ColumnMeta, RelationalDataset, TableMeta, TaskMeta

SPLITS = ("train", "validation", "test")


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).parquet(path)
    return path


def write_partitioned(
    df: DataFrame, path: str, partitions: int | None = None, partition_by: Sequence[str] = ()
) -> str:
    """Partitioned parquet; rows spread over ``partitions`` tasks, so one hot value has many writers."""
    out = df.repartition(partitions) if partitions else df
    out.write.partitionBy(*partition_by).parquet(path)
    return path


def write_task_splits(task: DataFrame, path: str, split: str = "split") -> str:
    """Train, validation and test rows in one pass, one folder per split (pruned on read)."""
    task.write.partitionBy(split).parquet(path)
    return path


def task_table(splits: dict[str, DataFrame]) -> DataFrame:
    """Union of the splits with a ``split`` column."""
    out = None
    for name in SPLITS:
        if name in splits:
            part = splits[name].withColumn("split", F.lit(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no known split given")
    return out


def csv_table(task: DataFrame, target: str, rename: str | None = None) -> DataFrame:
    """All splits of a task as one flat table: no null targets, target last."""
    rest = [c for c in task.columns if c not in (target, "split")]
    return task.filter(col(target).isNotNull()).select(*[col(c) for c in rest], col(target).alias(rename or target))


def write_csv(df: DataFrame, path: str, null: str = "?") -> str:
    df.write.option("header", True).option("nullValue", null).option("quote", '"').option("escape", '"').csv(path)
    return path


def check_shared(spark: SparkSession, folder: str) -> None:
    """Raise unless the tasks see what the driver writes into the folder."""
    token = os.path.join(folder, f".seen-{uuid.uuid4().hex}")
    with open(token, "w") as f:
        f.write(token)

    def look(batches):
        for pdf in batches:
            pdf["seen"] = os.path.exists(token)
            yield pdf

    n = spark.sparkContext.defaultParallelism
    blind = spark.range(0, n, 1, n).mapInPandas(look, "id long, seen boolean").filter("NOT seen").count()
    os.remove(token)
    if blind:
        raise ValueError(f"{folder} is not one folder for the driver and all executors")


def write_npz(df: DataFrame, folder: str, shard_rows: int = 1_000_000) -> DataFrame:
    """``.npz`` shards of bounded size in a mounted shared folder; returns (path, rows).

    File names come from the partition and shard number, so a retried task replaces its own
    shards.
    """
    folder = folder.removeprefix("file://").removeprefix("file:")
    if "://" in folder:
        raise ValueError("npz shards need a mounted folder; write parquet to object stores")
    os.makedirs(folder, exist_ok=True)
    check_shared(df.sparkSession, folder)

    def save(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        def column(s):
            if s.dtype != object:
                return s.to_numpy()
            return s.to_numpy().astype(str) if isinstance(s.iloc[0], str) else np.stack(s.to_numpy())

        def flush(frames, shard):
            pdf = pd.concat(frames, ignore_index=True)
            name = os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}-{shard:05d}.npz")
            with open(name + ".tmp", "wb") as f:
                np.savez(f, **{c: column(pdf[c]) for c in pdf.columns})
            os.replace(name + ".tmp", name)
            return pd.DataFrame({"path": [name], "rows": [len(pdf)]})

        frames, rows, shard = [], 0, 0
        for pdf in batches:
            frames.append(pdf)
            rows += len(pdf)
            if rows >= shard_rows:
                yield flush(frames, shard)
                frames, rows, shard = [], 0, shard + 1
        if rows:
            yield flush(frames, shard)

    return df.mapInPandas(save, "path string, rows long")


def save_dataset(ds: RelationalDataset, path: str) -> str:
    """Write every table and task, then the metadata: a folder with metadata is complete."""
    spark = next(iter(ds.tables.values())).sparkSession
    for name, meta in ds.meta.items():
        columns = [c.name for c in meta.columns]
        missing = set(columns) - set(ds.tables[name].columns)
        if missing:
            raise ValueError(f"table {name} lacks declared columns {sorted(missing)}")
        ds.tables[name].select(*[col(c) for c in columns]).write.parquet(f"{path}/{name}.parquet")
    for name, (_, df) in ds.tasks.items():
        write_task_splits(df, f"{path}/task_{name}.parquet")
    doc = {
        "name": ds.name,
        "tables": [asdict(m) for m in ds.meta.values()],
        "tasks": [asdict(m) for m, _ in ds.tasks.values()],
        "column_groups": ds.column_groups,
    }
    # a one-row write through Spark, so any Hadoop file system works
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(f"{path}/metadata.json")
    return path


def load_dataset(spark: SparkSession, path: str) -> RelationalDataset:
    doc = json.loads(spark.read.text(f"{path}/metadata.json").first()["value"])
    meta = {
        m["name"]: TableMeta(m["name"], tuple(ColumnMeta(**c) for c in m["columns"]), m["time_column"])
        for m in doc["tables"]
    }
    tables = {n: spark.read.parquet(f"{path}/{n}.parquet") for n in meta}
    tasks = {}
    for m in doc["tasks"]:
        task = TaskMeta(**{**m, "keys": tuple(m["keys"])})
        tasks[task.name] = (task, spark.read.parquet(f"{path}/task_{task.name}.parquet"))
    groups = [[tuple(c) for c in g] for g in doc["column_groups"]]
    return RelationalDataset(doc["name"], tables, meta, groups, tasks)


def flat_to_dataset(
    df: DataFrame, name: str, column_types: dict[str, str], time_column: str | None = None
) -> RelationalDataset:
    """One flat table plus a distinct parent table ``<id>(key)`` per ID column.

    ``column_types`` maps a column to "ID", a logical dtype, or None to leave it out.
    """
    used = {c: d for c, d in column_types.items() if d is not None}
    cols = tuple(
        ColumnMeta(c, "foreign_key", f"{c}.key") if d == "ID" else ColumnMeta(c, d) for c, d in used.items()
    )
    ds = RelationalDataset(name, {name: df.select(*[col(c) for c in used])}, {name: TableMeta(name, cols, time_column)})
    for c, d in used.items():
        if d == "ID":
            parent = df.select(col(c).alias("key")).filter("key is not null").distinct()
            ds = ds.with_table(TableMeta(c, (ColumnMeta("key", "primary_key"),)), parent)
    return ds


def narrow_task(
    task: DataFrame, entity: str, target: str, time: str | None, key_map: DataFrame, raw: str, code: str
) -> DataFrame:
    """(entity, time?, target) with the entity key remapped through ``key_map(raw, code)``."""
    right = key_map.select(col(raw).alias("__raw"), col(code).cast("long").alias("__code"))
    cols = [F.col("__code").alias(entity), *([col(time)] if time else []), col(target)]
    keep = [c for c in task.columns if c == "split"]
    return task.join(right, col(entity) == F.col("__raw"), "left").select(*cols, *[col(c) for c in keep])
