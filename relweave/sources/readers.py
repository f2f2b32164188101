"""Table readers.  Parquet is the native format; csv and npz are ingest paths."""

from __future__ import annotations

import io
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from relweave.functions.scalar import col

# names looked up, in this order, when the target column is not given (fixed values)
TARGET_NAMES = ("target", "class", "label", "labels", "y", "response", "outcome")


def scan_parquet(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*([path] if isinstance(path, str) else path))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; ``?`` is null.  Give a schema at scale: inference costs a second scan."""
    reader = spark.read.option("header", True).option("nullValue", "?").option("quote", '"').option("escape", '"')
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def target_column(columns: Sequence[str]) -> str:
    """The first known target name (any case), else the last column."""
    place = {name: i for i, name in enumerate(TARGET_NAMES)}
    best = min(columns, key=lambda c: place.get(c.lower(), len(place)))
    return best if best.lower() in place else columns[-1]


def scan_csv_flat(spark: SparkSession, path: str, schema=None, target: str | None = None) -> tuple[DataFrame, str]:
    """A flat CSV dataset without rows lacking a target, and the name of that target."""
    df = scan_csv(spark, path, schema)
    y = target or target_column(df.columns)
    return df.filter(col(y).isNotNull()), y


def scan_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Choose the format by suffix."""
    lowered = path.rstrip("/").lower()
    if lowered.endswith((".csv", ".csv.gz")):
        return scan_csv(spark, path, schema)
    if lowered.endswith((".parquet", ".pq", ".pqt")):
        return scan_parquet(spark, path, schema)
    raise ValueError(f"unsupported table suffix: {path}")


def scan_npz(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Columns of ``.npz`` shards, one task per shard; 2-D arrays become array columns.

    An npz member cannot be split, so this is a one-off ingest: write the result as parquet.
    """
    names = T.StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names

    def load(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for raw in pdf["content"]:
                with np.load(io.BytesIO(raw), allow_pickle=False) as data:
                    members = {n: data[n] for n in names}
                rows = len(next(iter(members.values())))
                for start in range(0, rows, 65536):  # bounded batches back to the JVM
                    part = {n: v[start:start + 65536] for n, v in members.items()}
                    yield pd.DataFrame({n: list(v) if v.ndim > 1 else v for n, v in part.items()})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option(
        "recursiveFileLookup", "true").load(path)
    return files.select("content").mapInPandas(load, schema)


def discover(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(dataset, path) of every folder holding metadata and at least one parquet table."""
    # only the listing is used: file contents are never read
    paths = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots)).select("path")
    )
    found = paths.select(
        F.regexp_extract("path", r"^(.*?)/(?:metadata\.(?:json|yaml)|[^/]+\.parquet)(?:/[^/]*)?$", 1).alias("path"),
        F.col("path").rlike(r"/metadata\.(json|yaml)(/[^/]*)?$").alias("meta"),
    ).filter("path <> ''")
    complete = found.groupBy("path").agg(F.bool_or("meta").alias("has_meta"), F.bool_or(~F.col("meta")).alias("has_table"))
    return complete.filter("has_meta AND has_table").select(
        F.element_at(F.split("path", "/"), -1).alias("dataset"), "path"
    )


def peek(df: DataFrame, rows: int = 5, order: Sequence[str] = ()) -> DataFrame:
    """First rows of a table, as it is stored or in the order of some columns."""
    return (df.orderBy(*[col(c) for c in order]) if order else df).limit(rows)


def describe_columns(df: DataFrame, rows: int = 5, order: Sequence[str] = ()) -> DataFrame:
    """(column, type, rows, present, first): one pass for the counts, and the first values as text."""
    names = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(col(c)).alias(f"__p{i}") for i, c in enumerate(names)])
    top = [r.asDict() for r in peek(df, rows, order).select(*[col(c).cast("string").alias(f"__v{i}") for i, c in enumerate(names)]).collect()]
    items = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"),
                 F.col("__rows").alias("rows"), F.col(f"__p{i}").alias("present"),
                 F.array(*[F.lit(r[f"__v{i}"]).cast("string") for r in top]).cast("array<string>").alias("first"))
        for i, c in enumerate(names)
    ])
    return counts.select(F.inline(items))
