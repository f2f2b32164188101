"""Whitening of embeddings by the covariance of distinct vectors weighted by their multiplicity."""

from __future__ import annotations

import zlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from relweave.llm.scratch import Scratch, add_blocks, clean, rows_per_task, share_of

#: entries become whole numbers: floor(SCALE * entry) + SHIFT
SCALE, SHIFT = 64, 1_000_000
#: entries beyond this size have no whole number that a long holds
_LARGEST = float(2**56)
#: doubles a batch of vectors may take
_BATCH = 1 << 22
_OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _matrix(column: pa.Array, width: int, dtype: str) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)


def _slices(batches, width: int):
    step = max(1, _BATCH // max(1, width))
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def _exact_sums(groups: DataFrame, width: int) -> tuple[int, list[int]]:
    """Weight of all vectors, and the exact weighted sum of each dimension."""

    def add(batches):
        total, sums = 0, [0] * width
        for b in _slices(batches, width):
            x, m = _matrix(b.column("x"), width, "int64"), b.column("m").to_numpy(zero_copy_only=False)
            weight = int(m.sum())
            total += weight
            if int(np.abs(x).max(initial=0)) * weight < 2**62:
                part = (m @ x).tolist()
            else:
                part = (m.astype(object) @ x.astype(object)).tolist()
            sums = [a + b for a, b in zip(sums, part)]
        if total:
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(range(-1, width), pa.int32()),
                "s": pa.array([Decimal(v) for v in [total, *sums]], pa.decimal128(38, 0)),
            })

    parts = groups.select("x", "m").mapInArrow(add, "i int, s decimal(38,0)")
    found = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S/n`` as doubles: whole parts are taken off as integers, so no digit is lost."""
    pivot = [s // n for s in sums]
    rest = np.array([(s - n * p) / n for s, p in zip(sums, pivot)])
    return (x - np.array(pivot, dtype=np.int64)).astype(np.float64) - rest


def _gram(rows: DataFrame, width: int, centre) -> np.ndarray:
    """Weighted sum of the outer products of ``centre(batch)`` over the rows with weight ``m``."""

    def multiply(batches):
        total = np.zeros((width, width))
        for b in _slices(batches, width):
            x = centre(b)
            total += (x * b.column("m").to_numpy(zero_copy_only=False).astype(np.float64)[:, None]).T @ x
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(range(width), pa.int32()),
            "data": pa.array([zlib.compress(v.tobytes(), 1) for v in total], pa.binary()),
        })

    n = max(1, rows_per_task(rows) // max(1, width))
    partial = rows.mapInArrow(multiply, "block int, data binary").withColumn("share", share_of(n))
    out = np.zeros((width, width))
    for r in add_blocks(partial, width, "float64").collect():
        out[r["block"]] = np.frombuffer(zlib.decompress(r["data"]), np.float64)
    return out


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact ``sum((n*x - S)^2)`` of each row.

    Differences are split into 26-bit halves whose squares add up inside 64 bits; only wider
    ones (or more than 1024 dimensions) go through Python integers.
    """
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 2**51 and len(sums) <= 1024:
        d = n * x - np.array(sums, dtype=np.int64)
        high, low = d >> 26, d & (2**26 - 1)
        a, b, c = (high * high).sum(1).tolist(), (high * low).sum(1).tolist(), (low * low).sum(1).tolist()
        return [(u << 52) + (v << 27) + w for u, v, w in zip(a, b, c)]
    d = n * x.astype(object) - np.array(sums, dtype=object)
    return [int(v) for v in (d * d).sum(axis=1)]


def whole_vectors(rows: DataFrame) -> DataFrame:
    """``(vec_id, x)``: vectors of whole numbers; null, empty and unusable vectors are left out."""
    rows = clean(rows, vec_id="long", embedding="array<double>")
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda c: c.isNotNull() & (F.abs(c) <= _LARGEST))  # not-a-number is above all numbers
    # the optimizer may order filters anew, so the arithmetic is safe for every entry
    whole = F.transform("embedding", lambda c: F.floor(F.when(F.abs(c) <= _LARGEST, c) * SCALE) + F.lit(SHIFT).cast("long"))
    return rows.filter(usable).select("vec_id", whole.alias("x"))


def whiten(vectors: DataFrame, most: int = 32, weights: str = "count") -> DataFrame:
    """Whitened components of every vector: ``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    Entries become whole numbers ``x``, and equal vectors are grouped. The covariance is fitted
    on the distinct vectors, weighted by their counts (``weights="count"``, as if every row were
    in the list) or by one (``weights="one"``); it is a sum of centred products per task, folded
    row by row of the matrix. Each distinct vector is whitened once and joined back to its rows.
    ``deviation`` is the exact integer ``sum((n*x - S)^2)`` (null beyond 38 digits). The driver
    holds matrices of the vectors' width, whatever the number of rows.

    Vectors that are null, empty, or hold null, non-finite entries or entries beyond 2^56 take
    no part, nor do vectors of another length than the most frequent one (ties: the longer).
    Repeated rows and null ids count and come back row by row. A component without variance
    (below the rounding error of the largest) has a null ``whitened`` and takes no part in
    ``identity_error``, which is null if there is no other. An empty table gives no rows, and
    extra columns of any name are ignored.
    """
    if weights not in ("count", "one"):
        raise ValueError("weights must be 'count' or 'one'")
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = whole_vectors(vectors)
    counts = rows.groupBy("x").agg(F.count("*").alias("c"))
    groups = scratch.save(counts.select("x", F.size("x").alias("width"), "c", (F.col("c") if weights == "count" else F.lit(1)).cast("long").alias("m")))
    best = groups.groupBy("width").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), F.desc("width")).first()
    if best is None:
        return spark.createDataFrame([], _OUT)
    width = best["width"]
    groups = groups.filter(F.col("width") == width).select("x", "m")
    n, sums = _exact_sums(groups, width)

    cov = _gram(groups, width, lambda b: _centred(_matrix(b.column("x"), width, "int64"), n, sums)) / n
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(width)] < 0, -1.0, 1.0)
    kept = min(most, width)
    varies = values[:kept] > max(values[0], 0.0) * width * np.finfo(float).eps
    alive = int(varies.sum())
    turn = axes[:, :alive] / np.sqrt(values[:alive])
    trace = float(np.trace(cov))

    def apply(batches):
        for b in _slices(batches, width):
            x = _matrix(b.column("x"), width, "int64")
            y = _centred(x, n, sums) @ turn
            digits = [Decimal(d) if d < 10**38 else None for d in _deviation(x, n, sums)]
            yield pa.RecordBatch.from_arrays(
                [b.column("x"), b.column("m"), pa.array(digits, pa.decimal128(38, 0)), pa.array(list(y), pa.list_(pa.float64()))],
                names=["x", "m", "deviation", "y"])

    white = scratch.save(groups.mapInArrow(apply, "x array<long>, m long, deviation decimal(38,0), y array<double>"))
    error = None
    if alive:
        mean = np.array([r["s"] for r in white.select("m", F.posexplode("y").alias("i", "v")).groupBy("i").agg(
            F.sum(F.col("m") * F.col("v")).alias("s")).orderBy("i").collect()]) / n
        spread = _gram(white.select("y", "m"), alive, lambda b: _matrix(b.column("y"), alive, "float64") - mean) / n
        error = float(np.abs(spread - np.eye(alive)).max())

    shares = F.array(*[F.lit(float(max(v, 0.0)) / trace if trace > 0 else None).cast("double") for v in values[:kept]])
    out = rows.filter(F.size("x") == width).join(white.drop("m"), "x").select(
        "vec_id", "deviation", "y", F.explode(F.sequence(F.lit(0), F.lit(kept - 1))).alias("i"))
    return out.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.get("y", F.col("i")).alias("whitened"), F.get(shares, F.col("i")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
