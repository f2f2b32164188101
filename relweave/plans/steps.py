"""Two step functions compared on many lines at once.

A line gives every row of two samples a position.  Positions are cut into ordered buckets, counted
per bucket, and then shuffled as packed arrays to one small group per line and bucket, where they
are sorted and the two distribution functions compared.  The counts before a bucket make each
group exact on its own, so a row is moved once and no window runs over a line.

Many lines move many times the bytes of the rows themselves, so they are taken a few at a time:
the rows' columns are written once as arrays and read for each lot, whose shuffle files go before the next one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relweave.functions import scalar as S
from relweave.functions.scalar import col
from relweave.plans.ordering import shuffle_width
from relweave.plans.packing import pack_sorted, unpack_sorted
from relweave.session import shuffles_freed, written

# positions that one group sorts on average, and rows that a task packs at a time
GROUP_ROWS = 500_000
PACK_ROWS = 100_000
SAMPLES_PER_BUCKET = 64
MAX_BUCKETS = 4096
# packed positions per shuffle task
TASK_BYTES = 64 << 20
# lines whose positions are shuffled together, and rows up to which all are
LINES_AT_ONCE, FEW_ROWS = 6, 4_000_000


@dataclass(frozen=True)
class Line:
    """Position of a row: the weighted sum of its scaled columns, for either sample.

    ``left`` and ``right`` are (weight, mean, scale) per column; ``digits`` rounds the position.
    """

    left: tuple[tuple[float, float, float], ...]
    right: tuple[tuple[float, float, float], ...]
    digits: int | None = None

    def place(self, x: np.ndarray, first: bool) -> np.ndarray:
        z = None
        # column by column, so equal rows get equal positions wherever they lie
        for j, (w, m, s) in enumerate(self.left if first else self.right):
            if w:
                part = w * ((x[:, j] - m) / s)
                z = part if z is None else z + part
        z = np.zeros(len(x)) if z is None else z
        # a negative zero is a zero
        return (z if self.digits is None else np.round(z, self.digits)) + 0.0


def _arrays(width: int):
    """Rows of one sample as the bytes of their columns, up to ``PACK_ROWS`` rows each."""
    def run(batches):
        held: dict[bool, list[np.ndarray]] = {True: [], False: []}
        count = {True: 0, False: 0}

        def end(first):
            x = np.concatenate(held[first], axis=1)
            held[first], count[first] = [], 0
            return pa.RecordBatch.from_pydict({"a": [first], "x": pa.array([x.tobytes()], pa.binary())})

        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(1, width + 1)])
            mine = b.column(0).to_numpy(zero_copy_only=False)
            for first in (True, False):
                n = int((mine == first).sum())
                if n:
                    held[first].append(x if n == len(mine) else x[:, mine == first])
                    count[first] += n
                    if count[first] >= PACK_ROWS:
                        yield end(first)
        for first in (True, False):
            if count[first]:
                yield end(first)
    return run


def _blocks(batches, width: int) -> Iterator[tuple[np.ndarray, bool]]:
    """(positions' columns, whether of the left sample) of each array that ``_arrays`` made."""
    for b in batches:
        for first, x in zip(b.column(0).to_pylist(), b.column(1)):
            yield np.frombuffer(x.as_buffer()).reshape(width, -1).T, first


def union(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, x0, x1...): rows of both samples; null and non-finite values count as 0."""
    parts = [df.select(F.lit(first).alias("a"), *[F.coalesce(S.finite(col(c)), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)])
             for first, df in ((True, left), (False, right))]
    return parts[0].unionByName(parts[1])


def compare_steps(rows: DataFrame, width: int, lines: Sequence[Line], na: int, nb: int) -> DataFrame:
    """(line, area, square, gap) of ``rows`` as ``union`` makes them, of which ``na`` and ``nb`` are left and right.

    With g the difference of the two distribution functions: the integrals of its size and its
    square, and the largest size.
    """
    with written(rows.mapInArrow(_arrays(width), "a boolean, x binary")) as arrays:
        return _compare(rows, arrays, width, lines, na, nb)


def _compare(rows: DataFrame, arrays: DataFrame, width: int, lines: Sequence[Line], na: int, nb: int) -> DataFrame:
    n = na + nb
    buckets = max(1, min(MAX_BUCKETS, -(-n // GROUP_ROWS)))
    bounds = [np.array([])] * len(lines)
    if buckets > 1:
        # the bounds only balance the buckets; results are exact whatever they are
        some = rows.sample(min(1.0, SAMPLES_PER_BUCKET * buckets / n), 42).collect()
        x, first = np.array([tuple(r)[1:] for r in some], dtype=float).reshape(-1, width), np.array([r["a"] for r in some], dtype=bool)
        at = np.arange(1, buckets) / buckets
        for i, line in enumerate(lines if len(some) else ()):
            z = np.concatenate([line.place(x[first], True), line.place(x[~first], False)])
            bounds[i] = np.unique(np.quantile(z, at, method="lower"))

    def count(batches):
        total = [np.zeros((len(b) + 1, 2), dtype=np.int64) for b in bounds]
        for x, first in _blocks(batches, width):
            for i, line in enumerate(lines):
                total[i][:, 0 if first else 1] += np.bincount(np.searchsorted(bounds[i], line.place(x, first), side="right"), minlength=len(total[i]))
        for i, t in enumerate(total):
            yield pa.RecordBatch.from_pydict({"line": pa.array([i] * len(t), pa.int32()), "b": pa.array(range(len(t)), pa.int32()),
                                              "na": pa.array(t[:, 0]), "nb": pa.array(t[:, 1])})

    before = [np.zeros((len(b) + 2, 2), dtype=np.int64) for b in bounds]
    if buckets > 1:
        counted = arrays.mapInArrow(count, "line int, b int, na long, nb long").groupBy("line", "b").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
        for r in counted.collect():  # a number per line and bucket
            before[r["line"]][r["b"] + 1] = r["na"], r["nb"]
        before = [np.cumsum(t, axis=0) for t in before]

    def pack(lot):
        def run(batches):
            for x, first in _blocks(batches, width):
                for i in lot:
                    out = {"line": [], "b": [], "a": [], "z": [], "n": []}
                    z = np.sort(lines[i].place(x, first))
                    at = np.flatnonzero(np.concatenate([[True], z[1:] != z[:-1]]))
                    # equal positions travel as one with a count
                    times = np.diff(np.append(at, len(z))) if len(at) < len(z) else None
                    z = z[at]
                    cut = [0, *np.searchsorted(z, bounds[i], side="left").tolist(), len(z)]
                    for b, (lo, hi) in enumerate(zip(cut, cut[1:])):
                        if hi > lo:
                            out["line"].append(i)
                            out["b"].append(b)
                            out["a"].append(first)
                            out["z"].append(pack_sorted(z[lo:hi]))
                            out["n"].append(b"" if times is None else pack_sorted(times[lo:hi].astype(np.int64)))
                    yield pa.RecordBatch.from_pydict({"line": pa.array(out["line"], pa.int32()), "b": pa.array(out["b"], pa.int32()),
                                                      "a": pa.array(out["a"], pa.bool_()), "z": pa.array(out["z"], pa.binary()), "n": pa.array(out["n"], pa.binary())})
        return run

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        i, b = key[0].as_py(), key[1].as_py()
        z, step = [], []
        for a, zs, ns in zip(*[group.column(c).to_pylist() for c in ("a", "z", "n")]):
            here = unpack_sorted(zs, np.float64)
            times = unpack_sorted(ns, np.int64) if ns else 1
            z.append(here)
            step.append(np.broadcast_to(times, here.shape) / na if a else -(np.broadcast_to(times, here.shape) / nb))
        z, step = np.concatenate(z), np.concatenate(step)
        order = np.argsort(z, kind="stable")
        z, step = z[order], step[order]
        base = before[i][b][0] / na - before[i][b][1] / nb
        last = np.append(z[1:] != z[:-1], True)
        gap = (base + np.cumsum(step))[last]
        z = z[last]
        wide = np.diff(z)
        return pa.table({"line": pa.array([i], pa.int32()), "b": pa.array([b], pa.int32()), "area": [float((np.abs(gap[:-1]) * wide).sum())],
                         "square": [float((gap[:-1] ** 2 * wide).sum())], "gap": [float(np.abs(gap).max())], "lo": [float(z[0])], "hi": [float(z[-1])]})

    at_once = len(lines) if n <= FEW_ROWS else LINES_AT_ONCE
    parts = []
    for lo in range(0, len(lines), at_once):
        lot = range(lo, min(lo + at_once, len(lines)))
        tasks = max(shuffle_width(rows), -(-8 * n * len(lot) // TASK_BYTES))
        packed = arrays.mapInArrow(pack(lot), "line int, b int, a boolean, z binary, n binary").repartition(tasks, "line", "b")
        with shuffles_freed(rows.sparkSession):
            parts += packed.groupBy("line", "b").applyInArrow(compare, "line int, b int, area double, square double, gap double, lo double, hi double").collect()
    # a row per line and bucket: the steps between neighbouring buckets, whose gap the counts give
    result = []
    for i in range(len(lines)):
        mine = sorted((r for r in parts if r["line"] == i), key=lambda r: r["b"])
        area, square, gap = sum(r["area"] for r in mine), sum(r["square"] for r in mine), max((r["gap"] for r in mine), default=0.0)
        for r, following in zip(mine, mine[1:]):
            ends = before[i][r["b"] + 1]
            between = ends[0] / na - ends[1] / nb
            wide = following["lo"] - r["hi"]
            area, square = area + abs(between) * wide, square + between * between * wide
        result.append((i, float(area), float(square), float(gap)))
    return rows.sparkSession.createDataFrame(result, "line int, area double, square double, gap double")
