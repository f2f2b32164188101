"""Many regularised logistic fits at once: one aggregation per Newton step, whatever their number.

A model belongs to a task, leaves one fold out and may leave one column out.  A step sums the
gradient and the Gram matrix of every model that still moves in one pass over the rows; the
driver solves systems of the features' width, one per model.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MAX_STEPS = 50
TOLERANCE = 1e-10


@dataclass(frozen=True)
class Model:
    task: str
    fold: int
    left_out: int  # feature index, or -1


def _scaled(batch: pa.RecordBatch, scale: dict[str, tuple[np.ndarray, np.ndarray]]):
    """(task, rows, X with a leading one, y, fold) per task of a batch."""
    tasks = batch.column("task").dictionary_encode()
    codes, names = tasks.indices.to_numpy(zero_copy_only=False), tasks.dictionary.to_pylist()
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    y, fold = batch.column("y").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)
    for code, t in enumerate(names):
        at = np.flatnonzero(codes == code)
        mean, std = scale[t]
        yield t, at, np.hstack([np.ones((len(at), 1)), (x[at] - mean) / std]), y[at], fold[at]


def fit_logistic(rows: DataFrame, width: int, folds: int, left_out: Sequence[int] = (-1,), penalty: float = 1.0):
    """Coefficients of every (task, fold, left-out column) and the scaling of every task.

    ``rows``: task, fold, y (0 or 1) and x (``width`` finite numbers).  The penalty is
    half the squared coefficients, without the intercept, times ``penalty``.
    """
    per = rows.groupBy("task").agg(*[
        f(F.col("x")[i]).alias(f"{k}{i}") for i in range(width) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).collect()
    scale = {r["task"]: (np.array([r[f"m{i}"] for i in range(width)]), np.array([r[f"s{i}"] or 1.0 for i in range(width)])) for r in per}
    models = [Model(t, k, c) for t in scale for k in range(folds) for c in left_out]
    weights = {m: np.zeros(width + 1) for m in models}
    active = list(models)
    ridge = np.full(width + 1, penalty)
    ridge[0] = 0.0
    for _ in range(MAX_STEPS):
        if not active:
            break
        by_task: dict[str, list[tuple[int, Model, np.ndarray]]] = {}
        for i, m in enumerate(active):
            by_task.setdefault(m.task, []).append((i, m, weights[m]))

        def sums(batches, by_task=by_task):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for t, _, x, y, fold in _scaled(b, scale):
                    for i, m, w in by_task.get(t, ()):
                        seen = fold != m.fold
                        z, target = x[seen], y[seen]
                        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -700, 700)))
                        gram = (z * (p * (1 - p))[:, None]).T @ z
                        part = np.concatenate([gram.ravel(), z.T @ (target - p)])
                        total[i] = total[i] + part if i in total else part
            if total:
                yield pa.RecordBatch.from_pydict({"model": pa.array(list(total), pa.int32()), "part": pa.array([v.tolist() for v in total.values()])})

        parts = rows.select("task", "fold", "y", "x").mapInArrow(sums, "model int, part array<double>")
        # one row of numbers per position, summed before they meet
        cells = parts.select("model", F.posexplode("part").alias("i", "v")).groupBy("model", "i").agg(F.sum("v").alias("v"))
        found = cells.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("i", "v")))["v"].alias("part")).collect()
        sums_of = {r["model"]: np.array(r["part"]) for r in found}
        still = []
        for i, m in enumerate(active):
            if i not in sums_of:
                continue
            w, k = weights[m], width + 1
            gram, slope = sums_of[i][: k * k].reshape(k, k), sums_of[i][k * k:]
            keep = [j for j in range(k) if j != m.left_out + 1 or m.left_out < 0]
            a = (gram + np.diag(ridge))[np.ix_(keep, keep)]
            # a task of one class has no finite intercept: its tiny curvature is held up
            step = np.linalg.solve(a + 1e-12 * np.eye(len(keep)), (slope - ridge * w)[keep])
            w = w.copy()
            w[keep] += np.clip(step, -5, 5)
            weights[m] = w
            if np.abs(step).max() > TOLERANCE:
                still.append(m)
        active = still
    return weights, scale


def score_logistic(rows: DataFrame, keep: Sequence[str], weights: dict, scale: dict, left_out: Sequence[int] = (-1,)) -> DataFrame:
    """(keep..., left_out, score) of every row by the models that left its fold out."""
    schema = ", ".join([f"{c} {dict(rows.dtypes)[c]}" for c in keep] + ["left_out int", "score double"])

    def run(batches):
        for b in batches:
            for c in left_out:
                score = np.empty(b.num_rows)
                for t, at, x, _, fold in _scaled(b, scale):
                    for k in np.unique(fold):
                        mine = fold == k
                        score[at[mine]] = (x[mine] * weights[Model(t, int(k), c)]).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(k) for k in keep] + [pa.array([c] * b.num_rows, pa.int32()), pa.array(1.0 / (1.0 + np.exp(-np.clip(score, -700, 700))))],
                    names=[*keep, "left_out", "score"])

    names = list(dict.fromkeys([*keep, "task", "fold", "y", "x"]))
    return rows.select(*names).mapInArrow(run, schema)
