"""Largest inner products by stable projections, kd-tree cells and a chi-square stopping test."""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from relweave.llm.scratch import Scratch, clean, map_batches

#: dimensions of the projection (even, for the closed form of the chi-square distribution)
DIMS = 8
#: probability that a true neighbour is inside the radius at which the search stops
CONFIDENCE = 0.98
#: rows the cell borders are fitted on, about; every row is indexed
SAMPLE_ROWS = 20_000
#: rows and queries of one block of a cell; larger cells are split into blocks
CELL_ROWS, CELL_QUERIES = 8192, 1024
LEAF_ROWS = 128
HOME_CELLS = 2


def chi_square_quantile(p: float, m: int = DIMS) -> float:
    """Quantile of the chi-square distribution with an even number ``m`` of degrees."""
    def cdf(x: float) -> float:
        h = x / 2
        return 1 - math.exp(-h) * sum(h**i / math.factorial(i) for i in range(m // 2))

    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def _matrix(column) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(a.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(a), -1) if len(a) else np.zeros((0, 0))


def project_vectors(x: np.ndarray, matrix: np.ndarray, top: float) -> np.ndarray:
    """Gaussian projection of vectors, after one more component lifts each to the largest length.

    A query has 0 there, so the squared distance is ``top + |q|^2 - 2 <q, x>``: the nearest
    vector is the one with the largest product.
    """
    rest = np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))
    return np.hstack([x, rest[:, None]]) @ matrix


def split_tree(p: np.ndarray, leaf_rows: int) -> tuple[list, list[np.ndarray]]:
    """A kd-tree over ``p``: nodes ``(axis, border, left, right)`` with leaves as ``~number``, and leaf rows.

    The widest axis is cut at its median; rows that no cut separates stay in one leaf.
    """
    nodes: list = []
    leaves: list[np.ndarray] = []

    def grow(rows: np.ndarray) -> int:
        wide = np.ptp(p[rows], axis=0) if len(rows) > leaf_rows else np.zeros(1)
        axis = int(wide.argmax())
        if not wide[axis] > 0:
            leaves.append(rows)
            return ~(len(leaves) - 1)
        v = p[rows, axis]
        border = np.median(v)
        low = v < border
        if not low.any():
            low = v <= border
        me = len(nodes)
        nodes.append(None)
        left, right = grow(rows[low]), grow(rows[~low])
        nodes[me] = (axis, float(v[~low].min()), left, right)
        return me

    grow(np.arange(len(p)))
    return nodes, leaves


def find_cell(nodes: list, p: np.ndarray) -> np.ndarray:
    """Leaf number of each row."""
    out = np.zeros(len(p), dtype=np.int32)
    todo = [(0, np.arange(len(p)))] if nodes else []
    while todo:
        i, rows = todo.pop()
        if i < 0:
            out[rows] = ~i
            continue
        axis, border, left, right = nodes[i]
        low = p[rows, axis] < border
        todo += [(left, rows[low]), (right, rows[~low])]
    return out


def box_distance(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box, a row per query."""
    out = np.zeros((len(q), len(lo)))
    for j in range(q.shape[1]):
        gap = np.maximum(np.maximum(lo[None, :, j] - q[:, None, j], q[:, None, j] - hi[None, :, j]), 0)
        out += gap * gap
    return out


def search_block(x: np.ndarray, ids: np.ndarray, px: np.ndarray, q: np.ndarray, pq: np.ndarray, bound: np.ndarray, k: int, top: float, reach: float):
    """Best ``k`` rows of a block for each query, as ``(query row, id, product)`` arrays.

    Leaves of the block's kd-tree come to a query in order of projected distance. Their rows are
    verified with exact products until its next leaf is further than ``reach`` times the k-th best
    squared distance, here or in ``bound`` (what the query has found elsewhere).
    """
    _, leaves = split_tree(px, LEAF_ROWS)
    lo = np.array([px[r].min(axis=0) for r in leaves])
    hi = np.array([px[r].max(axis=0) for r in leaves])
    far = box_distance(pq, lo, hi)
    order = np.argsort(far, axis=1, kind="stable")
    length = (q * q).sum(axis=1)
    limit = bound.astype(np.float64).copy()
    worst = np.full(len(q), -np.inf)  # k-th best product so far
    best_q, best_i, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for turn in range(len(leaves)):
        # all queries that go on take their next leaf together
        leaf = order[:, turn]
        go = np.flatnonzero(far[np.arange(len(q)), leaf] <= limit * reach)
        if not len(go):
            break
        go = go[np.argsort(leaf[go], kind="stable")]
        new_q, new_i, new_s = [best_q], [best_i], [best_s]
        for group in np.split(go, np.flatnonzero(np.diff(leaf[go])) + 1):
            rows = leaves[leaf[group[0]]]
            s = q[group] @ x[rows].T
            i, j = np.nonzero(s >= worst[group][:, None])
            new_q.append(group[i])
            new_i.append(ids[rows[j]])
            new_s.append(s[i, j])
        best_q, best_i, best_s = map(np.concatenate, (new_q, new_i, new_s))
        by = np.lexsort((best_i, -best_s, best_q))
        best_q, best_i, best_s = best_q[by], best_i[by], best_s[by]
        first = np.searchsorted(best_q, np.arange(len(q)))
        keep = np.arange(len(best_q)) - first[best_q] < k
        best_q, best_i, best_s = best_q[keep], best_i[keep], best_s[keep]
        first = np.searchsorted(best_q, np.arange(len(q) + 1))
        full = np.flatnonzero(np.diff(first) == k)
        worst[full] = best_s[first[full] + k - 1]
        limit[full] = np.minimum(limit[full], np.maximum(top + length[full] - 2 * worst[full], 0.0))
    return best_q, best_i, best_s


def usable(v: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not all zero."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & good & F.exists(v, lambda x: x != 0), F.lit(False))


_FOUND = "qid long, vid long, score double"


def nearest_products(vectors: DataFrame, is_query: Column, k: int = 20, seed: int = 17, confidence: float = CONFIDENCE) -> DataFrame:
    """The ``k`` largest inner products of each query: ``(query_id, rank, vec_id, score)``.

    ``is_query`` picks query rows by ``vec_id``; every other usable row is a candidate of each
    query. Equal vectors are searched as one, with their ``k + 1`` smallest ids, which are all
    that any list can need; equal queries are searched once. Rows go to the cells of a kd-tree
    over the projections, whose borders come from a bounded sample; cells above a size are cut
    into blocks, on the row side and on the query side, so no task holds more than one block of
    each. A query first searches its nearest cells, then every cell that the chi-square test
    does not rule out at the distance found so far: a row nearer than the k-th lies outside of
    that radius with a probability of ``1 - confidence`` at most.

    Vectors null, zero, or with null or non-finite components take no part, nor does a null id
    or a vector whose length is not the most common one. Rows that repeat an id are candidates
    once for each distinct vector. Fewer candidates than ``k`` give shorter lists; ties go to the
    smaller id.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = clean(vectors, vec_id="long", embedding="array<double>").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    dim = sizes["d"]
    rows = rows.filter(F.size("embedding") == dim).dropDuplicates(["vec_id", "embedding"]).withColumn("q", is_query)
    # the k + 1 smallest ids of each distinct vector; the limit is applied before the shuffle too
    first = W.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    asked = rows.filter("q").groupBy("embedding").agg(F.lit(True).alias("asked"))
    distinct = few.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    distinct = distinct.join(asked, "embedding", "left").select(
        F.xxhash64("embedding").alias("vid"), "embedding", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))
    distinct = scratch.save(distinct)
    n, top = distinct.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda t, v: t + v * v))).first()

    matrix = np.random.default_rng(seed).standard_normal((dim + 1, DIMS))
    share = min(1.0, SAMPLE_ROWS / n)
    sample = distinct.filter(F.pmod(F.xxhash64(F.lit(seed), "vid"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("embedding").toArrow()
    px = project_vectors(_matrix(sample.column("embedding")), matrix, top) if sample.num_rows else np.zeros((0, DIMS))
    nodes, _ = split_tree(px, max(8, math.ceil(len(px) * min(1.0, CELL_ROWS / n)))) if len(px) else ([], [])
    reach = chi_square_quantile(confidence)
    tools = spark.sparkContext.broadcast((matrix, top, nodes))

    def place(b):
        matrix, top, tree = tools.value
        v = project_vectors(_matrix(b.column("x")), matrix, top)
        cells = find_cell(tree, v)
        yield pa.RecordBatch.from_arrays(
            [b.column("vid"), b.column("x"), pa.array(cells, pa.int32()), pa.array(list(v), pa.list_(pa.float64()))], names=["vid", "x", "cell", "p"])

    placed = map_batches(distinct.select("vid", F.col("embedding").alias("x")), place, "vid long, x array<double>, cell int, p array<double>")
    placed = scratch.save(placed)
    boxes = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.array(*[F.min(F.col("p")[i]) for i in range(DIMS)]).alias("lo"),
        F.array(*[F.max(F.col("p")[i]) for i in range(DIMS)]).alias("hi")).orderBy("cell").collect()
    lo, hi = np.array([r["lo"] for r in boxes]), np.array([r["hi"] for r in boxes])
    names = np.array([r["cell"] for r in boxes])
    parts = {r["cell"]: -(-r["n"] // CELL_ROWS) for r in boxes}
    cells = spark.sparkContext.broadcast((names, lo, hi))

    def visit(queries: DataFrame, again: bool) -> DataFrame:
        def route(b):
            cell, low, high = cells.value
            x = _matrix(b.column("x"))
            far = box_distance(x @ tools.value[0][:-1], low, high)
            near = np.argsort(far, axis=1, kind="stable")
            rank = np.empty_like(near)
            np.put_along_axis(rank, near, np.arange(len(cell))[None, :], axis=1)
            bound = b.column("bound").to_numpy(zero_copy_only=False)
            go = (rank >= HOME_CELLS) & (far <= bound[:, None] * reach) if again else rank < HOME_CELLS
            q, c = np.nonzero(go)
            if len(q):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[c], pa.int32()), b.column("qid").take(pa.array(q)), b.column("x").take(pa.array(q)), pa.array(bound[q])],
                    names=["cell", "qid", "x", "bound"])

        routed = map_batches(queries, route, "cell int, qid long, x array<double>, bound double")
        routed = scratch.save(routed)
        asked_of = {r["cell"]: -(-r["count"] // CELL_QUERIES) for r in routed.groupBy("cell").count().collect()}
        if not asked_of:
            return spark.createDataFrame([], _FOUND)
        blocks = F.create_map(*[F.lit(v) for c in parts for v in (c, parts[c])])
        qblocks = F.create_map(*[F.lit(v) for c in asked_of for v in (c, asked_of[c])])
        left = placed.filter(F.col("cell").isin(list(asked_of))).withColumn("block", F.pmod("vid", blocks[F.col("cell")]).cast("int"))
        left = left.withColumn("qblock", F.explode(F.sequence(F.lit(0), qblocks[F.col("cell")] - 1)))
        right = routed.withColumn("qblock", F.pmod(F.xxhash64("qid"), qblocks[F.col("cell")]).cast("int"))
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("cell")] - 1)))
        key = ["cell", "block", "qblock"]

        def search(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({"qid": pa.array([], pa.int64()), "vid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            matrix, top, _ = tools.value
            q = _matrix(b.column("x"))
            ids, asker = a.column("vid").to_numpy(), b.column("qid").to_numpy()
            i, v, s = search_block(_matrix(a.column("x")), ids, _matrix(a.column("p")), q, q @ matrix[:-1], b.column("bound").to_numpy(), k + 1, top, reach)
            return pa.table({"qid": pa.array(asker[i], pa.int64()), "vid": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

        return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(search, _FOUND)

    best = W.partitionBy("qid").orderBy(F.desc("score"), "vid")
    top_of = lambda df: df.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    queries = distinct.filter("asked").select(F.col("vid").alias("qid"), F.col("embedding").alias("x"))
    near = scratch.save(top_of(visit(queries.withColumn("bound", F.lit(float("inf"))), False)).drop("r"))
    kth = near.groupBy("qid").agg(F.when(F.count("*") > k, F.min("score")).alias("s"))
    length = F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v)
    more = queries.join(kth, "qid", "left").select(
        "qid", "x", F.coalesce(F.greatest(F.lit(0.0), F.lit(float(top)) + length - 2 * F.col("s")), F.lit(float("inf"))).alias("bound"))
    found = top_of(near.unionByName(visit(more, True)))
    # from distinct vectors to ids: the k + 1 best of a distinct query serve all its rows
    ids = distinct.select("vid", F.explode("ids").alias("vec_id"))
    lists = found.join(ids, "vid").withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")))
    lists = lists.filter(F.col("r") <= k + 1).select("qid", "vec_id", "score")
    asked_rows = rows.filter("q").select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("qid"))
    out = asked_rows.join(lists, "qid").filter("vec_id <> query_id")
    order = W.partitionBy("query_id", "qid").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
