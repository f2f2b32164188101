"""Relational tables as typed nodes and edges, and neighbour sampling over them.

Keys are expected to be mapped integers (see ``KeyMapping``); -1 marks a missing key.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from relweave.functions import scalar as S
from relweave.functions.scalar import col
from relweave.model import RelationalDataset, TableMeta, TaskMeta
from relweave.plans.ordering import hot_groups, numbered, shuffle_width, top_per_group, widen
from relweave.session import materialize

EDGE_SCHEMA = ("etype", "src_type", "src", "dst_type", "dst", "ts")


def is_edge_table(meta: TableMeta, relation_as_edge: bool = True) -> bool:
    """No primary key and exactly two foreign keys; two primary keys are an error."""
    return meta.primary_key is None and len(meta.foreign_keys) == 2 and relation_as_edge


def with_node_id(df: DataFrame, meta: TableMeta, out: str = "__node") -> DataFrame:
    """Node id of each row: its primary key, or its position in the order of all columns."""
    if meta.primary_key:
        return df.withColumn(out, col(meta.primary_key).cast("long"))
    scalar = [c.name for c in meta.columns if not c.is_vector]
    return numbered(df, scalar, out="__rn").withColumn(out, F.col("__rn") - 1).drop("__rn")


def build_nodes(ds: RelationalDataset, relation_as_edge: bool = True) -> dict[str, DataFrame]:
    """Per node type: id, optional ``ts`` and the feature columns."""
    out = {}
    for name, meta in ds.meta.items():
        if is_edge_table(meta, relation_as_edge):
            continue
        feats = [c.name for c in meta.columns if not c.is_key and c.name != meta.time_column]
        ts = [col(meta.time_column).alias("ts")] if meta.time_column else []
        out[name] = with_node_id(ds.tables[name], meta).select(F.col("__node").alias("node"), *ts, *[col(c) for c in feats])
    return out


def node_counts(nodes: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("node_type"), "n") for name, df in nodes.items()])


def _both_ways(rows: DataFrame, src_type: str, dst_type: str, middle: str, extra: Sequence[str] = ()) -> DataFrame:
    """Edges and their reverses; between equal types one bidirectional type is used."""
    fwd = f"{src_type}:{middle}:{dst_type}"
    rev = fwd if src_type == dst_type else f"{dst_type}:reverse_{middle}:{src_type}"
    keep = rows.filter((F.col("s") != -1) & (F.col("d") != -1))  # null keys drop out as well
    more = [col(c) for c in extra]
    # both directions from one scan
    ends = F.explode(F.array(
        F.struct(F.lit(fwd).alias("etype"), F.lit(src_type).alias("src_type"), F.col("s").alias("src"),
                 F.lit(dst_type).alias("dst_type"), F.col("d").alias("dst")),
        F.struct(F.lit(rev).alias("etype"), F.lit(dst_type).alias("src_type"), F.col("d").alias("src"),
                 F.lit(src_type).alias("dst_type"), F.col("s").alias("dst")),
    )).alias("e")
    return keep.select(ends, *more).select("e.*", *more)


def build_edges(ds: RelationalDataset, relation_as_edge: bool = True) -> DataFrame:
    """(etype, src_type, src, dst_type, dst) of all foreign keys and edge tables, both ways."""
    parts = []
    links = {(r.child, r.fk): r.parent for r in ds.relationships()}
    for name, meta in ds.meta.items():
        df = ds.tables[name]
        if is_edge_table(meta, relation_as_edge):
            a, b = meta.foreign_keys
            rows = df.select(col(a).cast("long").alias("s"), col(b).cast("long").alias("d"))
            parts.append(_both_ways(rows, links[(name, a)], links[(name, b)], name))
            continue
        fks = [k for k in meta.foreign_keys if (name, k) in links]
        if not fks:
            continue
        ids = with_node_id(df, meta)
        for k in fks:
            rows = ids.select(F.col("__node").alias("s"), col(k).cast("long").alias("d"))
            parts.append(_both_ways(rows, name, links[(name, k)], f"{name}-{k}"))
    if not parts:
        raise ValueError("no foreign keys: the dataset has no edges")
    return reduce(DataFrame.unionByName, parts)


def edge_features(ds: RelationalDataset, table: str) -> DataFrame:
    """An edge table's columns on both directions, its time column as the edge timestamp.

    Without a time column the timestamp is 0; ``group_id`` ties forward and reverse features.
    """
    meta = ds.meta[table]
    if not is_edge_table(meta):
        raise ValueError(f"{table} is not an edge table")
    links = {r.fk: r.parent for r in ds.forward(table)}
    a, b = meta.foreign_keys
    feats = [c.name for c in meta.columns if not c.is_key and c.name != meta.time_column]
    ts = S.epoch_nanos(meta.time_column) if meta.time_column else F.lit(0).cast("long")
    rows = ds.tables[table].select(col(a).cast("long").alias("s"), col(b).cast("long").alias("d"), ts.alias("ts"), *[col(c) for c in feats])
    return _both_ways(rows, links[a], links[b], table, ["ts", *feats]).withColumn("group_id", F.lit(table))


def graph_task(ds: RelationalDataset, task: TaskMeta, rows: DataFrame) -> DataFrame:
    """Seeds of a task by its keys: one key gives node seeds, a primary key beside others node
    seeds of the target table, two foreign keys edge seeds.  A seed of -1 is an error."""
    meta = ds.meta[task.target_table]
    links = {r.fk: r.parent for r in ds.forward(task.target_table)}
    keys = list(task.keys)
    pk = meta.primary_key
    if len(keys) == 1:
        kind, seeds = "node", [(pk and keys[0] == pk and task.target_table or links.get(keys[0], task.target_table), keys[0])]
    elif pk in keys:
        kind, seeds = "node", [(task.target_table, pk)]
    elif len(keys) == 2:
        kind, seeds = ("edge" if is_edge_table(meta) else "pair"), [(links[k], k) for k in keys]
    else:
        raise ValueError(f"cannot seed a task with keys {keys}")
    bad = reduce(lambda x, y: x | y, [(col(k).isNull()) | (col(k) == -1) for _, k in seeds])
    if not rows.filter(bad).isEmpty():
        raise ValueError("seeds contain missing keys")
    cols: list[Column] = [F.lit(kind).alias("kind")]
    for i, (node_type, k) in enumerate(seeds):
        suffix = "" if len(seeds) == 1 else f"_{i}"
        cols += [F.lit(node_type).alias(f"seed_type{suffix}"), col(k).cast("long").alias(f"seed{suffix}")]
    if task.target_column:
        cols.append(col(task.target_column).alias("label"))
    if task.time_column:
        cols.append(S.epoch_nanos(task.time_column).alias("seed_ts"))
    used = {k for _, k in seeds} | {task.target_column, task.time_column}
    return rows.select(*cols, *[col(c) for c in rows.columns if c not in used and c != "split"],
                       *([F.col("split")] if "split" in rows.columns else []))


# ---------------------------------------------------------------- sampling


def _in_edges(edges: DataFrame, seeds: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Edges pointing at the seeds: the seed side is distinct, so a hub is only split, never multiplied."""
    s = seeds.select(F.col("node_type").alias("__t"), F.col("node").alias("__n"), *[col(c) for c in carry])
    return edges.join(s, (F.col("dst_type") == F.col("__t")) & (F.col("dst") == F.col("__n")), "inner").drop("__t", "__n")


def _hashed(edges: DataFrame, seed: int | str) -> DataFrame:
    """Sampling priority of each edge: one hash per edge, whatever seeds reach it."""
    return edges.withColumn("__h", S.stable_hash(seed, "etype", "src", "dst"))


def _fan(edges: DataFrame, by: Sequence[str], fanout: int | None) -> DataFrame:
    """At most ``fanout`` edges per group in hash order; None or a negative number keeps all."""
    if fanout is None or fanout < 0:
        return edges
    return top_per_group(edges, by, [F.col("__h"), F.col("src"), F.col("eid")], fanout, "__rn").drop("__rn")


def _hop(got: DataFrame, hop: int, more: bool, columns: Sequence[str]) -> DataFrame:
    """The edges of one hop; a hop that feeds another is written, so its sampling runs once."""
    block = got.select(F.lit(hop).alias("hop"), *[col(c) for c in columns])
    return materialize(block) if more else block


def with_edge_id(edges: DataFrame) -> DataFrame:
    """Edge id from the edge itself; repeated edges share it."""
    return edges.withColumn("eid", F.xxhash64("etype", "src", "dst")) if "eid" not in edges.columns else edges


def neighbor_sample(
    edges: DataFrame, node_times: DataFrame | None, seeds: DataFrame, fanouts: Sequence[int | None], threshold: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """(hop, etype, src_type, src, dst_type, dst, eid) of up to fanout in-edges per node and edge type.

    Edges with an endpoint later than ``threshold`` are removed after sampling; nodes without
    a time are kept.  ``seeds`` (node_type, node); ``node_times`` (node_type, node, ts).
    Hop 0 starts at the seeds with the last fanout.
    """
    edges = with_edge_id(edges)
    frontier = seeds.select("node_type", "node").distinct()
    blocks = None
    for hop, fanout in enumerate(reversed(list(fanouts))):
        got = _fan(_in_edges(_hashed(edges, f"{seed}:{hop}"), frontier), ["etype", "dst"], fanout)
        if node_times is not None and threshold is not None:
            for side in ("src", "dst"):
                tm = node_times.select(F.col("node_type").alias("__t"), F.col("node").alias("__n"), F.col("ts").alias("__ts"))
                got = got.join(tm, (F.col(f"{side}_type") == F.col("__t")) & (F.col(side) == F.col("__n")), "left").filter(
                    F.col("__ts").isNull() | (F.col("__ts") <= threshold)).drop("__t", "__n", "__ts")
        block = _hop(got, hop, hop + 1 < len(fanouts), ["etype", "src_type", "src", "dst_type", "dst", "eid"])
        blocks = block if blocks is None else blocks.unionByName(block)
        frontier = frontier.unionByName(block.select(F.col("src_type").alias("node_type"), F.col("src").alias("node"))).distinct()
    return blocks


#: before every time: neighbours without one suit every seed
_UNTIMED = -(1 << 62)
#: no end to an edge's time on a list
_FOR_GOOD = (1 << 63) - 1
_LISTED = "etype string, src_type string, src long, dst_type string, dst long, eid long, __ts long, __h long, __part int, __until long"


def lowest_over_time(edges: DataFrame, k: int) -> DataFrame:
    """Edges that are ever among the ``k`` lowest of their (etype, dst), with ``__until``.

    ``edges`` carry ``__ts`` (long) and ``__h``.  An edge is on its node's list from its own time
    until the k-th lower one arrives (null: for good); at any time the list holds the sample of
    all edges up to then.  A list is built in one pass over sorted rows that keeps k edges in
    memory, and as hashes are random, a node with n edges has about k (1 + ln(n/k)) such edges.
    A hub is first cut into parallel parts: an edge that misses the list of its part misses
    the whole list too.
    """
    names = [f.split(" ")[0] for f in _LISTED.split(", ")]

    def scan(batches):
        held = None  # the lowest of the node that the last batch ended in
        for b in batches:
            open_rows = held.num_rows if held else 0
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0] if open_rows else b
            n = b.num_rows
            if not n:
                continue
            dst, ts, h, part = (b.column(j).to_numpy() for j in (4, 6, 7, 8))
            etype = b.column(0).dictionary_encode().indices.to_numpy()
            new = (etype[1:] != etype[:-1]) | (dst[1:] != dst[:-1]) | (part[1:] != part[:-1])
            ends = np.append(np.flatnonzero(new) + 1, n)
            begins = np.append(0, ends[:-1])
            listed, until = np.ones(n, bool), np.full(n, _FOR_GOOD)
            hashes, times = h.tolist(), ts.tolist()
            srcs, eids = b.column(2).to_pylist(), b.column(5).to_pylist()
            large = ends - begins > k  # others keep all their edges
            for lo, hi in zip(begins[large].tolist(), ends[large].tolist()):
                top = [(-hashes[i], -srcs[i], -eids[i], -i) for i in range(lo, lo + k)]
                heapq.heapify(top)  # the worst edge kept is on top of the heap
                for i in range(lo + k, hi):
                    if hashes[i] > -top[0][0]:
                        listed[i] = False
                        continue
                    key = (-hashes[i], -srcs[i], -eids[i], -i)
                    if top[0] < key:
                        gone = -heapq.heapreplace(top, key)[3]
                        until[gone] = times[i]
                        listed[gone] = times[gone] < times[i]
                    else:
                        listed[i] = False
            last = np.arange(n) >= begins[-1]
            still = np.flatnonzero(last & listed & (until == _FOR_GOOD))
            held = b.take(pa.array(still))
            listed[still] = False
            yield ended(b.take(pa.array(np.flatnonzero(listed))), until[listed])
        if held:
            yield ended(held, np.full(held.num_rows, _FOR_GOOD))

    def ended(rows: pa.RecordBatch, until: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(until, mask=until == _FOR_GOOD)], names=names)

    width = widen(edges.sparkSession, [edges])

    def lists(df: DataFrame) -> DataFrame:
        group = ["etype", "dst", "__part"]
        return df.select(*names[:-1]).repartition(width, *group).sortWithinPartitions(*group, "__ts", "__h", "src", "eid").mapInArrow(scan, _LISTED)

    edges = edges.withColumn("__part", F.lit(0))
    hot, small = hot_groups(edges, ["etype", "dst"])
    if hot is not None:
        hot = F.broadcast(hot) if small else hot
        hub = (F.col("etype") == F.col("__k0")) & (F.col("dst") == F.col("__k1"))
        parts = max(16, shuffle_width(edges))
        hubs = edges.join(hot, hub, "left_semi").withColumn("__part", F.pmod(F.xxhash64("src", "eid"), F.lit(parts)).cast("int"))
        first = lists(hubs).drop("__until").withColumn("__part", F.lit(0))
        edges = edges.join(hot, hub, "left_anti").select(*first.columns).unionByName(first)
    return lists(edges).drop("__part")


def neighbor_sample_temporal(
    edges: DataFrame, node_times: DataFrame, seeds: DataFrame, fanouts: Sequence[int | None], seed: int = 0
) -> DataFrame:
    """Per-seed times: only neighbours at or before the seed's time are candidates, and sampled
    nodes inherit it.  ``seeds`` (node_type, node, seed_ts).

    A node's samples at all times are one short list of edges with the ranges of time in which
    they are drawn (``lowest_over_time``), so a seed meets that list and never the hub's edges.
    Neighbours without a time suit every seed.  Without a fanout every earlier edge is wanted.
    """
    edges = with_edge_id(edges)
    tm = node_times.select(F.col("node_type").alias("__t"), F.col("node").alias("__n"), F.col("ts").cast("long").alias("__ts"))
    timed = edges.join(tm, (F.col("src_type") == F.col("__t")) & (F.col("src") == F.col("__n")), "left").drop("__t", "__n")
    timed = timed.withColumn("__ts", F.coalesce("__ts", F.lit(_UNTIMED).cast("long")))
    frontier = seeds.select("node_type", "node", "seed_ts").distinct()
    blocks = None
    widen(edges.sparkSession, [edges, seeds])
    for hop, fanout in enumerate(reversed(list(fanouts))):
        # written, as the lists, their check for hubs and the sampling read them
        frontier = materialize(frontier)
        reached = materialize(_in_edges(timed, frontier.select("node_type", "node").distinct()))
        if fanout is None or fanout < 0:
            listed = reached.withColumn("__until", F.lit(None).cast("long"))
        else:
            listed = lowest_over_time(_hashed(reached, f"{seed}:{hop}"), fanout) if fanout else reached.filter("false").withColumn("__until", F.col("__ts"))
        got = _in_edges(listed, frontier, ["seed_ts"]).filter(
            (F.col("__ts") <= F.col("seed_ts")) & (F.col("__until").isNull() | (F.col("seed_ts") < F.col("__until"))))
        block = _hop(got, hop, hop + 1 < len(fanouts), ["etype", "src_type", "src", "dst_type", "dst", "seed_ts", "eid"])
        blocks = block if blocks is None else blocks.unionByName(block)
        frontier = frontier.unionByName(
            block.select(F.col("src_type").alias("node_type"), F.col("src").alias("node"), "seed_ts")).distinct()
    return blocks


def khop_subgraph(
    edges: DataFrame, node_times: DataFrame | None, seeds: DataFrame, fanouts: Sequence[int | None], threshold: int | None = None,
    exclude: DataFrame | None = None, seed: int = 0,
) -> DataFrame:
    """The subgraph induced on all reached nodes, minus excluded edge ids."""
    edges = with_edge_id(edges)
    walk = neighbor_sample(edges, node_times, seeds, fanouts, threshold, seed)
    nodes = seeds.select("node_type", "node").unionByName(
        walk.select(F.col("src_type").alias("node_type"), F.col("src").alias("node"))).distinct()
    out = edges
    for side in ("src", "dst"):
        n = nodes.select(F.col("node_type").alias("__t"), F.col("node").alias("__n"))
        out = out.join(n, (F.col(f"{side}_type") == F.col("__t")) & (F.col(side) == F.col("__n")), "left_semi")
    return out if exclude is None else out.join(exclude.select("eid"), "eid", "left_anti")
