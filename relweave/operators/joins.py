"""Key-graph joins: direct features, aggregates below joins, point-in-time joins, key walks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from relweave.functions.scalar import col
from relweave.model import FOREIGN_KEY, ColumnMeta, ForeignKey, RelationalDataset, TableMeta
from relweave.plans.ordering import hot_groups, running, shuffle_width, small_side, widen
from relweave.plans.pointintime import MANY_CUTOFFS, Spec, always, before, clock, instant
from relweave.session import materialize


def unique_parent(parent: DataFrame, pk: str, columns: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key; of duplicates the lowest by ``order`` then by the carried columns.

    Min-of-struct is partially aggregated before the shuffle, unlike a ranking window.
    """
    rest = [c for c in dict.fromkeys([*order, *columns]) if c != pk]
    if not rest:
        return parent.select(col(pk)).distinct()
    best = parent.groupBy(col(pk)).agg(F.min(F.struct(*[col(c) for c in rest])).alias("__s"))
    return best.select(col(pk), *[col(c) if c == pk else F.col("__s")[c].alias(c) for c in columns if c != pk])


def direct_feature(
    child: DataFrame, parent: DataFrame, fk: str, pk: str, columns: dict[str, str], dedup: bool = False
) -> DataFrame:
    """Left join carrying parent columns (name in parent -> output name) to the child."""
    src = unique_parent(parent, pk, list(columns)) if dedup else parent
    right = src.select(col(pk).alias("__pk"), *[col(c).alias(a) for c, a in columns.items()])
    return child.join(right, col(fk) == F.col("__pk"), "left").drop("__pk")


def backward_aggregate(
    target: DataFrame, child: DataFrame, pk: str, fk: str, aggs: dict[str, Column],
    counts: Sequence[str] = (),
) -> DataFrame:
    """Group the child below the join, then left join; names in ``counts`` become 0 when absent."""
    grouped = child.filter(col(fk).isNotNull()).groupBy(col(fk).alias("__fk")).agg(
        *[a.alias(n) for n, a in aggs.items()]
    )
    out = target.join(grouped, col(pk) == F.col("__fk"), "left").drop("__fk")
    return out.withColumns({n: F.coalesce(col(n), F.lit(0)) for n in counts}) if counts else out


def skip_backward_aggregate(
    target: DataFrame, pk: str, middle: DataFrame, middle_fk: str, middle_pk: str,
    child: DataFrame, child_fk: str, aggs: dict[str, Column], counts: Sequence[str] = (),
) -> DataFrame:
    """Aggregate grandchildren per target key; a middle row without children keeps its group.

    Rows the aggregates read carry ``__m`` = 1 for a present grandchild.
    """
    up = middle.select(col(middle_fk).alias("__t"), col(middle_pk).alias("__p")).filter("__t is not null")
    down = child.withColumn("__m", F.lit(1))
    rows = up.join(down, F.col("__p") == col(child_fk), "left")
    grouped = rows.groupBy("__t").agg(*[a.alias(n) for n, a in aggs.items()])
    out = target.join(grouped, col(pk) == F.col("__t"), "left").drop("__t")
    return out.withColumns({n: F.coalesce(col(n), F.lit(0)) for n in counts}) if counts else out


def cutoff_pairs(rows: DataFrame, key: str, cutoff: str) -> DataFrame:
    """Distinct (key, cutoff): the unit of point-in-time work."""
    return rows.select(col(key), col(cutoff)).distinct()


def asof_join(
    pairs: DataFrame, child: DataFrame, key: str, cutoff: str, fk: str, ts: str | None,
    columns: Sequence[str], inclusive: bool = False, how: str = "left",
) -> DataFrame:
    """Child rows strictly before each pair's cutoff: equi key plus a residual range.

    The result itself holds a row per pair and child row; aggregates of it are better asked of
    ``asof_aggregate``, which never forms those rows.
    """
    right = child.select(col(fk).alias("__fk"), *([col(ts).alias("__ts")] if ts else []), *[col(c) for c in columns])
    cond = col(key) == F.col("__fk")
    if ts:
        cond = cond & ((F.col("__ts") <= col(cutoff)) if inclusive else (F.col("__ts") < col(cutoff)))
    return pairs.join(right, cond, how).drop("__fk", "__ts")


def asof_aggregate(
    pairs: DataFrame, child: DataFrame, key: str, cutoff: str, fk: str, ts: str, specs: Sequence[Spec],
    inclusive: bool = False, counts: Sequence[str] = (),
) -> DataFrame:
    """Aggregates of the child rows before each distinct (key, cutoff): the grouped point-in-time join.

    Rows and cutoffs of a key are merged into one stream with running states, so n rows and m
    cutoffs cost n + m, and a hot key is cut into time buckets.  Pairs without an earlier row keep
    nulls (0 for names in ``counts``); a null key or cutoff sees nothing.
    """
    how = clock([pairs.schema[cutoff].dataType, child.schema[ts].dataType])
    probes = pairs.select(col(key).alias("__key"), instant(col(cutoff), how).alias("__at"))
    used = dict.fromkeys(s.source for s in specs if s.source)
    events = child.select(col(fk).alias("__key"), instant(col(ts), how).alias("__at"), *[col(c) for c in used])
    found = before(probes, events, specs, inclusive)
    cond = (col(key) == F.col("__key")) & (instant(col(cutoff), how) == F.col("__at"))
    out = pairs.join(found, cond, "left").drop("__key", "__at")
    return out.withColumns({n: F.coalesce(col(n), F.lit(0).cast("long")) for n in counts}) if counts else out


def propagate_cutoff(
    pairs: DataFrame, table: DataFrame, key: str, cutoff: str, on: str, carry: Sequence[str],
    ts: str | None, forward: bool, inclusive: bool = False,
) -> DataFrame:
    """(keys, cutoff) of a single hop; distinct after a forward hop only.  Chains use ``follow``."""
    out = asof_join(pairs, table, key, cutoff, on, ts, carry, inclusive).select(
        *[col(c) for c in carry], col(cutoff)
    )
    return out.distinct() if forward else out


@dataclass(frozen=True)
class Visibility:
    """What a set of (key, cutoff) pairs sees of a table, kept per key and not per cutoff.

    ``nodes``: (__key, __node, __since), each node once per key with the earliest instant that sees
    it; a cutoff after ``__since`` sees the node.  ``blanks``: (__key, __since, __until), ranges of
    cutoffs that see a row above but nothing here (null ``__until``: for good).
    """

    nodes: DataFrame
    blanks: DataFrame
    how: str


def start_visibility(pairs: DataFrame, key: str, cutoff: str, times: Sequence[T.DataType] = ()) -> Visibility:
    """Every key of the pairs, in sight from the beginning; ``times`` are the types of later time columns."""
    how = clock([pairs.schema[cutoff].dataType, *times])
    keys = pairs.select(col(key).alias("__key")).distinct()
    nodes = keys.select("__key", F.col("__key").alias("__node"), always(how).alias("__since"))
    blanks = nodes.select("__key", "__since", F.col("__since").alias("__until")).filter("false")
    return Visibility(nodes, blanks, how)


def follow(seen: Visibility, table: DataFrame, on: str, carry: str, ts: str | None) -> Visibility:
    """One hop: rows of ``table`` whose ``on`` is a visible node, as nodes named by ``carry``.

    A row is in sight once the node above and its own time are, so a hop keeps the least such
    instant per (key, node): its rows are bounded by distinct (key, node), whatever the cutoffs.
    """
    own = instant(col(ts), seen.how) if ts else always(seen.how)
    rows = table.select(col(on).alias("__on"), col(carry).alias("__next"), own.alias("__own"))
    rows = rows.filter("__on IS NOT NULL AND __own IS NOT NULL")
    met = seen.nodes.join(rows, F.col("__node") == F.col("__on"))
    nodes = met.groupBy("__key", F.col("__next").alias("__node")).agg(F.min(F.greatest("__since", "__own")).alias("__since"))
    # until its first row comes into sight, a node above stands there with nothing below it
    first = seen.nodes.join(rows.groupBy("__on").agg(F.min("__own").alias("__own")), F.col("__node") == F.col("__on"), "left")
    blanks = first.select("__key", "__since", F.when(F.col("__own").isNotNull(), F.greatest("__since", "__own")).alias("__until"))
    blanks = blanks.filter("__until IS NULL OR __until > __since").groupBy("__key", "__until").agg(F.min("__since").alias("__since"))
    blanks = seen.blanks.unionByName(blanks.select("__key", "__since", "__until"))
    # both read these nodes, and so does the next hop
    return Visibility(materialize(nodes), blanks, seen.how)


# rows that a task makes of its nodes and their cutoffs, at most
EXPANDED_ROWS = 2_000_000


def expand_visibility(
    pairs: DataFrame, seen: Visibility, key: str, cutoff: str, out: str, inclusive: bool = False
) -> DataFrame:
    """Distinct (node, cutoff) that the pairs reach: the one place where keys meet their cutoffs."""
    at = pairs.select(col(key).alias("__pk"), col(cutoff), instant(col(cutoff), seen.how).alias("__at"))
    after = (lambda c: F.col("__at") >= c) if inclusive else (lambda c: F.col("__at") > c)
    asks, nodes = small_side(at), seen.nodes
    # a node meets all cutoffs of its keys in one task, and tasks follow the rows that makes
    most = asks.groupBy("__pk").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    nodes = nodes.repartition(max(shuffle_width(nodes), nodes.count() * most // EXPANDED_ROWS), "__node")
    found = nodes.join(asks, (F.col("__pk") == F.col("__key")) & after(F.col("__since"))).select(F.col("__node").alias(out), col(cutoff))
    # a cutoff lies in some blank range if more of its key's ranges have begun than ended
    turn = F.lit(0 if inclusive else 1)
    one = F.lit(1).cast("long")
    marks = seen.blanks.select("__key", F.col("__since").alias("__at"), turn.alias("__turn"), one.alias("__open")).unionByName(
        seen.blanks.filter("__until IS NOT NULL").select("__key", F.col("__until").alias("__at"), turn.alias("__turn"), (-one).alias("__open")))
    marks = materialize(marks.groupBy("__key", "__at", "__turn").agg(F.sum("__open").alias("__open")))
    asked = at.filter("__at IS NOT NULL").select(F.col("__pk").alias("__key"), "__at", (1 - turn).alias("__turn"), col(cutoff), F.lit(True).alias("__probe"))
    blank = running(marks.unionByName(asked, allowMissingColumns=True), ["__at", "__turn"], ["__key"], {"__open": "sum"})
    # a missing cutoff is after nothing, so it sees nothing
    blank = blank.filter("__probe AND __open > 0").select(col(cutoff)).unionByName(at.filter("__at IS NULL").select(col(cutoff)))
    none = F.lit(None).cast(dict(seen.nodes.dtypes)["__node"])
    return found.unionByName(blank.select(none.alias(out), col(cutoff))).distinct()


def reach(
    pairs: DataFrame, key: str, cutoff: str, hops: Sequence[tuple[DataFrame, str, str, str | None]], out: str, inclusive: bool = False
) -> DataFrame:
    """Distinct (node, cutoff) at the end of a chain of hops ``(table, on, carry, time column)``.

    Keys of few cutoffs join their rows with them, so a row meets at most ``MANY_CUTOFFS``; keys of
    more go by visibility, where a hop keeps one row per key and node.
    """
    def chained(some: DataFrame) -> DataFrame:
        cur, at = some, key
        for i, (table, on, carry, ts) in enumerate(hops):
            step = table.select(col(on).alias("__on"), col(carry).alias(f"__c{i}"), *([col(ts).alias("__when")] if ts else []))
            cur = propagate_cutoff(cur, step, at, cutoff, "__on", [f"__c{i}"], "__when" if ts else None, False, inclusive)
            at = f"__c{i}"
        return cur.select(col(at).alias(out), col(cutoff)).distinct()

    def seen(some: DataFrame) -> DataFrame:
        vis = start_visibility(some, key, cutoff, [t.schema[ts].dataType for t, _, _, ts in hops if ts])
        for table, on, carry, ts in hops:
            vis = follow(vis, table, on, carry, ts)
        return expand_visibility(some, vis, key, cutoff, out, inclusive)

    widen(pairs.sparkSession, [table for table, *_ in hops])
    many, small = hot_groups(pairs, [key], MANY_CUTOFFS)
    if many is None:
        return chained(pairs)
    many = F.broadcast(many) if small else many
    # a null key is never many: it sees nothing, whatever its cutoffs
    few = chained(pairs.join(many, col(key) == F.col("__k0"), "left_anti"))
    return few.unionByName(seen(pairs.join(many, col(key) == F.col("__k0"), "left_semi"))).distinct()


def cutoff_feature_join(
    rows: DataFrame, features: DataFrame, key: str, cutoff: str, feature_key: str, feature_cutoff: str,
    columns: Sequence[str],
) -> DataFrame:
    """Attach features computed per (key, cutoff)."""
    right = features.select(col(feature_key).alias("__k"), col(feature_cutoff).alias("__c"), *[col(c) for c in columns])
    cond = (col(key) == F.col("__k")) & col(cutoff).eqNullSafe(F.col("__c"))
    return rows.join(right, cond, "left").drop("__k", "__c")


def merge_features(task: DataFrame, row_id: str, parts: Sequence[DataFrame]) -> DataFrame:
    """Left joins of per-path results on the task row id (each part has one row per id)."""
    def one(left: DataFrame, part: DataFrame) -> DataFrame:
        right = part.withColumnRenamed(row_id, "__rid")
        return left.join(right, col(row_id) == F.col("__rid"), "left").drop("__rid")

    return reduce(one, parts, task)


def selfloop_edges(df: DataFrame, fks: Sequence[str], pk: str) -> tuple[DataFrame, DataFrame]:
    """(edge rows, table without its self-referencing keys): two projections of one scan."""
    return df.select(*[col(f) for f in fks], col(pk)), df.drop(*fks)


def selfloop_tables(ds: RelationalDataset, table: str) -> RelationalDataset:
    """Replace the self loops of a table by an edge table ``<table>_selfloop``."""
    loops = [r for r in ds.forward(table) if r.parent == table]
    if not loops:
        return ds
    pk, fks = loops[0].pk, [r.fk for r in loops]
    edges, base = selfloop_edges(ds.tables[table], fks, pk)
    meta = ds.meta[table]
    link = f"{table}.{pk}"
    edge_meta = TableMeta(
        f"{table}_selfloop", tuple(ColumnMeta(c, FOREIGN_KEY, link) for c in [*fks, pk]), None
    )
    base_meta = replace(meta, columns=tuple(c for c in meta.columns if c.name not in fks))
    return ds.with_table(base_meta, base).with_table(edge_meta, edges)


def has_duplicate_keys(df: DataFrame, key: str) -> bool:
    """True when a task primary key repeats, so it acts as a foreign key.

    The answer needs one row per distinct key, not one buffer of all keys.
    """
    return not df.groupBy(col(key)).count().filter("count > 1").isEmpty()


def ensure_parent(children: Sequence[tuple[DataFrame, str]], pk: str) -> DataFrame:
    """Dummy parent table: distinct union of every foreign key referring to it."""
    parts = [df.select(col(fk).alias(pk)).filter(col(pk).isNotNull()) for df, fk in children]
    return reduce(DataFrame.unionByName, parts).distinct()


def ensure_parents(ds: RelationalDataset) -> RelationalDataset:
    """Add every referenced but absent parent table."""
    wanted: dict[str, set[str]] = {}
    for r in ds.relationships():
        if r.parent not in ds.meta:
            wanted.setdefault(r.parent, set()).add(r.pk)
    for parent, pks in wanted.items():
        if len(pks) > 1:
            raise ValueError(f"several primary key columns referenced in {parent}: {sorted(pks)}")
        (pk,) = pks
        kids = [(ds.tables[r.child], r.fk) for r in ds.relationships() if r.parent == parent]
        ds = ds.with_table(TableMeta(parent, (ColumnMeta(pk, "primary_key"),)), ensure_parent(kids, pk))
    return ds


def mean_std(df: DataFrame, by: str, columns: dict[str, str], population: bool) -> DataFrame:
    """Mean and standard deviation per key; ``columns`` maps source column to output prefix."""
    std = F.stddev_pop if population else F.stddev_samp
    aggs: list[Column] = []
    for c, prefix in columns.items():
        aggs += [F.avg(col(c)).alias(f"{prefix}_mean"), std(col(c)).alias(f"{prefix}_std")]
    return df.filter(col(by).isNotNull()).groupBy(col(by)).agg(*aggs)


def bridge_join(
    target: DataFrame, target_pk: str, bridge: DataFrame, bridge_fk: str, bridge_pk: str,
    leaf: DataFrame, leaf_fk: str, columns: dict[str, str],
) -> DataFrame:
    """Two hops up: leaf statistics per bridge foreign key (sample std), joined to the target."""
    mid = bridge.select(col(bridge_pk).alias("__b"), col(bridge_fk).alias("__t"))
    rows = leaf.join(mid, col(leaf_fk) == F.col("__b"), "inner")
    stats = mean_std(rows, "__t", columns, population=False)
    return target.join(stats, col(target_pk) == F.col("__t"), "left").drop("__t")


def join_related(
    ds: RelationalDataset, focal: str, tables: Sequence[str], features: dict[str, Sequence[str]]
) -> DataFrame:
    """Join features of related tables outward from the focal table.

    ``tables`` is the visiting order (parents before children); ``features`` lists the
    feature columns of each table.  Parents merge directly, children contribute mean and
    population std, a two-hop child comes in over its bridge table.
    """
    out = ds.tables[focal]
    joined = [focal]
    rels = ds.relationships()
    for t in tables:
        cols = list(features.get(t, ()))
        keys = [c for c in ds.meta[t].foreign_keys if c not in cols]
        up = next((r for j in joined for r in rels if r.child == j and r.parent == t and r.fk in out.columns), None)
        down = next((r for j in joined for r in rels if r.child == t and r.parent == j and r.pk in out.columns), None)
        if up:
            names = {c: f"{t}_{c}" for c in cols} | {k: k for k in keys if k not in out.columns}
            out = direct_feature(out, ds.tables[t], up.fk, up.pk, names, dedup=True)
        elif down and cols:
            stats = mean_std(ds.tables[t], down.fk, {c: f"{t}_{c}" for c in cols}, population=True)
            out = out.join(stats.withColumnRenamed(down.fk, "__fk"), col(down.pk) == F.col("__fk"), "left").drop("__fk")
        elif cols:
            hop = next(
                (
                    (leaf, mid) for leaf in rels if leaf.child == t
                    for mid in rels if mid.child == leaf.parent and mid.parent in joined and mid.pk in out.columns
                ),
                None,
            )
            if hop:
                leaf, mid = hop
                out = bridge_join(out, mid.pk, ds.tables[mid.child], mid.fk, leaf.pk, ds.tables[t], leaf.fk,
                                  {c: f"{t}_{c}" for c in cols})
        joined.append(t)
    return out


def shortest_path(ds: RelationalDataset, start: str, end: str) -> list[tuple[ForeignKey, bool]]:
    """Hops of the shortest key path; True marks a forward (to-one) hop.  Metadata only."""
    frontier = [(start, [])]
    seen = {start}
    while frontier:
        nxt = []
        for table, path in frontier:
            if table == end:
                return path
            steps = [(r.parent, (r, True)) for r in ds.forward(table)]
            steps += [(r.child, (r, False)) for r in ds.backward(table)]
            for other, step in steps:
                if other not in seen:
                    seen.add(other)
                    nxt.append((other, [*path, step]))
        frontier = nxt
    raise ValueError(f"no key path from {start} to {end}")


def walk_keys(ds: RelationalDataset, start: str, end: str, terminal: Sequence[str] = ()) -> DataFrame:
    """Focal key to terminal rows along the shortest key path, carrying keys only.

    Output: ``focal_pk``, ``terminal_pk`` and the wanted ``terminal`` columns.
    """
    path = shortest_path(ds, start, end)
    meta = ds.meta
    pk0 = meta[start].primary_key
    cur = ds.tables[start].select(
        col(pk0).alias("focal_pk"), *[col(k).alias(f"k_{k}") for k in meta[start].foreign_keys],
        col(pk0).alias("__here"),
    )
    here = start
    for i, (r, forward) in enumerate(path):
        nxt = r.parent if forward else r.child
        m = meta[nxt]
        last = i == len(path) - 1
        pk = m.primary_key
        take = [(col(pk) if pk else F.lit(None).cast("long")).alias("__next")]
        take += [col(k).alias(f"n_{k}") for k in m.foreign_keys]
        if last:
            take += [col(c).alias(f"t_{c}") for c in terminal]
        right = ds.tables[nxt].select(col(r.pk if forward else r.fk).alias("__on"), *take)
        left_key = F.col(f"k_{r.fk}") if forward else F.col("__here")
        cur = cur.join(right, left_key == F.col("__on"), "left").select(
            "focal_pk",
            *[F.col(f"n_{k}").alias(f"k_{k}") for k in m.foreign_keys],
            F.col("__next").alias("__here"),
            *([F.col(f"t_{c}") for c in terminal] if last else []),
        )
        here = nxt
    if not path:
        cur = ds.tables[start].select(col(pk0).alias("focal_pk"), col(pk0).alias("__here"),
                                      *[col(c).alias(f"t_{c}") for c in terminal])
    return cur.select("focal_pk", F.col("__here").alias("terminal_pk"), *[F.col(f"t_{c}").alias(c) for c in terminal])


def terminal_lookup(walk: DataFrame, table: DataFrame, pk: str, columns: Sequence[str]) -> DataFrame:
    """Attach terminal columns through the terminal key."""
    return direct_feature(walk, table, "terminal_pk", pk, {c: c for c in columns})


def fk_semi_filter(ds: RelationalDataset, roots: dict[str, DataFrame], order: Sequence[str]) -> dict[str, DataFrame]:
    """Rows reachable downwards: every foreign key must point into the kept parent rows.

    ``roots`` gives already filtered tables; ``order`` lists tables parents first.
    """
    kept = dict(roots)
    for t in order:
        if t in kept:
            continue
        df = ds.tables[t]
        for r in ds.forward(t):
            if r.parent in kept:
                keys = kept[r.parent].select(col(r.pk).alias("__pk"))
                df = df.join(keys, col(r.fk) == F.col("__pk"), "left_semi")
        kept[t] = df
    return kept


def parent_entity_ids(rows: DataFrame, fk: str, parent: DataFrame, row_index: str, entity: str, out: str) -> DataFrame:
    """Parent entity of a row-index foreign key; null or out of range gives -1."""
    right = parent.select(col(row_index).alias("__ri"), col(entity).cast("long").alias("__e"))
    return (
        rows.join(right, col(fk) == F.col("__ri"), "left")
        .withColumn(out, F.coalesce("__e", F.lit(-1).cast("long")))
        .drop("__ri", "__e")
    )


def paired_join(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One-to-one join of two result sets; duplicate keys are an error."""
    for side in (left, right):
        if not side.groupBy(*[col(k) for k in keys]).count().filter("count > 1").isEmpty():
            raise ValueError(f"duplicate keys in a one-to-one join on {list(keys)}")
    return left.select(*keys, col(value).alias(f"{value}_left")).join(
        right.select(*keys, col(value).alias(f"{value}_right")), list(keys), "inner"
    )


def drop_false_negatives(negatives: DataFrame, positives: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Generated negatives that exist as positives are removed."""
    return negatives.join(positives.select(*[col(k) for k in keys]), list(keys), "left_anti")
