"""Relational feature synthesis: walk the key graph, aggregate below the joins.

The plan is a tree of table visits.  Every visit yields one DataFrame of table rows carrying
all features of that visit; a child visit is aggregated once per join path with every
primitive together, before it meets its parent.  Column pruning, push-down, join strategy and
skew splitting are left to Catalyst and adaptive execution.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from relweave.functions.scalar import col
from relweave.model import CATEGORY, FLOAT, TEXT, TOKENS, ForeignKey, RelationalDataset
from relweave.operators.aggregates import concat_tokens, join_text, mode_by
from relweave.plans.ordering import hot_groups, widen
from relweave.plans.pointintime import (
    CHANGING_PRIMITIVES, MANY_CUTOFFS, STATIC_PRIMITIVES, Spec, always, before, clock, during, instant,
)
from relweave.session import materialize

DEFAULT_PRIMITIVES = (
    "max", "min", "mean", "count", "mode", "concat", "join", "arraymax", "arraymin", "arraymean",
)
_ARRAY = ("arraymax", "arraymin", "arraymean")
_CUT = "__cut"
_NEVER = "0001-01-01 00:00:00"


@dataclass(frozen=True)
class CustomAgg:
    """A user aggregate: accepted and returned logical dtype and a Column -> Column builder."""

    name: str
    input_dtype: str
    build: Callable[[Column], Column]
    return_dtype: str = FLOAT


@dataclass(frozen=True)
class Feature:
    name: str
    dtype: str
    in_size: int = 1
    origin: tuple[str, str] | None = None  # table, column at the bottom of the chain
    arrays: int = 0
    open_count: bool = False  # only forward hops above the nearest COUNT


@dataclass
class Visit:
    """One table reached by one path, with the features it offers upwards."""

    table: str
    identity: list[Feature] = field(default_factory=list)
    parents: list[tuple[ForeignKey, Visit, dict[str, Feature]]] = field(default_factory=list)
    children: list[tuple[list[ForeignKey], Visit, list[tuple[Feature, object, str | None]]]] = field(
        default_factory=list
    )

    def features(self) -> list[Feature]:
        out = list(self.identity)
        for _, _, mapped in self.parents:
            out += mapped.values()
        for _, _, aggs in self.children:
            out += [f for f, _, _ in aggs]
        return out


def _agg_features(label: str, prims: Sequence, feats: list[Feature]):
    """Features of one backward path; the third item is the child feature it reads."""
    out = []
    for p in prims:
        if p == "count":
            out.append((Feature(f"COUNT({label})", FLOAT, open_count=True), p, None))
            continue
        for f in feats:
            name = p.name if isinstance(p, CustomAgg) else p
            title = f"{name.upper()}({label}.{f.name})"
            if isinstance(p, CustomAgg):
                ok, dtype, size = f.dtype == p.input_dtype and f.in_size == 1, p.return_dtype, 1
            elif p in ("max", "min", "mean"):
                ok, dtype, size = f.dtype == FLOAT and f.in_size == 1, FLOAT, 1
            elif p == "mode":
                ok, dtype, size = f.dtype == CATEGORY, CATEGORY, 1
            elif p == "join":
                ok, dtype, size = f.dtype == TEXT, TEXT, 1
            elif p == "concat":
                ok, dtype, size = f.dtype == TOKENS, TOKENS, 1
            elif p in _ARRAY:
                ok, dtype, size = f.dtype == FLOAT and f.in_size > 1 and f.arrays == 0, FLOAT, f.in_size
            else:
                raise ValueError(f"unknown aggregation primitive {p!r}")
            if ok:
                arrays = f.arrays + (p in _ARRAY if isinstance(p, str) else 0)
                out.append((Feature(title, dtype, size, f.origin, arrays), p, f.name))
    return out


def _backward_paths(ds: RelationalDataset, table: str, length: int, seen: frozenset):
    """Chains of foreign keys leading to ``table`` from below, nearest hop first."""
    for r in ds.backward(table):
        if r.child in seen or r.child == table:
            continue
        yield [r]
        if length > 1:
            for rest in _backward_paths(ds, r.child, length - 1, seen | {r.child}):
                yield [r, *rest]


def _path_label(path: list[ForeignKey], every: list[list[ForeignKey]]) -> str:
    """Child table name, or the whole path when several paths lead to that child."""
    child = path[-1].child
    if sum(p[-1].child == child for p in every) == 1:
        return child
    return ".".join(f"{r.child}[{r.fk}]" for r in path)


def plan_visit(
    ds: RelationalDataset, table: str, depth: int, prims: Sequence, seen: frozenset = frozenset(),
    skip_columns: frozenset = frozenset(),
) -> Visit:
    """Enumerate features of ``table`` up to ``depth``; a path never returns to a table."""
    seen = seen | {table}
    meta = ds.meta[table]
    v = Visit(table)
    for c in meta.columns:
        if c.is_key or (table, c.name) in skip_columns:
            continue
        v.identity.append(Feature(c.name, c.dtype, c.in_size, (table, c.name)))
    if depth <= 0:
        return v
    forward = ds.forward(table)
    for r in forward:
        if r.parent in seen:
            continue
        sub = plan_visit(ds, r.parent, depth - 1, prims, seen, skip_columns)
        twin = [x for x in forward if x.parent == r.parent]
        label = f"{r.parent}[{r.fk}]" if len(twin) > 1 else r.parent
        mapped = {
            f.name: Feature(f"{label}.{f.name}", f.dtype, f.in_size, f.origin, f.arrays, f.open_count)
            for f in sub.features()
        }
        v.parents.append((r, sub, mapped))
    paths = list(_backward_paths(ds, table, depth, seen))
    for path in paths:
        between = seen | {r.child for r in path[:-1]}
        sub = plan_visit(ds, path[-1].child, depth - len(path), prims, between, skip_columns)
        aggs = _agg_features(_path_label(path, paths), prims, sub.features())
        v.children.append((path, sub, aggs))
    return v


def prune(v: Visit, wanted: set[str]) -> Visit:
    """Keep only what the wanted features of this visit need."""
    out = Visit(v.table, [f for f in v.identity if f.name in wanted])
    for r, sub, mapped in v.parents:
        keep = {k: f for k, f in mapped.items() if f.name in wanted}
        if keep:
            out.parents.append((r, prune(sub, set(keep)), keep))
    for path, sub, aggs in v.children:
        keep_aggs = [a for a in aggs if a[0].name in wanted]
        if keep_aggs:
            out.children.append((path, prune(sub, {a[2] for a in keep_aggs if a[2]}), keep_aggs))
    return out


def aggregate_column(prim, c: Column, in_size: int = 1) -> Column:
    """The aggregate expression of one primitive."""
    if isinstance(prim, CustomAgg):
        return prim.build(c)
    if prim == "count":
        return F.count(c)
    if prim == "max":
        return F.max(c)
    if prim == "min":
        return F.min(c)
    if prim == "mean":
        return F.avg(c)
    if prim in _ARRAY:
        # the dimension is fixed and known, so each position is one plain aggregate:
        # partial aggregation works and no row is exploded
        def at(i: int) -> Column:
            filled = F.coalesce(F.get(c, F.lit(i)).cast("double"), F.lit(0.0))
            return {"arraymax": F.max, "arraymin": F.min, "arraymean": F.avg}[prim](filled)

        return F.when(F.count(c) > 0, F.array(*[at(i) for i in range(in_size)]))
    raise ValueError(f"unknown aggregation primitive {prim!r}")


def visited(v: Visit) -> set[str]:
    """Tables that the visit reads, itself included."""
    out = {v.table}.union(*[visited(sub) for _, sub, _ in v.parents], *[visited(sub) for _, sub, _ in v.children])
    return out | {hop.child for path, _, _ in v.children for hop in path}


def moves(ds: RelationalDataset, v: Visit) -> bool:
    """Whether features of the visit depend on the instant they are seen at."""
    return any(ds.meta[r.parent].time_column or moves(ds, sub) for r, sub, _ in v.parents) or any(
        branch_moves(ds, path, sub) for path, sub, _ in v.children)


def branch_moves(ds: RelationalDataset, path: list[ForeignKey], sub: Visit) -> bool:
    return any(ds.meta[hop.child].time_column for hop in path) or moves(ds, sub)


class _Builder:
    def __init__(self, ds: RelationalDataset, uniform_cut: Column | None, has_cut: bool, max_cut: Column | None,
                 inclusive: bool, clock: str = "time"):
        self.ds, self.cut_value, self.has_cut, self.max_cut = ds, uniform_cut, has_cut, max_cut
        self.inclusive, self.clock = inclusive, clock
        self.few = False
        self.per_row = has_cut and uniform_cut is None

    def _before(self, ts: Column, cut: Column) -> Column:
        return ts <= cut if self.inclusive else ts < cut

    def base(self, table: str) -> DataFrame:
        """Table rows, already limited to the latest cutoff so the limit reaches the scan."""
        df = self.ds.tables[table]
        ts = self.ds.meta[table].time_column
        if self.has_cut and ts:
            df = df.filter(self._before(col(ts), self.cut_value if self.cut_value is not None else self.max_cut))
        return df

    def child_rows(self, path: list[ForeignKey], pairs: DataFrame | None) -> DataFrame:
        """Rows of the last child of ``path`` with ``__group`` (key of the first parent).

        ``pairs`` holds the distinct (__key, cutoff) of the parent rows when cutoffs differ.
        """
        first = path[0]
        rows = self.base(first.child)
        ts = self.ds.meta[first.child].time_column
        cur = rows.withColumn("__group", col(first.fk))
        if pairs is not None:
            cond = F.col("__group") == F.col("__key")
            if ts:
                cond = cond & self._before(col(ts), F.col(_CUT))
            cur = cur.join(pairs, cond, "inner").drop("__key")
        else:
            cur = cur.filter(F.col("__group").isNotNull())
        for hop in path[1:]:
            carry = [F.col("__group"), col(hop.pk).alias("__up")]
            if pairs is not None:
                carry.append(F.col(_CUT))
            up = cur.select(*carry)
            down = self.base(hop.child).withColumn("__m", F.lit(1))
            ts = self.ds.meta[hop.child].time_column
            cond = F.col("__up") == col(hop.fk)
            if ts and pairs is not None:
                cond = cond & self._before(col(ts), F.col(_CUT))
            cur = up.join(down, cond, "left").drop("__up")  # a childless parent keeps its group
        return cur

    def expand(
        self, v: Visit, rows: DataFrame, keep: list[str], unique: bool = True, known: dict[str, DataFrame] | None = None
    ) -> DataFrame:
        """Add the features of a visit to its rows; columns are named ``f:<feature>``.

        ``unique`` says that rows do not repeat a (primary key, cutoff); ``known`` holds pairs
        of a key and the cutoff that already cover these rows.
        """
        cut = [_CUT] if self.per_row and _CUT not in keep else []
        need = {r.fk for r, _, _ in v.parents} | {path[0].pk for path, _, _ in v.children}
        out = rows.select(
            *[col(k) for k in [*keep, *cut]], *[col(k).alias(f"__need_{k}") for k in sorted(need)],
            *[col(f.name).alias(f"f:{f.name}") for f in v.identity],
        )
        for r, sub, mapped in v.parents:
            par = self.parent_rows(r, sub, mapped, out)
            cond = F.col(f"__need_{r.fk}") == F.col("__pk")
            if self.per_row:
                cond = cond & (F.col(_CUT) == F.col("__pcut"))
            out = out.join(par, cond, "left").drop("__pk", "__pcut")
        for path, sub, aggs in v.children:
            key = path[0].pk
            pairs = None
            if self.per_row:
                pairs = (known or {}).get(key)
                if pairs is None:
                    pairs = out.select(F.col(f"__need_{key}").alias("__key"), _CUT)
                    pairs = pairs if unique else pairs.distinct()
            agg = self.child_aggregate(path, sub, aggs, pairs)
            cond = F.col(f"__need_{key}") == F.col("__gkey")
            if self.per_row:
                cond = cond & (F.col(_CUT) == F.col("__gcut"))
            out = out.join(agg, cond, "left").drop("__gkey", "__gcut")
        return out.drop(*[f"__need_{k}" for k in need])

    def parent_rows(self, r: ForeignKey, sub: Visit, mapped: dict[str, Feature], rows: DataFrame) -> DataFrame:
        rename = [col(f"f:{k}").alias(f"f:{f.name}") for k, f in mapped.items()]
        par = self.base(r.parent)
        if not self.per_row:
            full = self.expand(sub, par, [r.pk])
            return full.select(col(r.pk).alias("__pk"), *rename)
        # distinct on the forward hop: one parent row per (key, cutoff), not per child row
        pairs = rows.select(F.col(f"__need_{r.fk}").alias("__key"), _CUT).distinct()
        cond = F.col("__key") == col(r.pk)
        ts = self.ds.meta[r.parent].time_column
        if ts:
            cond = cond & self._before(col(ts), F.col(_CUT))
        # without a time limit on the parent its own children can start from the same pairs
        known = {} if ts else {r.pk: pairs}
        full = self.expand(sub, par.join(pairs, cond, "inner").drop("__key"), [r.pk, _CUT], known=known)
        return full.select(col(r.pk).alias("__pk"), F.col(_CUT).alias("__pcut"), *rename)

    def source_moves(self, sub: Visit, name: str) -> bool:
        return moves(self.ds, prune(sub, {name}))

    def runs(self, sub: Visit, prim, source: str | None) -> bool:
        """Whether an aggregate over the visit's rows has a form without pairs of rows and cutoffs."""
        if prim == "count":
            return True
        if not isinstance(prim, str) or prim not in STATIC_PRIMITIVES:
            return False
        if not self.source_moves(sub, source):
            return True
        if prim not in CHANGING_PRIMITIVES:
            return False
        for path, inner, aggs in sub.children:
            for f, p, s in aggs:
                if f.name == source:
                    return self.runs(inner, p, s)
        return False  # the feature of a parent that is itself limited in time

    def timed_rows(self, path: list[ForeignKey], keys: DataFrame | None = None) -> DataFrame:
        """Rows of the last child of ``path`` with ``__group`` and ``__vis``, the instant they come into sight.

        ``keys`` (__asked) limits them to the groups that anything is asked of.
        """
        def seen_at(table: str) -> Column:
            ts = self.ds.meta[table].time_column
            return instant(col(ts), self.clock) if ts else always(self.clock)

        first = path[0]
        cur = self.base(first.child).withColumns({"__group": col(first.fk), "__vis": seen_at(first.child)})
        cur = cur.filter("__group IS NOT NULL AND __vis IS NOT NULL")
        if keys is not None:
            cur = cur.join(keys, F.col("__group") == F.col("__asked"), "left_semi")
        for hop in path[1:]:
            up = cur.select("__group", F.col("__vis").alias("__up_vis"), col(hop.pk).alias("__up"))
            down = self.base(hop.child).withColumn("__own", seen_at(hop.child)).filter("__own IS NOT NULL")
            cur = up.join(down, F.col("__up") == col(hop.fk)).withColumn("__vis", F.greatest("__up_vis", "__own")).drop("__up", "__up_vis", "__own")
        return cur

    def change_times(self, sub: Visit, key: str, keys: DataFrame | None = None) -> DataFrame:
        """(__key, __at): distinct instants at which features of a row of the visit's table may change."""
        parts = []
        for path, inner, _ in sub.children:
            if path[0].pk != key or not branch_moves(self.ds, path, inner):
                continue
            rows = self.timed_rows(path, keys)
            parts.append(rows.select(F.col("__group").alias("__key"), F.col("__vis").alias("__at")))
            for own in {p[0].pk for p, i, _ in inner.children if branch_moves(self.ds, p, i)}:
                later = self.change_times(inner, own).withColumnRenamed("__key", "__own")
                parts.append(rows.join(later, col(own) == F.col("__own")).select(
                    F.col("__group").alias("__key"), F.greatest("__vis", "__at").alias("__at")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()

    def timed_aggregate(self, path, sub: Visit, aggs, probes: DataFrame, inclusive: bool) -> DataFrame:
        """Aggregates of a path as of each probe (__key, __at, ...); none of them pairs rows with probes."""
        flat = _Builder(self.ds, None, False, None, False)
        carried = [c for c in probes.columns if c not in ("__key", "__at")]
        still, moving = [], []
        for a in aggs:
            (moving if a[2] and self.source_moves(sub, a[2]) else still).append(a)
        sizes = {f.name: f.in_size for f in sub.features()}
        keys = probes.select(F.col("__key").alias("__asked")).distinct()
        rows = self.timed_rows(path, keys).withColumn("__m", F.lit(1))
        # the count of rows is what says that a group exists, so it is always there
        specs = [Spec(f"f:{f.name}", p, "__m" if p == "count" else f"f:{s}", sizes.get(s, 1)) for f, p, s in still]
        events = flat.expand(prune(sub, {s for _, _, s in still if s}), rows, ["__group", "__vis", "__m"])
        events = events.withColumnsRenamed({"__group": "__key", "__vis": "__at"}).withColumn("__first", F.lit(True))
        if len(path) > 1:  # a childless parent keeps its group
            firsts = self.timed_rows(path[:1], keys).select(F.col("__group").alias("__key"), F.col("__vis").alias("__at"), F.lit(True).alias("__first"))
            events = events.withColumn("__first", F.lit(False)).unionByName(firsts, allowMissingColumns=True)
        out = before(probes, materialize(events), specs, inclusive, "__first")
        by_pk: dict[str, list] = {}
        for f, p, s in moving:
            inner = next(c for c in sub.children if any(x[0].name == s for x in c[2]))
            by_pk.setdefault(inner[0][0].pk, []).append((f, p, s))
        for i, (pk, some) in enumerate(by_pk.items()):
            need = prune(sub, {s for _, _, s in some})
            # equal rows count together, so that a row is told from another by what it holds; these
            # tables are read by every inner aggregate and again by the checks for hot keys
            owners = materialize(rows.groupBy("__group", "__vis", col(pk).alias("__own")).agg(F.count("*").alias("__w")))
            at = materialize(self.change_times(need, pk, owners.select(F.col("__own").alias("__asked")).distinct()))
            known = at
            for inner_path, inner, inner_aggs in need.children:
                part = self.timed_aggregate(inner_path, inner, inner_aggs, at, True)
                known = known.join(part, ["__key", "__at"], "left")
            known = known.withColumnsRenamed({"__key": "__pk", "__at": "__tau"})
            steps = owners.join(known, F.col("__own") == F.col("__pk")).select(
                F.col("__group").alias("__key"), F.struct("__own", "__vis").alias("__row"), F.greatest("__vis", "__tau").alias("__from"),
                "__tau", "__w", *[col(f"f:{s}") for s in sorted({s for _, _, s in some})])
            part = during(probes.select("__key", "__at"), materialize(steps), [Spec(f"f:{f.name}", p, f"f:{s}") for f, p, s in some], inclusive)
            out = out.join(part, ["__key", "__at"], "left")
        return out.select("__key", "__at", *[col(c) for c in carried], *[col(f"f:{f.name}") for f, _, _ in aggs])

    def child_aggregate(self, path, sub: Visit, aggs, pairs: DataFrame | None) -> DataFrame:
        if pairs is None:
            return self.paired_aggregate(path, sub, aggs, None)
        if not branch_moves(self.ds, path, sub):
            # no cutoff limits these rows: one aggregate for all cutoffs of a key
            once = _Builder(self.ds, None, False, None, False).paired_aggregate(path, sub, aggs, None)
            return pairs.join(once, F.col("__key") == F.col("__gkey")).drop("__key").withColumnRenamed(_CUT, "__gcut")
        if self.few:
            return self.paired_aggregate(path, sub, aggs, pairs)
        many, small = hot_groups(pairs, ["__key"], MANY_CUTOFFS)
        few = self.with_few_cutoffs()
        if many is None:
            return few.paired_aggregate(path, sub, aggs, pairs)
        many = F.broadcast(many) if small else many
        ordinary = few.paired_aggregate(path, sub, aggs, pairs.join(many, F.col("__key") == F.col("__k0"), "left_anti"))
        crowded = self.crowded_aggregate(path, sub, aggs, pairs.join(many, F.col("__key") == F.col("__k0"), "left_semi"))
        return ordinary.unionByName(crowded)

    def with_few_cutoffs(self) -> _Builder:
        """The same plan for keys of at most ``MANY_CUTOFFS`` cutoffs: a row meets no more than those."""
        out = _Builder(self.ds, self.cut_value, self.has_cut, self.max_cut, self.inclusive, self.clock)
        out.few = True
        return out

    def crowded_aggregate(self, path, sub: Visit, aggs, pairs: DataFrame) -> DataFrame:
        """Aggregates for keys of many cutoffs, in time linear in rows and cutoffs where a form exists."""
        fast = [a for a in aggs if self.runs(sub, a[1], a[2])]
        slow = [a for a in aggs if a not in fast]
        out = None
        if fast:
            probes = materialize(pairs.select("__key", instant(F.col(_CUT), self.clock).alias("__at"), _CUT))
            out = self.timed_aggregate(path, prune(sub, {s for _, _, s in fast if s}), fast, probes, self.inclusive)
            out = out.drop("__at").withColumnsRenamed({"__key": "__gkey", _CUT: "__gcut"})
        if slow:
            # lists and user aggregates need the rows themselves at every cutoff
            rest = self.with_few_cutoffs().paired_aggregate(path, prune(sub, {s for _, _, s in slow if s}), slow, pairs)
            out = rest if out is None else out.join(rest, ["__gkey", "__gcut"], "full")
        return out.select("__gkey", "__gcut", *[col(f"f:{f.name}") for f, _, _ in aggs])

    def paired_aggregate(self, path, sub: Visit, aggs, pairs: DataFrame | None) -> DataFrame:
        rows = self.child_rows(path, pairs)
        meta = self.ds.meta[sub.table]
        marker = "__m" if len(path) > 1 else None
        ordered = any(p in ("join", "concat") for _, p, _ in aggs if isinstance(p, str))
        extra = []
        if ordered:  # time first, then every scalar column: lists get a total order
            order_cols = ([meta.time_column] if meta.time_column else []) + [
                c.name for c in meta.columns if not c.is_vector and c.dtype != TOKENS and c.name != meta.time_column
            ]
            extra = [col(c).alias(f"__o{i}") for i, c in enumerate(order_cols)]
            rows = rows.select("*", *extra)
        keep = ["__group"] + ([marker] if marker else []) + [f"__o{i}" for i in range(len(extra))]
        keep += [_CUT] if pairs is not None else []
        full = self.expand(sub, rows, keep)
        order = [f"__o{i}" for i in range(len(extra))]
        sizes = {f.name: f.in_size for f in sub.features()}
        keys = ["__group"] + ([_CUT] if pairs is not None else [])
        renamed = [F.col(k).alias({"__group": "__gkey", _CUT: "__gcut"}[k]) for k in keys]
        plain, lists, modes = [], [], []
        for f, p, source in aggs:
            if p in ("join", "concat"):
                lists.append((f, p, source))
            elif p == "mode":
                modes.append((f, source))
            else:
                c = (F.col(marker) if marker else F.lit(1)) if p == "count" else col(f"f:{source}")
                plain.append(aggregate_column(p, c, sizes.get(source, 1)).alias(f"f:{f.name}"))
        out = full.groupBy(*renamed).agg(*plain) if plain else full.select(*renamed).distinct()
        def attach(out: DataFrame, part: DataFrame, value: str, f: Feature) -> DataFrame:
            right = part.select(*[F.col(k).alias(f"__l{i}") for i, k in enumerate(keys)], F.col(value).alias(f"f:{f.name}"))
            cond = F.col("__gkey") == F.col("__l0")
            if pairs is not None:
                cond = cond & (F.col("__gcut") == F.col("__l1"))
            return out.join(right, cond, "left").drop("__l0", "__l1")

        for f, source in modes:
            # values are counted before they meet, so no group's values sit in one buffer
            out = attach(out, mode_by(full.select(*keys, col(f"f:{source}").alias("__x")), keys, "__x"), "value", f)
        for f, p, source in lists:
            # long lists are built in chunks of bounded length, never as one buffer of a group
            build = join_text if p == "join" else concat_tokens
            x = full.select(*keys, *order, col(f"f:{source}").alias("__x"))
            part = build(x, keys, "__x", order)
            out = attach(out, part, "__x", f)
        return out


def safe_name(feature: str) -> str:
    return re.sub(r"[^0-9A-Za-z]+", "_", feature).strip("_")


def split_selfloops(ds: RelationalDataset) -> RelationalDataset:
    """Move self-referencing foreign keys into ``<table>_selfloop`` edge tables."""
    from relweave.operators.joins import selfloop_tables

    for name in list(ds.meta):
        if any(r.parent == name for r in ds.forward(name)):
            ds = selfloop_tables(ds, name)
    return ds


def synthesize(
    ds: RelationalDataset,
    task: DataFrame,
    target_table: str,
    keys: Sequence[str],
    depth: int = 2,
    primitives: Sequence = DEFAULT_PRIMITIVES,
    cutoff: str | None = None,
    target_column: str | None = None,
    features: Iterable[str] | None = None,
    inclusive: bool = False,
    name: Callable[[str], str] = safe_name,
    key_is_unique: bool | None = None,
) -> DataFrame:
    """Task rows plus every direct and aggregate feature up to ``depth``.

    ``keys`` are task columns named like key columns of ``target_table``.  A primary key that
    repeats in the task is treated as a foreign key to the target table.  With ``cutoff``,
    only rows strictly before each task row's cutoff are seen, at every hop.
    """
    ds = split_selfloops(ds)
    meta = ds.meta[target_table]
    pk = meta.primary_key
    skip = frozenset() if cutoff else frozenset({(target_table, target_column)} if target_column else set())
    if pk in keys and key_is_unique is None:
        n, d = task.agg(F.count(col(pk)), F.count_distinct(col(pk))).first()
        key_is_unique = n == d

    root = Visit("__task__")
    if pk in keys and key_is_unique:
        whole = plan_visit(ds, target_table, depth, primitives, frozenset(), skip)
        root.children = whole.children
    if pk in keys and not key_is_unique:
        r = ForeignKey("__task__", pk, target_table, pk)
        sub = plan_visit(ds, target_table, depth - 1, primitives, frozenset(), skip)
        root.parents.append((r, sub, {f.name: Feature(f"{target_table}.{f.name}", f.dtype, f.in_size, f.origin,
                                                      f.arrays, f.open_count) for f in sub.features()}))
    for r in ds.forward(target_table):
        if r.fk in keys:
            sub = plan_visit(ds, r.parent, depth - 1, primitives, frozenset({target_table}), skip)
            root.parents.append((r, sub, {f.name: Feature(f"{r.parent}.{f.name}", f.dtype, f.in_size, f.origin,
                                                          f.arrays, f.open_count) for f in sub.features()}))
    names = [f.name for f in root.features()]
    wanted = set(names if features is None else features)
    missing = wanted - set(names)
    if missing:
        raise ValueError(f"no such features at this depth: {sorted(missing)}")
    root = prune(root, wanted)
    if not root.features():
        raise RuntimeError("the target table has no features within this depth")

    uniform = latest = None
    if cutoff:
        low, high, n_cut, n_all = task.agg(
            F.min(col(cutoff)), F.max(col(cutoff)), F.count(col(cutoff)), F.count(F.lit(1))
        ).first()
        latest = F.lit(high).cast(task.schema[cutoff].dataType)
        if low == high and n_cut == n_all:
            uniform = latest
    timed = [(t, m.time_column) for t, m in ds.meta.items() if m.time_column]
    kinds = [task.schema[cutoff].dataType, *[ds.tables[t].schema[c].dataType for t, c in timed]] if cutoff else []
    builder = _Builder(ds, uniform, cutoff is not None, latest, inclusive, clock(kinds) if cutoff else "time")
    rows = task
    if builder.per_row:
        widen(task.sparkSession, [task, *[ds.tables[t] for t in sorted(visited(root)) if t in ds.tables]])
        # no row is before the first instant, so it stands for a missing cutoff
        never = F.lit(_NEVER).cast(task.schema[cutoff].dataType)
        rows = task.withColumn(_CUT, F.coalesce(col(cutoff), never))
    wide = builder.expand(root, rows, task.columns, unique=bool(key_is_unique))
    final = []
    for f in root.features():
        c = col(f"f:{f.name}")
        final.append((F.coalesce(c, F.lit(0)) if f.open_count else c).alias(name(f.name)))
    return wide.select(*[col(c) for c in task.columns], *final)


def feature_names(ds: RelationalDataset, target_table: str, keys: Sequence[str], depth: int,
                  primitives: Sequence = DEFAULT_PRIMITIVES, key_is_unique: bool = True) -> list[str]:
    """Names of all features without running anything."""
    ds = split_selfloops(ds)
    pk = ds.meta[target_table].primary_key
    out: list[str] = []
    if pk in keys and key_is_unique:
        v = plan_visit(ds, target_table, depth, primitives)
        out += [f.name for _, _, aggs in v.children for f, _, _ in aggs]
    elif pk in keys:
        out += [f"{target_table}.{f.name}" for f in plan_visit(ds, target_table, depth - 1, primitives).features()]
    for r in ds.forward(target_table):
        if r.fk in keys:
            sub = plan_visit(ds, r.parent, depth - 1, primitives, frozenset({target_table}))
            out += [f"{r.parent}.{f.name}" for f in sub.features()]
    return out
