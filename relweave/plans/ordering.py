"""Global order without a single partition.

A window with no partition key, or with one hot key, runs in one task.  Here such rows are
first cut into ordered buckets (by sampled bounds or by the high bits of a hash), counted per
bucket, and numbered inside their bucket; the bucket offsets are a table of at most
``buckets`` rows per group.  Groups of ordinary size keep one bucket and cost one window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from relweave.functions.scalar import HASH_BITS, col
from relweave.session import materialize

MIN_BUCKETS, MAX_BUCKETS = 32, 4096
SAMPLES_PER_BUCKET = 16
FAN = 64
# a group above this many rows is cut into buckets; below it one task sorts the group
HOT_GROUP_ROWS = 1_000_000
# hot groups are looked up by broadcast up to this many, by a plain join beyond
MAX_BROADCAST_GROUPS = 10_000


def bucket_count(df: DataFrame) -> int:
    """Power of two, about twice the shuffle width of the session."""
    width = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = MIN_BUCKETS
    while n < min(width, MAX_BUCKETS):
        n *= 2
    return n


def shuffle_width(df: DataFrame) -> int:
    """Partitions of a shuffle; given as a number it is not merged down, which Python stages of few bytes need."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# rows of the tables read for which a shuffle starts with a partition of its own
SHUFFLE_ROWS = 200_000


def widen(spark: SparkSession, tables: Sequence[DataFrame]) -> int:
    """Shuffles from here on start with a partition for every ``SHUFFLE_ROWS`` rows of the tables.

    With a fixed number of partitions a task's sorts and hash tables grow with the input. Adaptive
    execution merges small partitions up to its advisory size, so a task reads that much whatever
    the input. The number is only ever raised above the session's own; a caller that sets a
    shuffle's partitions itself takes the one returned.
    """
    rows = reduce(DataFrame.unionAll, [t.select(F.lit(1)) for t in tables]).count()
    own = spark.conf.get("spark.sql.shuffle.partitions")
    wanted = max(int(own), rows // SHUFFLE_ROWS)
    if wanted > int(spark.conf.get(_INITIAL, None) or own):
        spark.conf.set(_INITIAL, str(wanted))
    return wanted


def bisect(x: Column, bounds: Sequence[Column]) -> Column:
    """Number of bounds <= x.

    Up to 64 bounds are a balanced CASE tree (six comparisons, code generated); more are
    reached through a tree over every 64th bound and a constant array of the rest.
    """
    def tree(parts: Sequence[Column]) -> Column:
        def node(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(x < parts[mid], node(lo, mid)).otherwise(node(mid + 1, hi))

        return node(0, len(parts))

    if len(bounds) <= FAN:
        return tree(bounds)
    chunks = [list(bounds[i:i + FAN]) for i in range(0, len(bounds), FAN)]
    top = tree([c[0] for c in chunks[1:]])
    rows = F.array(*[F.array(*c) for c in chunks])
    return top * FAN + F.size(F.filter(F.get(rows, top), lambda b: b <= x))


def hash_bucket(h: str | Column, buckets: int) -> Column:
    """Ordered, evenly filled buckets of a 60-bit hash."""
    return F.shiftright(col(h), HASH_BITS - (buckets.bit_length() - 1)).cast("int")


def row_bounds(df: DataFrame, order: Sequence[str], buckets: int, by: Sequence[str] = ()) -> list:
    """At most ``buckets - 1`` cut points of the whole order key (a bounded driver list).

    The cuts come from the rows with a key hash below the share of rows wanted, so larger groups
    get more of them and only about the wanted number of rows leaves its task.
    Ties on the first column are cut further by the next ones, and the cuts only balance the
    buckets: positions stay exact whatever they are.
    """
    names = [f"k{i}" for i in range(len(order))]
    keys = [col(c).alias(n) for c, n in zip(order, names)]
    h = F.pmod(F.xxhash64(*[col(c) for c in (*by, *order)]), F.lit(1 << 40))
    share = min(1.0, SAMPLES_PER_BUCKET * buckets / max(1, df.count()))
    rows = df.filter(h < F.lit(int(share * (1 << 40)))).select(*keys).distinct()
    found = [tuple(r) for r in rows.orderBy(*names).collect()]
    step = max(1, len(found) // buckets)
    cuts = list(dict.fromkeys(found[step::step]))
    return [c for c in cuts if all(v is not None for v in c)]


def order_bucket(df: DataFrame, order: Sequence[str], buckets: int, by: Sequence[str] = ()) -> Column:
    """Ordered bucket of the order key, as an expression over ``df``."""
    types_ = [df.schema[c].dataType for c in order]

    def key(parts: list[Column]) -> Column:
        return parts[0] if len(parts) == 1 else F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])

    cuts = [key([F.lit(v).cast(t) for v, t in zip(c, types_)]) for c in row_bounds(df, order, buckets, by)]
    found = bisect(key([col(c) for c in order]), cuts)
    # a null compares with nothing, but sorts first; inside a struct it already does
    return F.when(col(order[0]).isNull(), 0).otherwise(found) if len(order) == 1 else found


# own names for joined keys, which no column of a caller has
_KEY = "__ordering_key"


def _match(by: Sequence[str], prefix: str = _KEY) -> list[Column]:
    return [col(c).eqNullSafe(F.col(f"{prefix}{i}")) for i, c in enumerate(by)]


def _keys(by: Sequence[str], prefix: str = _KEY) -> list[Column]:
    return [col(c).alias(f"{prefix}{i}") for i, c in enumerate(by)]


def hot_groups(df: DataFrame, by: Sequence[str], size: int | None = None) -> tuple[DataFrame | None, bool]:
    """(keys ``__k0``... of groups above the hot size, whether their number allows a broadcast)."""
    size = HOT_GROUP_ROWS if size is None else size
    counts = df.groupBy(*_keys(by, "__k")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > size).drop("__n")
    found = counts.limit(MAX_BROADCAST_GROUPS + 1).collect()
    if not found:
        return None, True
    if len(found) <= MAX_BROADCAST_GROUPS:
        return df.sparkSession.createDataFrame(found, counts.schema), True
    return counts, False


def small_side(df: DataFrame) -> DataFrame:
    """A table of a row per group, written once; broadcast if its groups allow it.

    A join on a few group keys would move all rows of the other side to as few tasks.
    """
    df = materialize(df)
    return F.broadcast(df) if df.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS else df


def _cut(
    df: DataFrame, order: Sequence[str], by: Sequence[str], bucket: Column | None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows with ``__b``, rows that need offsets); ordinary groups have the one bucket 0."""
    n = bucket_count(df)
    if not by:
        cut = df.withColumn("__b", order_bucket(df, order, n) if bucket is None else bucket)
        return cut, cut
    hot, small = hot_groups(df, by)
    if hot is None:
        return df.withColumn("__b", F.lit(0)), None
    # bounds, offsets and positions read the same rows: sums made again in another order may differ
    df = materialize(df)
    hot = hot.withColumnsRenamed({f"__k{i}": f"{_KEY}{i}" for i in range(len(by))})
    hot = F.broadcast(hot) if small else hot
    marked = df.join(hot.withColumn("__hot", F.lit(True)), _match(by), "left").drop(*[f"{_KEY}{i}" for i in range(len(by))])
    if bucket is None:
        bucket = order_bucket(df.join(hot, _match(by), "left_semi"), order, n, by)
    cut = marked.withColumn("__b", F.when(F.col("__hot"), bucket).otherwise(0))
    return cut.drop("__hot"), cut.filter("__hot").drop("__hot")


def _with_offsets(cut: DataFrame, need: DataFrame | None, by: Sequence[str], aggs: dict[str, Column],
                  windows: dict[str, tuple]) -> DataFrame:
    """Attach per-bucket offsets; ``windows`` maps output to (column, how, type)."""
    if need is None:
        return cut.withColumns({n: F.lit(None).cast(t) for n, (_, _, t) in windows.items()})
    per = need.groupBy(*[col(c) for c in by], "__b").agg(*[a.alias(n) for n, a in aggs.items()])
    whole = Window.partitionBy(*[col(c) for c in by])
    before = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    how = {"before": lambda c: F.sum(c).over(before), "total": lambda c: F.sum(c).over(whole),
           "last": lambda c: F.max(c).over(before), "least": lambda c: F.min(c).over(before)}
    offsets = per.select(*_keys(by), F.col("__b").alias("__ob"), *[how[h](c).alias(n) for n, (c, h, _) in windows.items()])
    if not by:
        offsets = F.broadcast(offsets)  # at most `buckets` rows
    cond = [*_match(by), F.col("__b").eqNullSafe(F.col("__ob"))]
    return cut.join(offsets, cond, "left").drop("__ob", *[f"{_KEY}{i}" for i in range(len(by))])


def prefix_sums(
    df: DataFrame,
    order: str,
    sums: dict[str, str],
    by: Sequence[str] = (),
    totals: dict[str, str] | None = None,
    previous: str | None = None,
) -> DataFrame:
    """Exclusive running sums in ``order`` (unique per group) plus optional group totals.

    ``sums`` maps output name to summed column; ``totals`` maps output name to column;
    ``previous`` names a column for the preceding order value.  Input is expected
    pre-aggregated to one row per (group, order value).
    """
    totals = totals or {}
    types_ = dict(df.dtypes)
    cut, need = _cut(df, [order], by, None)
    used = sorted(set(sums.values()) | set(totals.values()))
    aggs = {f"__s_{c}": F.sum(col(c)) for c in used} | {"__end": F.max(col(order))}
    windows = {f"__o_{c}": (f"__s_{c}", "before", types_[c]) for c in sorted(set(sums.values()))}
    windows |= {f"__t_{c}": (f"__s_{c}", "total", types_[c]) for c in sorted(set(totals.values()))}
    if previous:
        windows["__prev"] = ("__end", "last", types_[order])
    joined = _with_offsets(cut, need, by, aggs, windows)
    cell = Window.partitionBy(*[col(c) for c in by], F.col("__b"))
    inside = cell.orderBy(col(order))
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    return joined.select(
        *[col(c) for c in df.columns],
        *[(F.coalesce(f"__o_{c}", zero) + F.coalesce(F.sum(col(c)).over(running), zero)).alias(out) for out, c in sums.items()],
        *[F.coalesce(f"__t_{c}", F.sum(col(c)).over(cell)).alias(out) for out, c in totals.items()],
        *([F.coalesce(F.lag(col(order)).over(inside), F.col("__prev")).alias(previous)] if previous else []),
    )


def running_max(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Inclusive running maximum of ``value`` over a total order."""
    cut, need = _cut(df, order, (), None)
    kind = dict(df.dtypes)[value]
    joined = _with_offsets(cut, need, (), {"__m": F.max(col(value))}, {"__prev": ("__m", "last", kind)})
    inside = Window.partitionBy("__b").orderBy(*[col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*[col(c) for c in df.columns], F.greatest(F.max(col(value)).over(inside), F.col("__prev")).alias(out))


FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}
_BEFORE = {"sum": "before", "max": "last", "min": "least"}
_MERGE = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}


def running(
    df: DataFrame, order: Sequence[str], by: Sequence[str], states: dict[str, str], exclusive: bool = False
) -> DataFrame:
    """Each column of ``states`` replaced by its running ``sum``, ``max`` or ``min`` in ``order`` within ``by``.

    Nulls are skipped.  Rows of equal order may see each other or not.  ``exclusive`` leaves
    the row itself out.
    """
    types_ = dict(df.dtypes)
    cut, need = _cut(df, order, by, None)
    aggs = {f"__s_{c}": FOLDS[how](col(c)) for c, how in states.items()}
    windows = {f"__o_{c}": (f"__s_{c}", _BEFORE[how], types_[c]) for c, how in states.items()}
    joined = _with_offsets(cut, need, by, aggs, windows)
    inside = Window.partitionBy(*[col(c) for c in by], F.col("__b")).orderBy(*[col(c) for c in order]).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0)

    def state(c: str, how: str) -> Column:
        here = FOLDS[how](col(c)).over(inside)
        return here if need is None else _MERGE[how](here, F.col(f"__o_{c}"))

    return joined.select(*[state(c, states[c]).alias(c) if c in states else col(c) for c in df.columns])


def numbered(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    out: str = "rn",
    bucket: Column | None = None,
    total: str | None = None,
) -> DataFrame:
    """1-based position of each row in ``order`` (within ``by``), without a one-task window.

    ``order`` must be total.  ``bucket`` must be monotone in the order; by default it comes
    from cut points of the order key.
    """
    cut, need = _cut(df, order, by, bucket)
    windows = {"__off": ("__n", "before", "bigint")} | ({"__tot": ("__n", "total", "bigint")} if total else {})
    joined = _with_offsets(cut, need, by, {"__n": F.count(F.lit(1))}, windows)
    cell = Window.partitionBy(*[col(c) for c in by], F.col("__b"))
    rank = F.row_number().over(cell.orderBy(*[col(c) for c in order]))
    cols = [*[col(c) for c in df.columns], (rank + F.coalesce("__off", F.lit(0).cast("long"))).alias(out)]
    if total:
        cols.append(F.coalesce("__tot", F.count(F.lit(1)).over(cell)).alias(total))
    return joined.select(*cols)


# bits of a hash that one counting pass looks at, and rows that one task may sort in the end
PREFIX_BITS = 12
LAST_CELL_ROWS = 20_000


def lowest_hashes(df: DataFrame, h: str, ties: Sequence[str], cap: int) -> DataFrame:
    """The ``cap`` rows lowest in (hash, ties), found by counting hash prefixes.

    A pass counts the cells of a prefix (at most 4096 numbers for the driver) and the next one
    looks into the cell that holds the cap-th hash, so two or three narrow passes leave a
    threshold and a cell of few rows to order; nothing of the size of ``cap`` is merged.
    """
    if cap <= 0:
        return df.filter("false")
    need, shift, prefix, rows = cap, HASH_BITS, 0, None
    inside = df
    while shift > 0 and (rows is None or rows > LAST_CELL_ROWS):
        shift -= PREFIX_BITS
        cells = inside.groupBy(F.shiftright(col(h), shift).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
        if sum(c["n"] for c in cells) <= need:
            return df if rows is None else df.filter(col(h) < F.lit((prefix + 1) << (shift + PREFIX_BITS)))
        for c in sorted(cells, key=lambda c: c["cell"]):
            if c["n"] >= need:
                prefix, rows = c["cell"], c["n"]
                break
            need -= c["n"]
        inside = df.filter(F.shiftright(col(h), shift) == F.lit(prefix))
    sure = df.filter(col(h) < F.lit(prefix << shift))
    if rows > LAST_CELL_ROWS:  # so many rows of one hash: repeated keys
        edge = numbered(inside, [h, *ties], out="__rn").filter(F.col("__rn") <= need).drop("__rn")
    else:
        edge = inside.orderBy(col(h), *[col(c) for c in ties]).limit(need)
    return sure.unionByName(edge)


def numbered_by_hash(
    df: DataFrame, h: str, ties: Sequence[str], by: Sequence[str] = (), out: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """Positions in hash order: buckets are hash ranges, so no bounds pass is needed."""
    return numbered(df, [h, *ties], by, out, hash_bucket(h, bucket_count(df)), total)


def top_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rn", salts: int | None = None
) -> DataFrame:
    """First ``k`` rows per group in two steps, so a hot group is cut in parallel first.

    A group is dealt over ``salts`` parts, by default as many as a shuffle has partitions; the
    second step meets at most ``k`` rows of each part.
    """
    salts = salts or max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plain = [c for c, t in df.dtypes if not c.startswith("__") and not t.startswith("map")]
    salt = F.pmod(F.xxhash64(*[col(c) for c in plain]), F.lit(salts))
    local = Window.partitionBy(*[col(c) for c in by], F.col("__salt")).orderBy(*order)
    final = Window.partitionBy(*[col(c) for c in by]).orderBy(*order)
    return (
        df.withColumn("__salt", salt)
        .withColumn("__lr", F.row_number().over(local))
        .filter(F.col("__lr") <= k)
        .drop("__salt", "__lr")
        .withColumn(out, F.row_number().over(final))
        .filter(col(out) <= k)
    )
