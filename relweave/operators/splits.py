"""Row order, splits, sampling and negatives.

Every random choice is a hash of the row key and a seed: it does not depend on partitioning
and survives retried tasks.  Exact counts come from bucketed positions, never from a
single-task window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Window, Column, DataFrame, functions as F

from relweave.functions import scalar as S
from relweave.functions.scalar import col
from relweave.plans.ordering import bucket_count, lowest_hashes, numbered, numbered_by_hash, top_per_group
from relweave.plans.quantiles import exact_quantile_values

TRAIN, VALIDATION, TEST = "train", "validation", "test"

# ---------------------------------------------------------------- order and numbering


def query_index(
    df: DataFrame, id_columns: Sequence[str], out: str = "query_idx", domain: DataFrame | None = None
) -> DataFrame:
    """Dense number, from 0, of the group of all non-id columns in sorted key order.

    ``domain`` may name smaller rows that already hold every group.
    """
    keys = [c for c in df.columns if c not in id_columns]
    groups = numbered((df if domain is None else domain).select(*[col(k) for k in keys]).distinct(), keys, out="__q")
    right = groups.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], (F.col("__q") - 1).alias(out))
    cond = [col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return df.join(right, cond, "inner").drop(*[f"__k{i}" for i in range(len(keys))])


def rank_codes(df: DataFrame, column: str, out: str, max_values: int) -> DataFrame:
    """Codes by frequency (ties by value), null kept; raises above ``max_values`` values."""
    from relweave.operators.transforms import apply_codes, frequency_codes

    codes = frequency_codes(df, column)
    if codes.count() > max_values:
        raise ValueError(f"{column} has more than {max_values} values")
    return apply_codes(df, column, codes, out, None)


def stable_order(df: DataFrame, row_id: str) -> DataFrame:
    """Total order on output only."""
    return df.orderBy(col(row_id))


# ---------------------------------------------------------------- splits


def split_of(rn: Column, n: Column, train: float, val: float) -> Column:
    """Split by 1-based position with truncated sizes."""
    a = F.floor(n * F.lit(train))
    b = a + F.floor(n * F.lit(val))
    return F.when(rn <= a, TRAIN).when(rn <= b, VALIDATION).otherwise(TEST)


def ratio_split(df: DataFrame, order: Sequence[str], train: float = 0.8, val: float = 0.1, out: str = "split") -> DataFrame:
    """Exact unshuffled split by row position in a total order."""
    ranked = numbered(df, order, out="__rn", total="__n")
    return ranked.withColumn(out, split_of(F.col("__rn"), F.col("__n"), train, val)).drop("__rn", "__n")


def shuffled_split(
    df: DataFrame, key: Sequence[str], train: float = 0.8, val: float = 0.1, seed: int | str = 0, out: str = "split"
) -> DataFrame:
    """Exact split in hash order of the key."""
    hashed = df.withColumn("__h", S.stable_hash(seed, *key))
    ranked = numbered_by_hash(hashed, "__h", key, out="__rn", total="__n")
    return ranked.withColumn(out, split_of(F.col("__rn"), F.col("__n"), train, val)).drop("__rn", "__n", "__h")


def temporal_split(df: DataFrame, ts: str, train: float = 0.8, val: float = 0.1, out: str = "split") -> DataFrame:
    """Split at quantiles of the distinct times; every split must have rows."""
    micros = df.select(S.epoch_micros(ts).alias("t")).filter("t is not null").distinct()
    c1, c2 = exact_quantile_values(micros, "t", [train, train + val])
    t = S.epoch_micros(ts)
    cut = df.withColumn(out, F.when(t <= c1, TRAIN).when(t <= c2, VALIDATION).otherwise(TEST))
    found = {r[out] for r in cut.select(out).distinct().collect()}
    if len(found) < 3:
        raise ValueError(f"temporal split leaves a split empty: {sorted(found)}")
    return cut


def column_split(df: DataFrame, column: str, out: str = "split") -> DataFrame:
    """Rows marked train, valid or test; other rows belong to no split."""
    names = F.when(col(column) == "train", TRAIN).when(col(column) == "valid", VALIDATION).when(col(column) == "test", TEST)
    return df.withColumn(out, names).filter(col(out).isNotNull())


def global_cutoff(df: DataFrame, ts: str, out: str) -> DataFrame:
    """The latest time of all rows as every row's prediction time."""
    (latest,) = df.agg(F.max(col(ts))).first()
    return df.withColumn(out, F.lit(latest).cast(df.schema[ts].dataType))


def split_cutoff(df: DataFrame, ts: str, out: str, split: str = "split") -> DataFrame:
    """Train and validation rows may see up to the last train time, test rows up to the last validation time."""
    tr, va = df.agg(F.max(F.when(col(split) == TRAIN, col(ts))), F.max(F.when(col(split) == VALIDATION, col(ts)))).first()
    if tr is None or va is None or va < tr:
        raise ValueError("validation must end at or after training")
    kind = df.schema[ts].dataType
    return df.withColumn(out, F.when(col(split) == TEST, F.lit(va).cast(kind)).otherwise(F.lit(tr).cast(kind)))


def tail_temporal(df: DataFrame, ts: str, n: int) -> DataFrame:
    """Rows strictly later than the (1 - n/N) quantile of time; every row when there are at most ``n``."""
    total = df.count()
    if n >= total:
        return df
    (cut,) = exact_quantile_values(df.select(S.epoch_micros(ts).alias("t")), "t", [1 - n / total])
    return df.filter(S.epoch_micros(ts) > cut)


def stratified_split(
    df: DataFrame, label: str, key: Sequence[str], test: float = 0.3, seed: int | str = 0, cap: int | None = None,
    out: str = "split",
) -> DataFrame:
    """Per label: round(test * n) test rows in hash order; with a ``cap`` each side keeps so many by hash.
    """
    hashed = df.withColumn("__h", S.stable_hash(seed, *key))
    ranked = numbered_by_hash(hashed, "__h", key, [label], "__rn", "__n")
    cut = ranked.withColumn(out, F.when(F.col("__rn") <= F.round(F.col("__n") * F.lit(test)), TEST).otherwise(TRAIN))
    if cap is not None:
        cut = top_per_group(cut, [out], [F.col("__h"), *[col(k) for k in key]], cap, "__top").drop("__top")
    return cut.drop("__h", "__rn", "__n")


def class_quotas(classes: DataFrame, size: int) -> DataFrame:
    """``(__label, __quota)`` for ``classes (__label, n)``: ``size`` rows in class proportion.

    Every class gets the whole part of its share, and at least one row. Rows still missing go
    to the largest remainders; rows too many (from small classes) are taken from the others in
    proportion to what they have above one, again by largest remainder. Ties go to the lower
    label. With more classes than ``size`` every class gets one.
    """
    every = Window.partitionBy(F.lit(1))  # one row per class
    share = F.col("n") * F.lit(float(size)) / F.sum("n").over(every)
    base = classes.select("*", share.alias("share")).withColumn("base", F.greatest(F.lit(1), F.floor("share")).cast("long"))
    base = base.select("*", (F.lit(size) - F.sum("base").over(every)).alias("diff"), F.sum(F.col("base") - 1).over(every).alias("spare"))
    more = F.row_number().over(Window.orderBy(F.desc(F.col("share") - F.col("base")), "__label")) <= F.col("diff")
    less = F.least(-F.col("diff"), F.col("spare")) * F.try_divide(F.col("base") - 1, F.col("spare"))
    base = base.select("*", more.cast("long").alias("more"), F.coalesce(less, F.lit(0.0)).alias("less"))
    left = F.least(-F.col("diff"), F.col("spare")) - F.sum(F.floor("less")).over(every)
    cut = F.row_number().over(Window.orderBy(F.desc(F.col("less") - F.floor("less")), "__label")) <= left
    quota = F.when(F.col("diff") >= 0, F.col("base") + F.col("more")).otherwise(F.col("base") - F.floor("less") - cut.cast("long"))
    return base.select("__label", quota.cast("long").alias("__quota"))


def stratified_exact(
    df: DataFrame, label: str, key: Sequence[str], size: int = 1024, sets: int = 1, seed: int = 0
) -> DataFrame:
    """``sets`` samples of exactly ``size`` rows in class proportion, with a ``set_id``.

    A table of at most ``size`` rows is its only sample.
    """
    classes = df.groupBy(col(label).alias("__label")).agg(F.count(F.lit(1)).alias("n"))
    if (classes.agg(F.sum("n")).first()[0] or 0) <= size:
        return df.withColumn("set_id", F.lit(0))
    quota = class_quotas(classes, size).withColumn("set_id", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    # each row meets its class quota once per set, then competes by hash inside the class
    rows = df.join(quota, col(label).eqNullSafe(F.col("__label")))
    hashed = rows.withColumn("__h", S.stable_hash(seed, "set_id", *key))
    ranked = numbered_by_hash(hashed, "__h", key, ["set_id", label], "__rn")
    return ranked.filter("__rn <= __quota").drop("__h", "__rn", "__quota", "__label")


def ovr_labels(df: DataFrame, label: str, classes: Sequence | None = None) -> DataFrame:
    """One row per (row, class) with a 0/1 label, over the given classes or all in the table.

    The result holds every class for every row; the class table is one row, whatever it lists.
    """
    kind = df.schema[label].dataType
    if classes is None:
        known = df.select(col(label).alias("__c")).filter("__c is not null").distinct().agg(F.sort_array(F.collect_list("__c")).alias("__classes"))
    else:
        known = df.sparkSession.range(1).select(F.array(*[F.lit(c).cast(kind) for c in classes]).alias("__classes"))
    each = df.crossJoin(known).select(*[col(c) for c in df.columns], F.explode("__classes").alias("class"))
    return each.withColumn("ovr_label", (col(label) == F.col("class")).cast("int"))


# ---------------------------------------------------------------- samples


def capped_rows(df: DataFrame, cap: int, key: Sequence[str], seed: int | str) -> DataFrame:
    """At most ``cap`` rows in hash order of (seed, key), by a threshold on the hash."""
    return lowest_hashes(df.withColumn("__h", S.stable_hash(seed, *key)), "__h", key, cap).drop("__h")


def capped_per_group(df: DataFrame, by: Sequence[str], cap: int, key: Sequence[str], seed: int | str) -> DataFrame:
    """At most ``cap`` rows per group; a hot group is cut in parts first, as many as a shuffle has."""
    h = df.withColumn("__h", S.stable_hash(seed, *by, *key))
    return top_per_group(h, by, [F.col("__h"), *[col(k) for k in key]], cap, "__rn").drop("__h", "__rn")


def focal_sample(df: DataFrame, key: str, n: int, seed: int | str = 0) -> DataFrame:
    """``n`` rows with replacement: draw i takes the row at a hashed index of the key order."""
    rows = numbered(df, [key], out="__ri", total="__rows")
    (total,) = df.agg(F.count(F.lit(1))).first()
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw"), (F.pmod(S.stable_hash(seed, "id"), F.lit(total)) + 1).alias("__want"))
    return draws.join(rows, F.col("__want") == F.col("__ri")).drop("__want", "__ri", "__rows")


def seeded_eval_sample(
    rows: DataFrame, dataset: str, task: str, key: Sequence[str], features: Sequence[str], train_cap: int, test_cap: int,
    seed: int = 0, split: str = "split",
) -> DataFrame:
    """Per (dataset, task): capped train rows keyed by ``dataset:task:seed`` and capped test rows
    keyed by ``dataset:task:test``; features are then filled by the train median (0 if none)."""
    name = F.concat_ws(":", col(dataset), col(task), F.when(col(split) == TRAIN, F.lit(str(seed))).otherwise(F.lit("test")))
    hashed = rows.filter(col(split).isin(TRAIN, TEST)).withColumn("__name", name).withColumn("__h", S.stable_hash("", "__name", *key))
    by = [dataset, task, split]
    order = [F.col("__h"), *[col(k) for k in key]]
    top = top_per_group(hashed, by, order, max(train_cap, test_cap), "__rn")
    kept = top.filter(F.col("__rn") <= F.when(col(split) == TRAIN, train_cap).otherwise(test_cap)).drop("__h", "__rn", "__name")
    # at most train_cap rows per task feed each median, so the built-in exact median is bounded
    med = kept.filter(col(split) == TRAIN).groupBy(col(dataset).alias("__d"), col(task).alias("__t")).agg(
        *[F.median(S.finite(col(f))).alias(f"__m{i}") for i, f in enumerate(features)])
    out = kept.join(med, (col(dataset) == F.col("__d")) & (col(task) == F.col("__t")), "left")
    return out.withColumns({
        f: F.coalesce(S.finite(col(f)), F.col(f"__m{i}"), F.lit(0.0)) for i, f in enumerate(features)
    }).drop("__d", "__t", *[f"__m{i}" for i in range(len(features))])


def entity_cluster_sample(
    df: DataFrame, entity: str, key: Sequence[str], total: int, seed: int = 0
) -> DataFrame:
    """``total`` rows made of whole entities that have at least two rows.

    K = total // median rows per such entity entities are taken in hash order with all their
    rows; the result is trimmed, padded from other rows, then filled with repeats (``copy`` > 0).
    """
    counts = df.groupBy(col(entity)).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= 2)
    (median,) = exact_quantile_values(counts, "__n", [0.5])
    hashed = df.withColumn("__h", S.stable_hash(seed, *key))
    if median is None:
        hashed = hashed.withColumn("__tier", F.lit(1))
    else:
        k = max(1, total // max(2, int(median)))
        chosen = lowest_hashes(counts.withColumn("__eh", S.stable_hash(seed, entity)), "__eh", [entity], k)
        mark = chosen.select(col(entity).alias("__e"), F.lit(0).alias("__in"))
        hashed = hashed.join(mark, col(entity) == F.col("__e"), "left").withColumn(
            "__tier", F.coalesce("__in", F.lit(1))).drop("__e", "__in")
    first, rest = hashed.filter("__tier = 0"), hashed.filter("__tier = 1")
    whole = first.count()
    if whole >= total:
        picked = lowest_hashes(first, "__h", key, total)
    else:
        picked = first.unionByName(lowest_hashes(rest, "__h", key, total - whole))
    have = min(total, df.count())
    once = picked.withColumn("copy", F.lit(0))
    if have == total:
        return once.drop("__tier", "__h")
    ranked = numbered(once, ["__tier", "__h", *key], out="__rn")
    extra = df.sparkSession.range(total - have).select(
        (F.pmod(S.stable_hash(f"{seed}x", "id"), F.lit(have)) + 1).alias("__want"), (F.col("id") + 1).cast("int").alias("__c"))
    more = extra.join(ranked, F.col("__want") == F.col("__rn")).withColumn("copy", F.col("__c")).drop("__want", "__c")
    return ranked.unionByName(more).drop("__tier", "__h", "__rn")


def mixture_sample(
    sources: dict[str, tuple[DataFrame, str, float]], steps: int, seed: int = 0, shard: int = 0, shards: int = 1
) -> DataFrame:
    """Weighted choice of a source per step, rows sequential within a source, sharded by position.

    ``sources`` maps a name to (rows, key, weight).  Step s takes the k-th row of its source
    where k counts the earlier steps of that source, modulo its size.
    """
    spark = next(iter(sources.values()))[0].sparkSession
    total = sum(w for _, _, w in sources.values())
    u = S.stable_uniform(seed, "id")
    edges, low = [], 0.0
    for name, (_, _, w) in sources.items():
        low += w / total
        edges.append((name, low))
    pick = reduce(lambda rest, e: F.when(u < e[1], e[0]).otherwise(rest), reversed(edges[:-1]), F.lit(edges[-1][0]))
    chosen = spark.range(steps).select(F.col("id").alias("step"), pick.alias("source"))
    # running number per source, bucketed by step so no source is one task
    width = max(1, math.ceil(steps / bucket_count(chosen)))
    nth = numbered(chosen, ["step"], ["source"], "__k", bucket=F.floor(F.col("step") / width).cast("int"))
    parts = []
    for name, (rows, key, _) in sources.items():
        ranked = numbered(rows.select(col(key).alias("row_key")), ["row_key"], out="__rn", total="__size")
        parts.append(ranked.withColumn("__src", F.lit(name)))
    pool = reduce(DataFrame.unionByName, parts)
    sizes = pool.groupBy("__src").agg(F.max("__size").alias("__n"))
    want = nth.join(F.broadcast(sizes.withColumnRenamed("__src", "__s")), F.col("source") == F.col("__s")).withColumn(
        "__want", F.pmod(F.col("__k") - 1, F.col("__n")) + 1)
    out = want.join(pool, (F.col("source") == F.col("__src")) & (F.col("__want") == F.col("__rn")))
    return out.filter(F.pmod("step", F.lit(shards)) == shard).select("step", "source", "row_key")


def permute_rows(df: DataFrame, columns: Sequence[str], key: Sequence[str], seed: int | str) -> DataFrame:
    """The listed columns move together to other rows; everything else stays (multiset kept)."""
    stay = [c for c in df.columns if c not in columns]
    left = numbered(df.select(*[col(c) for c in stay]), list(key), out="__rn")
    moved = df.withColumn("__h", S.stable_hash(seed, *key))
    right = numbered_by_hash(moved, "__h", key, out="__pn").select("__pn", *[col(c) for c in columns])
    return left.join(right, F.col("__rn") == F.col("__pn")).select(*[col(c) for c in df.columns])


def corrupt_labels(df: DataFrame, label: str, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Permute the labels over the rows."""
    return permute_rows(df, [label], key, seed)


def corrupt_features(
    df: DataFrame, features: Sequence[str], key: Sequence[str], seed: int = 0, together: bool = False,
    also: Sequence[str] = (),
) -> DataFrame:
    """Permute each column on its own, or feature rows together with their key columns."""
    if together:
        return permute_rows(df, [*features, *also], key, seed)
    return reduce(lambda d, f: permute_rows(d, [f], key, f"{seed}:{f}"), features, df)


# ---------------------------------------------------------------- negatives


def eval_negatives(
    rows: DataFrame, positives: DataFrame, id_column: str, k: int, seed: int = 0, label: str = "label"
) -> DataFrame:
    """Positives plus ``k`` negatives per row with the id resampled from all rows' ids.

    Negatives that exist as positives are removed, repeated negatives collapse, and every
    row gets the index of its query (the other columns).
    """
    cols = rows.columns
    others = [c for c in cols if c != id_column]
    ids = numbered(rows, cols, out="__ri")
    (n,) = rows.agg(F.count(F.lit(1))).first()
    draws = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("__k")).withColumn(
        "__want", F.pmod(S.stable_hash(f"{seed}n", *cols, "__k"), F.lit(n)) + 1)
    pool = ids.select(F.col("__ri"), col(id_column).alias("__new"))
    neg = draws.join(pool, F.col("__want") == F.col("__ri")).select(*[col(c) for c in others], F.col("__new").alias(id_column))
    neg = neg.distinct().join(positives.select(*[col(c) for c in cols]).distinct(), cols, "left_anti")
    both = rows.withColumn(label, F.lit(1)).unionByName(neg.withColumn(label, F.lit(0)))
    # negatives only change the id, so the rows hold every query
    return query_index(both.select(*cols, label), [id_column, label], domain=rows)


def batch_negatives(
    rows: DataFrame, target: str, key: str, capacity: int, ratio: int, seed: int = 0, shuffle_rest: bool = False
) -> DataFrame:
    """Each row plus ``ratio`` copies whose target is uniform in [0, capacity).

    ``query_idx`` is the row position in key order; with ``shuffle_rest`` the copies' other
    columns come from permuted rows.
    """
    pos = numbered(rows, [key], out="__rn").withColumn("query_idx", F.col("__rn") - 1)
    out = pos.withColumns({"label": F.lit(1), "copy": F.lit(0)})
    for r in range(1, ratio + 1):
        src = rows
        if shuffle_rest:
            rest = [c for c in rows.columns if c not in (target, key)]
            src = permute_rows(rows, rest, [key], f"{seed}:{r}")
        neg = numbered(src, [key], out="__rn").withColumn("query_idx", F.col("__rn") - 1)
        neg = neg.withColumns({
            target: F.pmod(S.stable_hash(f"{seed}t{r}", key), F.lit(capacity)).cast(rows.schema[target].dataType),
            "label": F.lit(0), "copy": F.lit(r)})
        out = out.unionByName(neg)
    return out.drop("__rn")


# ---------------------------------------------------------------- results and sets


def union_key_domain(parts: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Key values of all sides as one distinct domain."""
    return reduce(DataFrame.unionByName, [df.select(col(c).alias("key")) for df, c in parts]).filter(
        "key is not null").distinct()


def upsert(generations: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union with all columns; the last generation of a key wins."""
    tagged = [g.withColumn("__g", F.lit(i)) for i, g in enumerate(generations)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in both.columns if c not in (*keys, "__g")]
    last = both.groupBy(*[col(k) for k in keys]).agg(F.max(F.struct("__g", *[col(c) for c in rest])).alias("__s"))
    return last.select(*[col(k) for k in keys], *[F.col("__s")[c].alias(c) for c in rest])


def common_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, status): complete when both corpora have it, missing when only the left does."""
    a, b = left.select(col(key)).distinct(), right.select(col(key)).distinct()
    done = a.intersect(b).withColumn("status", F.lit("complete"))
    return done.unionByName(a.join(b, key, "left_anti").withColumn("status", F.lit("missing")))

