"""Structure analytics over a relational corpus: keys, calendars, correlations, labels."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F

from relweave.functions import scalar as S
from relweave.functions.scalar import col
from relweave.operators.predicates import predicate
from relweave.plans.quantiles import column_quantiles, exact_quantile_values, exact_quantiles

NULL_RATE_EDGES = (0.0, 0.01, 0.05, 0.10, 0.15, 0.20, 0.30, 0.50, 1.0)

LABEL_AGGREGATES = {
    "COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MAX": F.max, "MIN": F.min, "STD": F.stddev_samp,
}


# ---------------------------------------------------------------- labels


def agg_apply(rows: DataFrame, by: Sequence[str], column: str, how: str, out: str = "value") -> DataFrame:
    """Aggregate per group; an empty or all-null group gives 0.0."""
    value = LABEL_AGGREGATES[how](S.finite(col(column))).cast("double")
    return rows.groupBy(*[col(c) for c in by]).agg(F.coalesce(value, F.lit(0.0)).alias(out))


def agg_label(
    focal: DataFrame, pk: str, walk: DataFrame, column: str, how: str, op: str = ">", out: str = "label"
) -> DataFrame:
    """Aggregate of a terminal column per focal key against the median of the group values.

    ``walk`` (focal_pk, column...) lists terminal rows per focal key.  Focal rows without a
    valid group get 0 whatever the predicate.
    """
    groups = walk.groupBy("focal_pk").agg(S.finite(LABEL_AGGREGATES[how](col(column))).alias("__v"))
    valid = groups.filter("__v is not null")
    (threshold,) = exact_quantile_values(valid, "__v", [0.5])
    if threshold is None:
        raise ValueError("no group has a valid aggregate")
    labels = valid.select("focal_pk", predicate("__v", op, F.lit(threshold)).cast("int").alias("__y"))
    return (
        focal.join(labels, col(pk) == F.col("focal_pk"), "left")
        .withColumn(out, F.coalesce("__y", F.lit(0)))
        .drop("focal_pk", "__y")
    )


def direct_label(focal: DataFrame, pk: str, walk: DataFrame, column: str, out: str = "label") -> DataFrame:
    """Value of a terminal column: of the non-null values, the one with the lowest terminal key."""
    first = walk.filter(col(column).isNotNull()).groupBy("focal_pk").agg(
        F.min(F.struct("terminal_pk", col(column).alias("v"))).alias("__s"))
    return (
        focal.join(first, col(pk) == F.col("focal_pk"), "left").withColumn(out, F.col("__s.v")).drop("focal_pk", "__s")
    )


# ---------------------------------------------------------------- keys


def fk_null_rate(rows: DataFrame, by: Sequence[str], fk: str) -> DataFrame:
    """(by..., null_count, total_rows, null_rate) per relation."""
    return rows.groupBy(*[col(c) for c in by]).agg(
        F.sum(col(fk).isNull().cast("long")).alias("null_count"), F.count(F.lit(1)).alias("total_rows"),
    ).withColumn("null_rate", F.col("null_count") / F.col("total_rows"))


def null_rate_summary(rates: DataFrame) -> DataFrame:
    """Mean, median, min, max, std and an eight-bucket histogram of the null rates."""
    r = F.col("null_rate")
    edges = list(zip(NULL_RATE_EDGES, NULL_RATE_EDGES[1:]))
    buckets = [
        F.sum(((r >= lo) & (r < hi)).cast("long")).alias(f"bucket_{i}") for i, (lo, hi) in enumerate(edges)
    ]
    return rates.agg(
        F.count(F.lit(1)).alias("relations"), F.avg(r).alias("mean"), F.median(r).alias("median"),
        F.min(r).alias("min"), F.max(r).alias("max"), F.stddev_pop(r).alias("std"), *buckets)


def top_sparsest(rates: DataFrame, by: Sequence[str], n: int = 10) -> DataFrame:
    """The ``n`` relations with the largest null rate, ties by name."""
    return rates.orderBy(F.col("null_rate").desc(), *[col(c) for c in by]).limit(n)


def entity_density(rows: DataFrame, by: Sequence[str], entity: str) -> DataFrame:
    """Rows, distinct entities, snapshots per entity, coverage and the pair bound 1/n; null is no entity."""
    keys = [col(c) for c in by]
    per = rows.groupBy(*keys, col(entity).alias("__e")).agg(F.count(F.lit(1)).alias("__n"))
    known = F.col("__e").isNotNull()
    n = F.sum(known.cast("long"))
    return per.groupBy(*keys).agg(
        F.sum("__n").alias("n_rows"), n.alias("n_entities"),
        F.coalesce(F.min(F.when(known, F.col("__n"))), F.lit(0)).alias("min_snapshots"),
        F.coalesce(F.avg(F.when(known, F.col("__n"))), F.lit(0.0)).alias("avg_snapshots"),
        F.coalesce(F.max(F.when(known, F.col("__n"))), F.lit(0)).alias("max_snapshots"),
        (F.coalesce(F.sum(F.when(known, F.col("__n"))), F.lit(0)) / F.sum("__n")).alias("coverage"),
        F.when(n > 0, 1.0 / n).otherwise(F.lit(0.0)).alias("pair_bound"))


def _entropy(count: Column) -> Column:
    """Entropy of a grouped count, as an aggregate: ln N - sum(c ln c) / N."""
    return F.ln(F.sum(count)) - F.sum(count * F.ln(count)) / F.sum(count)


def effective_parent_coverage(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """exp(entropy of the key assignment) over the parent rows; only keys that exist count."""
    known = child.join(parent.select(col(pk).alias("__pk")), col(fk) == F.col("__pk"), "left_semi")
    counts = known.groupBy(col(fk)).agg(F.count(F.lit(1)).alias("n"))
    parents = parent.agg(F.count(F.lit(1)).alias("parents"))
    spread = counts.agg(F.exp(_entropy(F.col("n"))).alias("e"), F.sum("n").alias("child_rows"))
    # two one-row results side by side
    return spread.join(parents).select("child_rows", "parents", (F.col("e") / F.col("parents")).alias("coverage"))


def multi_parent_nmi(df: DataFrame, left: str, right: str) -> DataFrame:
    """Normalised mutual information (arithmetic mean); null when either side is constant."""
    joint = df.filter(col(left).isNotNull() & col(right).isNotNull()).groupBy(
        col(left).alias("x"), col(right).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    xs = joint.groupBy("x").agg(F.sum("n").alias("n")).agg(_entropy(F.col("n")).alias("hx"), F.count(F.lit(1)).alias("kx"))
    ys = joint.groupBy("y").agg(F.sum("n").alias("n")).agg(_entropy(F.col("n")).alias("hy"), F.count(F.lit(1)).alias("ky"))
    hxy = joint.agg(_entropy(F.col("n")).alias("hxy"))
    nmi = (F.col("hx") + F.col("hy") - F.col("hxy")) / ((F.col("hx") + F.col("hy")) / 2)
    return xs.join(ys).join(hxy).select(F.when((F.col("kx") > 1) & (F.col("ky") > 1), nmi).alias("nmi"))


# ---------------------------------------------------------------- calendars


def monthly_activity(events: DataFrame, name: str, ts: str) -> DataFrame:
    """(name, month, share) over the months from the first to the last of all events.

    Months count from January 1970. Names with < 2 rows or a flat curve drop out.
    """
    month = (F.year(col(ts)) - 1970) * 12 + F.month(col(ts)) - 1
    counts = events.filter(col(ts).isNotNull()).groupBy(col(name).alias("name"), month.alias("month")).agg(
        F.count(F.lit(1)).alias("n"))
    first, last = counts.agg(F.min("month"), F.max("month")).first()
    if first is None:
        first, last = 0, 0
    months = last - first + 1
    totals = counts.groupBy("name").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi")
    ).filter((F.col("total") >= 2) & ((F.col("k") < months) | (F.col("lo") < F.col("hi"))))
    axis = totals.select("name", "total", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("month"))
    return axis.join(counts, ["name", "month"], "left").select(
        "name", "month", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def calendar_synchrony(curves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of the monthly curves of each pair of tables of a database.

    The pairs are the result: a database has few tables, and ``by`` keeps databases apart.
    """
    keys = [col(c) for c in by]
    left = curves.select(*keys, F.col("name").alias("a"), "month", F.col("share").alias("x"))
    right = curves.select(*keys, F.col("name").alias("b"), "month", F.col("share").alias("y"))
    return left.join(right, [*by, "month"]).filter("a < b").groupBy(*keys, "a", "b").agg(S.corr(F.col("x"), F.col("y")).alias("r"))


# ---------------------------------------------------------------- correlations


def pairwise_corr(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), clean: bool = True) -> DataFrame:
    """Long (by..., a, b, r) over all column pairs from one aggregation pass; r is null when undefined."""
    def x(c: str) -> Column:
        return F.coalesce(S.finite(col(c)), F.lit(0.0)) if clean else col(c)

    pairs = list(itertools.combinations(columns, 2))
    row = df.groupBy(*[col(c) for c in by]).agg(*[S.corr(x(a), x(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(~F.isnan(f"r{i}"), F.col(f"r{i}")).alias("r"))
        for i, (a, b) in enumerate(pairs)
    ])
    return row.select(*[col(c) for c in by], F.inline(items))


def feature_variance_corr(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Median and mean of the sample variances and of the absolute pairwise correlations.

    Non-finite values count as zero for the correlations.
    """
    keys = [col(c) for c in by]
    var = df.groupBy(*keys).agg(*[F.var_samp(S.finite(col(c))).alias(f"v{i}") for i, c in enumerate(columns)])
    items = F.array(*[F.col(f"v{i}") for i in range(len(columns))])
    long = var.select(*keys, F.explode(items).alias("v")).filter("v is not null and not isnan(v)")
    vs = long.groupBy(*keys).agg(F.median("v").alias("feature_var_p50"), F.avg("v").alias("feature_var_mean"))
    pairs = pairwise_corr(df, list(columns), by).filter("r is not null")
    rs = pairs.groupBy(*keys).agg(F.median(F.abs("r")).alias("avg_abs_corr_p50"), F.avg(F.abs("r")).alias("avg_abs_corr_mean"))
    joined = vs.join(rs, list(by), "left") if by else vs.join(rs)
    return joined.withColumn("n_features", F.lit(len(columns)))


def group_abs_corr(pairs: DataFrame, groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute correlation within native, within joined, native x joined and across parents.

    ``groups`` (column, kind, parent) describes the columns; kind is native or joined.
    """
    a = groups.select(F.col("column").alias("a"), F.col("kind").alias("ka"), F.col("parent").alias("pa"))
    b = groups.select(F.col("column").alias("b"), F.col("kind").alias("kb"), F.col("parent").alias("pb"))
    both_joined = (F.col("ka") == "joined") & (F.col("kb") == "joined")
    kind = (
        F.when((F.col("ka") == "native") & (F.col("kb") == "native"), "native")
        .when(both_joined & (F.col("pa") == F.col("pb")), "joined")
        .when(both_joined, "cross_parent")
        .otherwise("native_joined")
    )
    return pairs.filter("r is not null").join(a, "a").join(b, "b").withColumn("pair_kind", kind).groupBy(
        *[col(c) for c in by], "pair_kind").agg(F.avg(F.abs("r")).alias("mean_abs_corr"), F.count(F.lit(1)).alias("n_pairs"))


def feature_label_corr(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """Long (by..., feature, abs_corr) of |Pearson(feature, label)|; constant sides drop out."""
    row = df.groupBy(*[col(c) for c in by]).agg(*[
        F.abs(S.corr(col(f).cast("double"), col(label).cast("double"))).alias(f"c{i}") for i, f in enumerate(features)])
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c{i}").alias("abs_corr")) for i, f in enumerate(features)])
    return row.select(*[col(c) for c in by], F.inline(items)).filter("abs_corr is not null and not isnan(abs_corr)")


def median_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-finite values replaced by the column median (0 when there is none)."""
    fills = {c: q[0] for c, q in column_quantiles(df, {c: S.finite(col(c)) for c in columns}, [0.5]).items()}
    return df.select(*[F.coalesce(S.finite(col(c)), F.lit(fills[c] if fills[c] is not None else 0.0)).alias(c) for c in columns])


def strong_corr_rate(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Share of eligible feature pairs with |r| at or above the threshold."""
    pairs = pairwise_corr(median_filled(df, columns), columns).filter("r is not null")
    return pairs.agg(F.avg((F.abs("r") >= threshold).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n_pairs"))


def correlation_matrix(df: DataFrame, columns: Sequence[str], eps: float = 1e-12) -> np.ndarray:
    """p x p correlation of the varying columns; the sums are distributed, only p x p is collected."""
    row = df.agg(*[F.stddev_pop(col(c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    varying = [c for i, c in enumerate(columns) if (row[f"s{i}"] or 0.0) > eps]
    if len(varying) < 2:
        return np.zeros((0, 0))
    vec = VectorAssembler(inputCols=varying, outputCol="__v").transform(df.select(*[col(c) for c in varying]))
    return Correlation.corr(vec, "__v").first()[0].toArray()


def effective_rank(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank measures of the correlation spectrum, from one distributed matrix.

    effective_rank: exp(entropy of the eigenvalue shares) / p; eigen_entropy: entropy over
    ln(number of positive eigenvalues); top5_ratio: share of the five largest eigenvalues;
    rank95_ratio: eigenvalues needed for 95% of the variance over p.
    """
    corr = correlation_matrix(median_filled(df, columns), columns)
    p = corr.shape[0]
    schema = "n_features int, effective_rank double, eigen_entropy double, top5_ratio double, rank95_ratio double"
    if p < 2:
        return df.sparkSession.createDataFrame([(p, None, None, None, None)], schema)
    values = np.sort(np.clip(np.linalg.eigvalsh(corr), 0.0, None))[::-1]
    share = values / values.sum()
    positive = share[values > 1e-12]
    entropy = float(-(positive * np.log(positive)).sum())
    kept = share[values > 1e-10]
    normal = entropy / np.log(len(kept)) if len(kept) > 1 else 0.0
    rank95 = int(np.searchsorted(np.cumsum(share), 0.95)) + 1
    return df.sparkSession.createDataFrame(
        [(p, float(np.exp(entropy) / p), float(normal), float(share[:5].sum()), rank95 / p)], schema)


# ---------------------------------------------------------------- corpus summaries


def corpus_summary(tasks: DataFrame, corpus: str, task: str, metric: str) -> DataFrame:
    """Median and quartiles of a task metric per corpus, and its median exemplar (ties by id)."""
    known = tasks.filter(col(metric).isNotNull())
    q = exact_quantiles(known, metric, {"median": 0.5, "q1": 0.25, "q3": 0.75}, [corpus])
    near = known.join(q.select(col(corpus), "median"), corpus).groupBy(col(corpus)).agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.min(F.struct(F.abs(col(metric) - F.col("median")).alias("d"), col(task).alias("t"))).alias("s"))
    return q.join(near, corpus).select(col(corpus), "n_tasks", "median", "q1", "q3", F.col("s.t").alias("exemplar"))


def dispersion(values: DataFrame, by: str, metric: str) -> DataFrame:
    """Mean, population std, coefficient of variation, P10 and P90 of a per-database metric."""
    q = exact_quantiles(values, metric, {"p10": 0.1, "p90": 0.9}, [by])
    m = values.groupBy(col(by)).agg(F.count(col(metric)).alias("n"), F.avg(col(metric)).alias("mean"),
                                    F.stddev_pop(col(metric)).alias("std"))
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean"))
    return m.join(q, by).withColumn("cv", cv)


def entity_overlap(rows: DataFrame, by: Sequence[str], entity: str, is_support: Column) -> DataFrame:
    """Query rows whose entity is in the support set; null is no entity.

    Both sides are counted per entity before they meet, so a hot entity is one row.
    """
    keys = [col(c) for c in by]
    per = rows.groupBy(*keys, col(entity).alias("e")).agg(
        F.sum(is_support.cast("long")).alias("s"), F.sum((~is_support).cast("long")).alias("q"))
    known = F.col("e").isNotNull()
    hit = known & (F.col("s") > 0)
    shares = per.groupBy(*keys).agg(
        F.sum(F.when(known, F.col("q")).otherwise(0)).alias("n_query_valid"),
        F.sum(F.when(hit, F.col("q")).otherwise(0)).alias("n_query_matched"), F.sum("q").alias("__q"))
    # the matched support count of each query row: value s, weight q
    weighted = per.filter(hit & (F.col("q") > 0)).groupBy(*keys, "s").agg(F.sum("q").alias("n"))
    w = Window.partitionBy(*keys).orderBy("s")
    total = F.sum("n").over(Window.partitionBy(*keys))
    ranked = weighted.withColumn("upto", F.sum("n").over(w)).withColumn("total", total)

    def quantile(p: float) -> Column:
        pos = F.lit(p) * (F.col("total") - 1)
        lo = F.min(F.when(F.col("upto") > F.floor(pos), F.col("s")))
        hi = F.min(F.when(F.col("upto") > F.ceil(pos), F.col("s")))
        return lo + (hi - lo) * F.max(pos - F.floor(pos))

    qs = ranked.groupBy(*keys).agg(quantile(0.5).alias("matched_median"), quantile(0.9).alias("matched_p90"))
    joined = shares.join(qs, list(by), "left") if by else shares.join(qs)
    valid = F.col("n_query_valid") > 0
    return joined.select(
        *keys, "n_query_valid", "n_query_matched",
        F.when(F.col("__q") > 0, F.col("n_query_valid") / F.col("__q")).alias("valid_query_fraction"),
        F.when(valid, F.col("n_query_matched") / F.col("n_query_valid")).alias("query_support_overlap"),
        F.when(valid, F.coalesce("matched_median", F.lit(0.0))).alias("matched_median"),
        F.when(valid, F.coalesce("matched_p90", F.lit(0.0))).alias("matched_p90"))


def homophily_rate(rows: DataFrame, block: str, label: str) -> DataFrame:
    """Share of same-block row pairs with the same label, exactly and without forming pairs."""
    cell = rows.groupBy(col(block).alias("b"), col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    blocks = cell.groupBy("b").agg(F.sum("n").alias("t"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"))
    pairs = F.sum(F.col("t") * (F.col("t") - 1) / 2)
    return blocks.agg(F.coalesce(F.when(pairs > 0, F.sum("same") / pairs), F.lit(0.0)).alias("homophily"), pairs.alias("pairs"))


def label_constancy(rows: DataFrame, task: str, entity: str | None, label: str) -> DataFrame:
    """Rows, entities and the share of entities whose label never varies; -1 without an entity column."""
    if entity is None:
        return rows.groupBy(col(task)).agg(
            F.count(F.lit(1)).alias("n_rows"), F.lit(0).cast("long").alias("n_entities"), F.lit(-1.0).alias("constant_share"))
    y = col(label)
    per = rows.groupBy(col(task), col(entity).alias("e")).agg(
        F.count(F.lit(1)).alias("n"),
        (F.coalesce(F.min(y) == F.max(y), F.lit(True)) & ((F.count(y) == 0) | (F.count(y) == F.count(F.lit(1))))).alias("same"))
    known = F.col("e").isNotNull()
    return per.groupBy(col(task)).agg(
        F.sum("n").alias("n_rows"), F.sum(known.cast("long")).alias("n_entities"),
        F.coalesce(F.avg(F.when(known, F.col("same").cast("double"))), F.lit(0.0)).alias("constant_share"))
