"""Task screening, drift between samples, and learnability probes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from relweave.functions import scalar as S
from relweave.functions.scalar import col
from relweave.model import FLOAT, RelationalDataset
from relweave.operators import metrics as M
from relweave.operators.compare import poisson_weights_of
from relweave.operators.joins import shortest_path, walk_keys
from relweave.operators.splits import capped_rows
from relweave.operators.structure import LABEL_AGGREGATES, effective_rank
from relweave.plans.logistic import fit_logistic, score_logistic
from relweave.plans.ordering import bucket_count, numbered_by_hash, order_bucket, shuffle_width, small_side
from relweave.plans.quantiles import exact_quantile_values, exact_quantiles
from relweave.plans.steps import Line, compare_steps, union
from relweave.session import materialize

# screening thresholds (fixed values)
POSITIVE_SHARE = (0.05, 0.95)
MIN_ROWS = 64
MIN_CLASS = 8
SIZE_RATIO = 100
AUC_HARD_REJECT = 0.52
AUC_HARD_ACCEPT = 0.58
AUC_BASELINE = 0.55
LEAK_SINGLE = 0.90
LEAK_DROP = 0.10

# rows of all forests that grow side by side (two always may)
FOREST_ROWS = 16_000_000

# rows whose bootstrap weights are made at once
_WEIGHED = 4096


# ---------------------------------------------------------------- candidates


def task_candidates(
    ds: RelationalDataset, focal: str, max_hops: int, aggregates: Sequence[str] = ("COUNT", "SUM", "AVG", "MAX", "MIN", "STD"),
) -> DataFrame:
    """(candidate, kind, n_rows, n_distinct, balance) of every label a focal table could have.

    To-one terminals offer their columns directly (balance: share of the largest class);
    others every column aggregate (balance: share above the median of the groups; values are
    compared to 9 places, as sums depend on their order).  One join
    chain per terminal table, all its aggregates together.
    """
    aggs, direct = [], []
    for name, meta in ds.meta.items():
        try:
            path = shortest_path(ds, focal, name)
        except ValueError:
            continue
        if len(path) > max_hops:
            continue
        numeric = [c.name for c in meta.columns if c.dtype == FLOAT and not c.is_vector]
        category = [c.name for c in meta.columns if c.dtype == "category"]
        if all(fwd for _, fwd in path):
            if category:
                walk = walk_keys(ds, focal, name, category)
                items = [F.struct(F.lit(f"{name}.{c}").alias("candidate"), col(c).cast("string").alias("v")) for c in category]
                direct.append(walk.select(F.inline(F.array(*items))))
        elif numeric:
            walk = walk_keys(ds, focal, name, numeric)
            pairs = [(a, c) for c in numeric for a in aggregates]
            wide = walk.groupBy("focal_pk").agg(*[
                LABEL_AGGREGATES[a](S.finite(col(c))).cast("double").alias(f"x{i}") for i, (a, c) in enumerate(pairs)])
            items = [F.struct(F.lit(f"{a}({name}.{c})").alias("candidate"), F.round(S.finite(F.col(f"x{i}")), 9).alias("v"))
                     for i, (a, c) in enumerate(pairs)]
            aggs.append(wide.select(F.inline(F.array(*items))))
    out = None
    if aggs:
        long = aggs[0]
        for more in aggs[1:]:
            long = long.unionByName(more)
        long = long.filter("v is not null")
        med = exact_quantiles(long, "v", {"m": 0.5}, ["candidate"])
        cells = long.groupBy("candidate", "v").agg(F.count(F.lit(1)).alias("n"))
        out = cells.join(F.broadcast(med), "candidate").groupBy("candidate").agg(
            F.lit("aggregate").alias("kind"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
            (F.sum(F.when(F.col("v") > F.col("m"), F.col("n")).otherwise(0)) / F.sum("n")).alias("balance"))
    if direct:
        long = direct[0]
        for more in direct[1:]:
            long = long.unionByName(more)
        cells = long.filter("v is not null").groupBy("candidate", "v").agg(F.count(F.lit(1)).alias("n"))
        part = cells.groupBy("candidate").agg(
            F.lit("direct").alias("kind"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
            (F.max("n") / F.sum("n")).alias("balance"))
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- stage A


def stage_a(
    rows: DataFrame, by: Sequence[str], label: str, features: Sequence[str], parents: DataFrame | None = None,
    parent_rows: str = "parent_rows",
) -> DataFrame:
    """Rule screening per task in one aggregation: label, balance, size, features, size ratio.

    ``failures`` lists the broken rules; ``parents`` (by..., parent_rows) adds the ratio rule.
    """
    keys = [col(c) for c in by]
    y = col(label)
    varied = [
        ((F.count(S.finite(col(f))) > 0) & (F.min(S.finite(col(f))) != F.max(S.finite(col(f))))).cast("int") for f in features
    ]
    n_features = varied[0] if varied else F.lit(0)
    for v in varied[1:]:
        n_features = n_features + v
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum((y == 1).cast("long")).alias("n_pos"),
        F.sum((y == 0).cast("long")).alias("n_neg"), (F.min(y) == F.max(y)).alias("__same"), n_features.alias("n_features"))
    agg = agg.withColumn("pos_ratio", F.col("n_pos") / F.col("n_samples"))
    ratio = F.lit(None).cast("double")
    if parents is not None:
        agg = agg.join(parents, list(by), "left")
        ratio = F.col("n_samples") / F.when(col(parent_rows) > 0, col(parent_rows))
    one_class = F.col("__same")
    small = F.least("n_pos", "n_neg")
    rules = [
        (one_class, "a1_single_class"),
        (~one_class & ((F.col("pos_ratio") < POSITIVE_SHARE[0]) | (F.col("pos_ratio") > POSITIVE_SHARE[1])), "a2_pos_ratio"),
        (~one_class & (F.col("n_samples") < MIN_ROWS), "a3_rows"),
        (~one_class & (small < MIN_CLASS), "a3_min_class"),
        (~one_class & F.lit(len(features) == 0), "a4_no_features"),
        (~one_class & F.lit(len(features) > 0) & (F.col("n_features") == 0), "a4_all_constant"),
        (~one_class & F.coalesce((ratio > SIZE_RATIO) | (ratio < 1.0 / SIZE_RATIO), F.lit(False)), "a6_size_ratio"),
    ]
    failures = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))
    return agg.withColumn("failures", F.array_join(failures, ",")).select(
        *keys, "n_samples", "n_pos", "n_neg", "pos_ratio", "n_features", "failures", (F.col("failures") == "").alias("a_pass"))


def manifest(verdicts: DataFrame, db: str, task: str, passed: str) -> DataFrame:
    """Passing tasks of databases with any, beside every database's task counts."""
    per_db = verdicts.groupBy(col(db).alias("__db")).agg(
        F.count(F.lit(1)).alias("db_tasks"), F.sum(col(passed).cast("long")).alias("db_passing"))
    return verdicts.filter(col(passed)).join(per_db, col(db) == F.col("__db")).drop("__db").select(
        col(db), col(task), "db_tasks", "db_passing")


def screen(stage_a_rows: DataFrame, learned: DataFrame, by: Sequence[str]) -> DataFrame:
    """One verdict per task from both stages: rules first, then learnability and leaks.

    ``learned`` (by..., auc, ci_low, ci_high, gray, b_pass and, if known, leaks) needs a row for
    each task that passes the rules; one without a row fails closed.
    """
    names = [f"__k{i}" for i in range(len(by))]
    leaks = F.coalesce(F.col("leaks"), F.lit(False)) if "leaks" in learned.columns else F.lit(False)
    b = learned.select(*[col(c).alias(n) for c, n in zip(by, names)], "auc", "ci_low", "ci_high", "b_pass", leaks.alias("__leaks"), F.lit(True).alias("__seen"))
    both = stage_a_rows.join(b, [F.col("a_pass"), *[col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)]], "left").drop(*names)
    failed = F.array_join(F.array_compact(F.array(
        F.when(F.col("failures") != "", F.col("failures")),
        F.when(F.col("a_pass") & F.col("__seen").isNull(), "audit_error"),
        F.when(F.col("a_pass") & ~F.col("b_pass"), "b2_unlearnable"),
        F.when(F.col("a_pass") & F.col("__leaks"), "b3_leakage"))), ",")
    out = both.withColumn("failures", failed).withColumn("passed", F.col("failures") == "")
    stage = F.when(~F.col("a_pass"), "A").when(~F.col("passed"), "B").otherwise("PASS")
    return out.withColumn("stage", stage).drop("__leaks", "__seen", "b_pass")


# ---------------------------------------------------------------- stage B


def probe_rows(
    rows: DataFrame, task: str, key: Sequence[str], label: str, features: Sequence[str], folds: int = 3, seed: int = 42
) -> DataFrame:
    """(key..., task, y, fold, x): features filled by the task's median, stratified folds in hash order.

    Rows of all tasks lie in one table, so every later step runs once for all of them.
    """
    names = [f"__f{i}" for i in range(len(features))]
    base = rows.select(*[col(k) for k in key], col(task).cast("string").alias("task"), col(label).cast("double").alias("y"),
                       *[S.finite(col(f)).alias(n) for f, n in zip(features, names)])
    items = F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("v")) for n in names])
    med = exact_quantiles(base.select("task", F.inline(items)), "v", {"m": 0.5}, ["task", "f"])
    wide = med.groupBy(F.col("task").alias("__t")).agg(*[F.max(F.when(F.col("f") == n, F.col("m"))).alias(f"__m{i}") for i, n in enumerate(names)])
    h = base.withColumn("__h", S.stable_hash(seed, *key))
    dealt = numbered_by_hash(h, "__h", key, ["task", "y"], "__rn")
    x = F.array(*[F.coalesce(F.col(n), F.col(f"__m{i}"), F.lit(0.0)) for i, n in enumerate(names)])
    out = dealt.join(small_side(wide), F.col("task") == F.col("__t"), "left")
    return out.select(*[col(k) for k in key], "task", "y", F.pmod("__rn", F.lit(folds)).cast("int").alias("fold"), x.alias("x"))


def forest(trees: int = 64, depth: int = 12, seed: int = 42):
    return lambda: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True)


def forest_scores(probe: DataFrame, key: Sequence[str], trees: int = 64, depth: int = 12, folds: int = 3, seed: int = 42, at_once: int = 8) -> DataFrame:
    """(key..., task, y, score): each fold of each task scored by a forest grown on the others.

    Every fit is a Spark job of its own and ``at_once`` of them run side by side, each in its own
    scheduler pool, so small tasks don't queue behind each other.  A fit keeps the node of each
    row in each tree, so a row is not walked down again at every depth; of large tasks fewer run
    side by side, as one fills the cluster and its rows should stay in memory.
    """
    spark = probe.sparkSession
    ready = materialize(probe.withColumn("v", array_to_vector("x")))
    sizes = {r["task"]: r["count"] for r in ready.groupBy("task").count().orderBy("task").collect()}
    tasks = list(sizes)
    at_once = max(2, min(at_once, FOREST_ROWS // max([1, *sizes.values()])))

    def fit(work: tuple[str, int]):
        name, fold = work
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"forest-{name}-{fold}")
        mine = ready.filter(F.col("task") == name)
        model = forest(trees, depth, seed)().setFeaturesCol("v").setLabelCol("y").fit(mine.filter(F.col("fold") != fold))
        scored = model.transform(mine.filter(F.col("fold") == fold))
        return scored.select(*[col(k) for k in key], "task", "y", vector_to_array("probability")[1].alias("score"))

    with ThreadPoolExecutor(at_once) as pool:
        parts = list(pool.map(inheritable_thread_target(fit), [(t, k) for t in tasks for k in range(folds)]))
    return reduce(DataFrame.unionByName, parts)


def bootstrap_auc(scored: DataFrame, key: Sequence[str], draws: int = 100, seed: int = 42) -> DataFrame:
    """(task, auc, ci_low, ci_high): mean and 95% interval of each task's AUC under resampling of its rows.

    A row's Poisson(1) weights in all draws are one vector.  Rows are cut into ordered buckets of
    scores; a bucket sums its positives, its negatives and the wins inside it as vectors in one
    pass, and buckets are put together in order, so no row is made per draw.
    """
    rows = materialize(scored.select("task", F.concat_ws("|", *[col(k).cast("string") for k in key]).alias("u"), "y", "score"))
    cut = rows.withColumn("b", order_bucket(rows, ["score"], bucket_count(rows)))
    dealt = cut.repartition(shuffle_width(cut), "task", "b").sortWithinPartitions("task", "b", "score").select("task", "b", "score", "y", "u")

    def sums(batches):
        here, value = None, None
        pos = neg = wins = tied_pos = tied_neg = None

        def settle():
            nonlocal pos, neg, wins, tied_pos, tied_neg
            wins = wins + tied_pos * (neg + tied_neg / 2)
            pos, neg = pos + tied_pos, neg + tied_neg
            tied_pos, tied_neg = np.zeros(draws), np.zeros(draws)

        def end():
            settle()
            return pa.RecordBatch.from_pydict({
                "task": [here[0]], "b": pa.array([here[1]], pa.int32()), "pos": [pos.tobytes()], "neg": [neg.tobytes()], "wins": [wins.tobytes()]})

        for batch in batches:
            for at in range(0, batch.num_rows, _WEIGHED):
                part = batch.slice(at, _WEIGHED)
                task, b, score, y = (part.column(c).to_numpy(zero_copy_only=False) for c in ("task", "b", "score", "y"))
                null = part.column("score").is_null().to_numpy(zero_copy_only=False)
                w = poisson_weights_of(part.column("u").to_pylist(), draws, seed).astype(float)
                w_pos, w_neg = w * (y == 1)[:, None], w * (y != 1)[:, None]
                other = (task[1:] != task[:-1]) | (b[1:] != b[:-1])
                fresh = other | ((score[1:] != score[:-1]) & ~(null[1:] & null[:-1]))  # nulls are one score
                start = np.concatenate([[0], np.flatnonzero(fresh) + 1])
                p, n = np.add.reduceat(w_pos, start, axis=0), np.add.reduceat(w_neg, start, axis=0)
                cuts = np.concatenate([[0], np.searchsorted(start, np.flatnonzero(other) + 1), [len(start)]])
                for lo, hi in zip(cuts[:-1], cuts[1:]):  # the scores lo to hi are of one bucket
                    first, last = start[lo], start[hi - 1]
                    if (task[first], b[first]) != here:
                        if here is not None:
                            yield end()
                        here, value = (task[first], b[first]), None
                        pos, neg, wins, tied_pos, tied_neg = (np.zeros(draws) for _ in range(5))
                    if value != (None if null[first] else score[first]):
                        settle()
                    tied_pos, tied_neg = tied_pos + p[lo], tied_neg + n[lo]
                    if hi - lo > 1:
                        settle()
                        p_in, n_in = p[lo + 1:hi - 1], n[lo + 1:hi - 1]
                        wins = wins + np.einsum("ij,ij->j", p_in, neg + np.cumsum(n_in, axis=0) - n_in / 2)
                        pos, neg = pos + p_in.sum(0), neg + n_in.sum(0)
                        tied_pos, tied_neg = p[hi - 1], n[hi - 1]
                    value = None if null[last] else score[last]
        if here is not None:
            yield end()

    def combine(task: tuple, parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("b")
        pos, neg, wins = (np.stack([np.frombuffer(v, float) for v in parts.column(c).to_pylist()]) for c in ("pos", "neg", "wins"))
        before = np.cumsum(neg, axis=0) - neg
        pairs = pos.sum(0) * neg.sum(0)
        auc = np.where(pairs > 0, (wins + pos * before).sum(0) / np.where(pairs > 0, pairs, 1), 0.5)
        return pa.table({"task": [task[0].as_py()], "auc": [float(auc.mean())], "ci_low": [float(np.percentile(auc, 2.5))], "ci_high": [float(np.percentile(auc, 97.5))]})

    # a task has at most as many buckets as a shuffle has tasks
    buckets = dealt.mapInArrow(sums, "task string, b int, pos binary, neg binary, wins binary")
    return buckets.groupBy("task").applyInArrow(combine, "task string, auc double, ci_low double, ci_high double")


def learnability(scored: DataFrame, key: Sequence[str], draws: int = 100, seed: int = 42) -> DataFrame:
    """(task, auc, ci_low, ci_high, gray, b_pass) from out-of-fold scores of any model.

    An AUC of at most 0.52 is rejected, one from 0.58 is accepted; between them a task passes if
    its bootstrap interval reaches 0.55, and its AUC is the mean of the draws.  One class alone counts as 0.5.
    """
    auc = materialize(M.auroc(scored, F.col("y") == 1, "score", ["task"]).select("task", F.coalesce("auroc", F.lit(0.5)).alias("auc")))
    gray = (F.col("auc") > AUC_HARD_REJECT) & (F.col("auc") < AUC_HARD_ACCEPT)
    doubtful = scored.join(auc.filter(gray).select(F.col("task").alias("__t")), F.col("task") == F.col("__t"), "left_semi")
    drawn = bootstrap_auc(doubtful, key, draws, seed).withColumnsRenamed({"task": "__t", "auc": "__mean"})
    return auc.join(drawn, F.col("task") == F.col("__t"), "left").select(
        "task", F.coalesce("__mean", "auc").alias("auc"), "ci_low", "ci_high", gray.alias("gray"),
        F.when(gray, F.col("ci_high") >= AUC_BASELINE).otherwise(F.col("auc") >= AUC_HARD_ACCEPT).alias("b_pass"))


def stage_b(
    rows: DataFrame, task: str, key: Sequence[str], label: str, features: Sequence[str], trees: int = 64, depth: int = 12,
    draws: int = 100, seed: int = 42,
) -> DataFrame:
    """Out-of-fold tree AUC of every task of a long table: see ``learnability``."""
    probe = probe_rows(rows, task, key, label, features, 3, seed)
    return learnability(materialize(forest_scores(probe, key, trees, depth, 3, seed)), key, draws, seed)


def single_column_auc(df: DataFrame, columns: Sequence[str], y: Column) -> DataFrame:
    """(column, auc): rank AUC of each column alone, whichever direction; nulls take the column median."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), _as_number(df, c).alias("x")) for c in columns])
    long = df.select(y.alias("__y"), F.inline(items))
    med = exact_quantiles(long, "x", {"m": 0.5}, ["column"]).withColumnRenamed("column", "__c")
    filled = long.join(F.broadcast(med), F.col("column") == F.col("__c"), "left").withColumn("x", F.coalesce("x", "m"))
    auc = M.auroc(filled, F.col("__y"), "x", ["column"])
    return auc.select("column", F.greatest(F.col("auroc"), 1 - F.col("auroc")).alias("auc"))


def _as_number(df: DataFrame, c: str) -> Column:
    return (S.epoch_micros(c) if "timestamp" in df.schema[c].dataType.simpleString() else col(c)).cast("double")


def leakage_check(
    df: DataFrame, columns: Sequence[str], y: Column, features: Sequence[str], key: Sequence[str], folds: int = 5, seed: int = 42
) -> DataFrame:
    """(column, auc, full_auc, without_auc, suspicious, leaks) of each id or time column.

    A column is suspicious if it alone reaches an AUC of 0.90, whichever direction.  It leaks
    if a model on all of ``features`` and ``columns`` also loses more than 0.10 of its out-of-fold
    AUC without it.  The model with everything and those without one column each are fitted
    together (``plans.logistic``).
    """
    used = [*features, *columns]
    wide = df.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.lit("all").alias("__task"), y.cast("int").alias("__label"),
                     *[_as_number(df, c).alias(f"__c{i}") for i, c in enumerate(used)])
    keys = [f"__k{i}" for i in range(len(key))]
    probe = materialize(probe_rows(wide, "__task", keys, "__label", [f"__c{i}" for i in range(len(used))], folds, seed))
    out = [-1, *range(len(features), len(used))]
    weights, scale = fit_logistic(probe, len(used), folds, out)
    scored = score_logistic(probe, ["y"], weights, scale, out)
    aucs = M.auroc(scored, F.col("y") == 1, "score", ["left_out"])
    whole = aucs.filter("left_out = -1").select(F.coalesce("auroc", F.lit(0.5)).alias("full_auc"))
    name = F.array(*[F.lit(c) for c in columns])[F.col("left_out") - len(features)]
    without = aucs.filter("left_out >= 0").select(name.alias("__c"), F.coalesce("auroc", F.lit(0.5)).alias("without_auc")).join(whole)  # one row
    suspicious = F.col("auc") >= LEAK_SINGLE
    single = single_column_auc(df, columns, y).join(without, F.col("column") == F.col("__c"))
    return single.select("column", "auc", "full_auc", "without_auc", suspicious.alias("suspicious"),
                         (suspicious & (F.col("full_auc") - F.col("without_auc") > LEAK_DROP)).alias("leaks"))


def linear_probe(rows: DataFrame, task: str, key: Sequence[str], label: str, features: Sequence[str], folds: int = 3, seed: int = 42) -> DataFrame:
    """(task, auc, easy, hard): mean AUC over the folds of a logistic regression, above 0.8 or below 0.6.

    All tasks and folds of a long table are fitted together (``plans.logistic``).
    """
    probe = materialize(probe_rows(rows, task, key, label, features, folds, seed))
    weights, scale = fit_logistic(probe, len(features), folds)
    scored = score_logistic(probe, ["task", "fold", "y"], weights, scale)
    per = M.auroc(scored, F.col("y") == 1, "score", ["task", "fold"])
    return per.groupBy("task").agg(F.avg("auroc").alias("auc")).select(
        "task", "auc", (F.col("auc") > 0.8).alias("easy"), (F.col("auc") < 0.6).alias("hard"))


# ---------------------------------------------------------------- drift


def _moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, list[tuple[float, float]]]:
    """Rows, and the mean and sample deviation of each column; null and non-finite values count as 0."""
    xs = [F.coalesce(S.finite(col(c)), F.lit(0.0)) for c in columns]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{k}{i}") for i, x in enumerate(xs) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return row["n"], [(row[f"m{i}"] or 0.0, max(row[f"s{i}"] or 0.0, 1e-8)) for i in range(len(columns))]


def _drift(left: DataFrame, right: DataFrame, columns: Sequence[str], digits: int = 12) -> DataFrame:
    """Per feature (line), each side scaled by its own mean and sample deviation: ``compare_steps``.

    Equal originals may differ in the last bit after scaling: values are compared to 12 places.
    """
    (na, a), (nb, b) = _moments(left, columns), _moments(right, columns)
    if not na or not nb:
        return left.sparkSession.createDataFrame([(i, 0.0, 0.0, None) for i in range(len(columns) if na + nb else 0)], "line int, area double, square double, gap double")
    own = lambda i, m: tuple((float(j == i), *m[j]) for j in range(len(columns)))
    return compare_steps(union(left, right, columns), len(columns), [Line(own(i, a), own(i, b), digits) for i in range(len(columns))], na, nb)


def drift_w1(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wasserstein-1 per feature, each side standardised: the area between the two step functions.

    Equals the mean absolute difference of sorted samples when sizes match, and needs no
    subsampling when they do not.
    """
    return _drift(left, right, columns).select(_named(columns).alias("feature"), F.col("area").alias("w1"))


def drift_ks(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per feature."""
    return _drift(left, right, columns).select(_named(columns).alias("feature"), F.col("gap").alias("ks"))


def _named(columns: Sequence[str]) -> Column:
    return F.array(*[F.lit(c) for c in columns])[F.col("line")]


def directions(d: int, count: int, seed: int = 42) -> list[list[float]]:
    """Unit vectors to project on: one for a line, even angles in a plane, else random orthogonal sets."""
    if d == 1:
        return [[1.0]]
    if d == 2:
        angles = (np.arange(count) + 0.5) * np.pi / count
        return np.stack([np.cos(angles), np.sin(angles)], axis=1).tolist()
    rng = np.random.default_rng(seed)
    sets = [np.linalg.qr(rng.normal(size=(d, d)))[0].T for _ in range(-(-count // d))]
    return np.concatenate(sets)[:count].tolist()


def sphere_constant(d: int) -> float:
    """Mean of |u . e| over unit vectors u: what a projection keeps of a distance, on average."""
    return math.exp(math.lgamma(d / 2) - math.lgamma((d + 1) / 2)) / math.sqrt(math.pi)


def energy_distance(
    left: DataFrame, right: DataFrame, columns: Sequence[str], key: Sequence[str] = (), count: int = 32, seed: int = 42,
    cap: int | None = None,
) -> DataFrame:
    """2 E|X-Y| - E|X-X'| - E|Y-Y'| over all rows, scaled jointly: (n_left, n_right, energy, energy_sqrt, error).

    A distance is the mean of its projections on all directions, up to the constant of the
    dimension, and on a line the statistic is twice the squared area between the two step
    functions.  So each direction is solved exactly from running counts of the ordered union,
    and no pair of rows is formed.  ``error`` is the standard error over the random directions
    (0 for one column, where one direction says all; in a plane directions are evenly spaced).
    Null and non-finite values count as 0.  ``cap`` thins each side to that many rows by the hash
    of ``key``, where a user prefers that; nothing is capped otherwise.
    """
    if cap is not None:
        left, right = capped_rows(left, cap, key, seed), capped_rows(right, cap, key, seed)
    both = union(left, right, columns)
    _, scale = _moments(both, [f"x{i}" for i in range(len(columns))])
    counts = both.agg(F.sum(F.col("a").cast("long")).alias("na"), F.sum((~F.col("a")).cast("long")).alias("nb")).first()
    na, nb = counts["na"] or 0, counts["nb"] or 0
    n_left, n_right = F.lit(na).cast("long").alias("n_left"), F.lit(nb).cast("long").alias("n_right")
    if not na or not nb:  # an empty side has no distance; its counts still come back
        none = F.lit(None).cast("double")
        return left.sparkSession.range(1).select(n_left, n_right, none.alias("energy"), none.alias("energy_sqrt"), F.lit(0.0).alias("error"))
    ways = [tuple((w, *m) for w, m in zip(u, scale)) for u in directions(len(columns), count, seed)]
    per = compare_steps(both, len(columns), [Line(w, w) for w in ways], na, nb).select((2 * F.col("square") / F.lit(sphere_constant(len(columns)))).alias("e"))
    spread = F.coalesce(F.stddev_samp("e"), F.lit(0.0)) / math.sqrt(len(ways)) if len(columns) > 2 else F.lit(0.0)
    return per.agg(n_left, n_right, F.avg("e").alias("energy"), F.sqrt(F.avg("e")).alias("energy_sqrt"), spread.alias("error"))


def corpus_compare(
    pairs: dict[str, tuple[DataFrame, DataFrame]], columns: Sequence[str], count: int = 32, seed: int = 42
) -> DataFrame:
    """Spectrum, W1, KS and energy distance of each table pair of two corpora, over all rows."""
    out = None
    for name, (left, right) in pairs.items():
        drift = _drift(left, right, columns).agg(F.median("area").alias("w1_p50"), F.median("gap").alias("ks_p50"))
        en = energy_distance(left, right, columns, count=count, seed=seed).select("energy_sqrt")
        sp = effective_rank(left, columns).select(F.col("eigen_entropy").alias("left_entropy"), F.col("top5_ratio").alias("left_top5"))
        sr = effective_rank(right, columns).select(F.col("eigen_entropy").alias("right_entropy"), F.col("top5_ratio").alias("right_top5"))
        # one-row results side by side, without a task for each pair of their partitions
        part = drift.join(F.broadcast(en)).join(F.broadcast(sp)).join(F.broadcast(sr)).withColumn("pair", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def feature_label_mi(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each feature, in equal-frequency bins, with label > median."""
    (cut,) = exact_quantile_values(df, label, [0.5])
    items = F.array(*[F.struct(F.lit(f).alias("feature"), S.finite(col(f)).alias("x")) for f in features])
    long = df.select((col(label) > F.lit(cut)).cast("int").alias("y"), F.inline(items)).filter("x is not null")
    probs = {f"q{k}": k / bins for k in range(1, bins)}
    cuts = exact_quantiles(long, "x", probs, ["feature"]).select(
        F.col("feature").alias("__f"), F.array(*[F.col(q) for q in probs]).alias("cuts"))
    binned = long.join(F.broadcast(cuts), F.col("feature") == F.col("__f")).withColumn(
        "bin", F.size(F.filter("cuts", lambda c: F.col("x") > c)))
    cell = binned.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    # at most 2 * bins cells per feature
    total = F.sum("n").over(Window.partitionBy("feature"))
    by_bin = F.sum("n").over(Window.partitionBy("feature", "bin"))
    by_y = F.sum("n").over(Window.partitionBy("feature", "y"))
    part = (F.col("n") / total) * F.ln(F.col("n") * total / (by_bin * by_y))
    return cell.select("feature", part.alias("p")).groupBy("feature").agg(F.greatest(F.sum("p"), F.lit(0.0)).alias("mi"))


