"""Evaluation metrics.  Predictions are reduced to counts per class pair or per distinct score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from relweave.functions import scalar as S
from relweave.functions.scalar import col
from relweave.plans.ordering import numbered, prefix_sums


def _by(by: Sequence[str]) -> list[Column]:
    return [col(c) for c in by]


# ---------------------------------------------------------------- class predictions


def classification_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, balanced_acc, recall_w and f1_w from one count per (label, prediction)."""
    keys = list(by)
    cells = df.groupBy(*_by(by), col(y).alias("__y"), col(pred).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    hit = F.sum(F.when(F.col("__y") == F.col("__p"), F.col("__n")).otherwise(0))
    actual = cells.groupBy(*_by(by), F.col("__y").alias("__c")).agg(F.sum("__n").alias("__support"), hit.alias("__tp"))
    guessed = cells.groupBy(*_by(by), F.col("__p").alias("__c")).agg(F.sum("__n").alias("__guessed"))
    cls = actual.join(guessed, [*keys, "__c"], "left")
    s, tp, g = F.col("__support"), F.col("__tp"), F.coalesce("__guessed", F.lit(0))
    f1 = 2 * tp / (s + g)
    return cls.groupBy(*_by(by)).agg(
        F.sum("__support").alias("n"),
        (F.sum(tp) / F.sum(s)).alias("accuracy"),
        F.avg(tp / s).alias("balanced_acc"),
        (F.sum(s * (tp / s)) / F.sum(s)).alias("recall_w"),
        (F.sum(s * f1) / F.sum(s)).alias("f1_w"),
    )


# ---------------------------------------------------------------- ranked scores


def score_counts(df: DataFrame, y: Column, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score; ``y`` is a boolean column."""
    return df.filter(col(score).isNotNull()).groupBy(*_by(by), col(score).cast("double").alias("__s")).agg(
        F.sum(y.cast("long")).alias("__pos"), F.sum((~y).cast("long")).alias("__neg"))


def auroc(df: DataFrame, y: Column, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Binary AUC with tied scores averaged; null when a class is absent."""
    ranked = prefix_sums(score_counts(df, y, score, by), "__s", {"__below": "__neg"}, by, {"__p": "__pos", "__q": "__neg"})
    wins = F.sum(F.col("__pos") * (F.col("__below") + F.col("__neg") / 2.0))
    pairs = F.max(F.col("__p").cast("double") * F.col("__q"))
    return ranked.groupBy(*_by(by)).agg(F.when(pairs > 0, wins / pairs).alias("auroc"))


def average_precision(df: DataFrame, y: Column, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum over distinct scores, highest first, of precision times the recall step."""
    counts = score_counts(df, y, score, by).withColumn("__d", -F.col("__s"))
    ranked = prefix_sums(counts, "__d", {"__bp": "__pos", "__bn": "__neg"}, by, {"__p": "__pos"})
    upto = F.col("__bp") + F.col("__pos")
    precision = F.try_divide(upto, upto + F.col("__bn") + F.col("__neg"))
    step = F.try_divide(F.col("__pos"), F.col("__p"))
    return ranked.groupBy(*_by(by)).agg(F.when(F.max("__p") > 0, F.sum(precision * step)).alias("ap"))


def one_vs_rest(df: DataFrame, y: str, probabilities: dict, metric, by: Sequence[str] = ()) -> DataFrame:
    """Macro mean over classes of a ranked metric; ``probabilities`` maps class to its column."""
    kind = df.schema[y].dataType
    items = F.array(*[F.struct(F.lit(c).cast(kind).alias("__cls"), col(p).cast("double").alias("__pr"))
                      for c, p in probabilities.items()])
    long = df.select(*_by(by), col(y).alias("__y"), F.inline(items))
    per = metric(long, F.col("__y") == F.col("__cls"), "__pr", [*by, "__cls"])
    name = per.columns[-1]
    return per.groupBy(*_by(by)).agg(F.avg(name).alias(name))


def logloss(df: DataFrame, y: str, probabilities: dict, by: Sequence[str] = (), eps: float = 1e-15) -> DataFrame:
    """Mean negative log probability of the true class."""
    p = F.lit(None).cast("double")
    for c, name in probabilities.items():
        p = F.when(col(y) == F.lit(c), col(name)).otherwise(p)
    clipped = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return df.groupBy(*_by(by)).agg(F.avg(-F.ln(clipped)).alias("logloss"))


def hinge(df: DataFrame, y: str, scores: dict, by: Sequence[str] = ()) -> DataFrame:
    """Mean of max(0, 1 - (score of the true class - best other score))."""
    own, other = F.lit(None).cast("double"), []
    for c, name in scores.items():
        own = F.when(col(y) == F.lit(c), col(name)).otherwise(own)
        other.append(F.when(col(y) != F.lit(c), col(name)))
    margin = own - (F.greatest(*other) if len(other) > 1 else other[0])
    return df.groupBy(*_by(by)).agg(F.avg(F.greatest(F.lit(0.0), 1 - margin)).alias("hinge"))


# ---------------------------------------------------------------- regression


def regression_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """mae, mse, msle, rmse, pearson and r2 in one pass; errors are not negated.

    msle is null if a value is at or below -1, pearson and r2 are null for a constant side.
    """
    t, p = col(y).cast("double"), col(pred).cast("double")
    err = p - t
    log_err = F.log1p(p) - F.log1p(t)
    msle = F.when(F.min(F.least(p, t)) > -1, F.avg(log_err * log_err))
    return df.groupBy(*_by(by)).agg(
        F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), msle.alias("msle"),
        F.sqrt(F.avg(err * err)).alias("rmse"), S.corr(t, p).alias("pearson"),
        (1 - F.try_divide(F.sum(err * err), F.var_pop(t) * F.count(t))).alias("r2"))


# ---------------------------------------------------------------- retrieval


def candidate_ranks(df: DataFrame, query: str, score: str, candidate: str, out: str = "rank") -> DataFrame:
    """1-based rank by descending score within a query, ties to the lower candidate id."""
    ranked = numbered(df.withColumn("__d", -col(score).cast("double")), ["__d", candidate], [query], out)
    return ranked.drop("__d")


def retrieval_metrics(ranked: DataFrame, query: str, relevant: Column, k: int | None = None, rank: str = "rank") -> DataFrame:
    """hr, mrr and ndcg per query, then averaged; queries without a relevant candidate score 0.

    The ideal gain of a query needs only its number of relevant candidates: one running sum of
    the discount, up to the largest such number, serves all queries.
    """
    r = col(rank)
    seen = relevant & (r <= k) if k else relevant
    gain = 1.0 / F.log2(r + 1)
    per = ranked.groupBy(col(query)).agg(
        F.max(seen.cast("int")).alias("hr"),
        F.coalesce(1.0 / F.min(F.when(relevant, r)), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(seen, gain).otherwise(0.0)).alias("dcg"),
        F.sum(relevant.cast("long")).alias("n_rel"))
    top = F.least(F.col("n_rel"), F.lit(k)) if k else F.col("n_rel")
    (most,) = per.agg(F.max(top)).first()
    places = ranked.sparkSession.range(1, (most or 0) + 1).withColumnRenamed("id", "m").withColumn("own", 1.0 / F.log2(F.col("m") + 1))
    ideal = prefix_sums(places, "m", {"before": "own"}).select("m", (F.col("before") + F.col("own")).alias("idcg"))
    joined = per.withColumn("m", top).join(ideal, "m", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg(F.col("hr").cast("double")).alias("hr"), F.avg("mrr").alias("mrr"),
        F.avg(F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0))).alias("ndcg"))
