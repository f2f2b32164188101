"""Group aggregates of feature synthesis that need more than one built-in call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from relweave.functions.scalar import col
from relweave.plans.ordering import numbered


def mode_by(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per group, ties to the lowest; nulls are not counted.

    Counts are combined per (group, value) first, so a hot group or an unbounded value
    domain never sits in one buffer.
    """
    counts = df.filter(col(value).isNotNull()).groupBy(*[col(c) for c in by], col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    best = counts.groupBy(*[col(c) for c in by]).agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("s"))
    return best.select(*[col(c) for c in by], F.col("s.value").alias("value"), (-F.col("s.m")).alias("n"))


def _chunks(df: DataFrame, by: Sequence[str], order: Sequence[str], chunk: int) -> DataFrame:
    """Number rows per group in order and cut them into chunks of bounded length."""
    return numbered(df, list(order), by, "__rn").withColumn("__part", F.floor((F.col("__rn") - 1) / chunk))


def _ordered(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], chunk: int, combine) -> DataFrame:
    rows = _chunks(df.filter(col(value).isNotNull()), by, order, chunk)
    keys = [col(c) for c in by]
    parts = rows.groupBy(*keys, "__part").agg(
        F.array_sort(F.collect_list(F.struct("__rn", col(value).alias("x")))).alias("xs")
    )
    return parts.select(*keys, "__part", combine(F.transform("xs", lambda s: s["x"])).alias("__p"))


def join_text(
    df: DataFrame, by: Sequence[str], text: str, order: Sequence[str], chunk: int = 4096, parts: bool = False
) -> DataFrame:
    """Newline join of a text column per group in a total order.

    Rows are joined in chunks of bounded length; ``parts`` returns the chunks (with their
    number) instead of one value per group, for groups too long for one cell.
    """
    cut = _ordered(df, by, text, order, chunk, lambda xs: F.array_join(xs, "\n"))
    if parts:
        return cut.withColumnsRenamed({"__part": "part", "__p": text})
    return cut.groupBy(*[col(c) for c in by]).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("__part", "__p"))), lambda s: s["__p"]), "\n"
        ).alias(text)
    )


def concat_tokens(
    df: DataFrame, by: Sequence[str], tokens: str, order: Sequence[str], chunk: int = 4096, parts: bool = False
) -> DataFrame:
    """Flattened token lists per group in a total order; null lists are skipped."""
    cut = _ordered(df, by, tokens, order, chunk, F.flatten)
    if parts:
        return cut.withColumnsRenamed({"__part": "part", "__p": tokens})
    return cut.groupBy(*[col(c) for c in by]).agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("__part", "__p"))), lambda s: s["__p"])
        ).alias(tokens)
    )


def vector_by(df: DataFrame, by: Sequence[str], vector: str, kind: str) -> DataFrame:
    """Element-wise max, min or mean over vectors per group.

    Null vectors count as zero vectors if the group has any vector, else the result is null.
    One partially aggregated pass over the vectors; nothing is exploded per dimension.
    """
    stat = {"arraymax": Summarizer.max, "arraymin": Summarizer.min, "arraymean": Summarizer.mean}[kind]
    keys = [col(c) for c in by]
    present = df.filter(col(vector).isNotNull()).select(*keys, array_to_vector(col(vector).cast("array<double>")).alias("__v"))
    some = present.groupBy(*keys).agg(vector_to_array(stat(F.col("__v"))).alias("__s"), F.count(F.lit(1)).alias("__n"))
    every = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"))
    right = some.select(*[col(c).alias(f"__k{i}") for i, c in enumerate(by)], "__s", "__n")
    cond = [col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)]
    share = F.col("__n") / F.col("__all")
    fill = {
        "arraymax": lambda x: F.when(share < 1, F.greatest(x, F.lit(0.0))).otherwise(x),
        "arraymin": lambda x: F.when(share < 1, F.least(x, F.lit(0.0))).otherwise(x),
        "arraymean": lambda x: x * share,
    }[kind]
    return every.join(right, cond, "left").select(*keys, F.transform("__s", fill).alias(vector))
