"""Exact quantiles of data-sized columns.

The built-in exact percentile keeps every distinct value of a group in one buffer, and the
approximate one merges all its summaries in one task.  Here values are counted in narrow cells,
only the cells that hold a wanted rank are looked into, and the values inside are ranked by
running counts over ordered buckets, so the work spreads over all tasks at every size.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from relweave.functions.scalar import col
from relweave.plans.ordering import prefix_sums, small_side
from relweave.session import materialize

# cells per doubling of the absolute value; a group has a million cells at most, mostly hundreds
CELLS_PER_OCTAVE = 256
# above the number of octaves between the smallest double and 1
_OCTAVES = 1100


def _cell(v: Column) -> Column:
    """Number of the cell of a double; never falls as the value grows."""
    size = F.least(F.log2(F.abs(v)), F.lit(float(_OCTAVES)))
    steps = F.floor((size + _OCTAVES) * CELLS_PER_OCTAVE) + 1
    return F.when(v > 0, steps).when(v < 0, -steps).otherwise(F.lit(0).cast("long"))


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), lower: bool = False
) -> DataFrame:
    """Linearly interpolated (or lower) quantiles, one output column per entry of ``probs``.

    Null and NaN values are left out; a group without other values is left out as well.
    """
    names = list(probs)
    keys = [col(c) for c in by]
    rows = df.select(*keys, col(value).cast("double").alias("__v")).filter("__v is not null and not isnan(__v)")
    cells = rows.groupBy(*keys, _cell(F.col("__v")).alias("__c")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    whole = Window.partitionBy(*keys)
    placed = cells.withColumn("__upto", F.sum("__n").over(whole.orderBy("__c"))).withColumn("__total", F.sum("__n").over(whole))

    def bracket(p: float) -> Column:
        """Least and largest value of the cells around the rank, and the rows before them."""
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        return F.struct(
            F.min(F.when(F.col("__upto") > F.floor(pos), F.col("__lo"))).alias("lo"),
            F.min(F.when(F.col("__upto") > F.ceil(pos), F.col("__hi"))).alias("hi"),
            F.coalesce(F.max(F.when(F.col("__upto") <= F.floor(pos), F.col("__upto"))), F.lit(0)).alias("before"),
            F.max(pos).alias("pos"))

    near = placed.groupBy(*keys).agg(F.array(*[bracket(p) for p in probs.values()]).alias("__e"))
    near = near.select(*[col(c).alias(f"__near{i}") for i, c in enumerate(by)], "__e")
    if by:
        joined = rows.join(small_side(near), [col(c).eqNullSafe(F.col(f"__near{i}")) for i, c in enumerate(by)])
    else:
        joined = rows.join(F.broadcast(near))  # one row of bounds
    hits = joined.select(*keys, "__v", F.posexplode("__e").alias("__i", "__b")).filter("__v between __b.lo and __b.hi")
    counts = materialize(hits.groupBy(*keys, "__i", "__v").agg(
        F.count(F.lit(1)).alias("__n"), F.max("__b.before").alias("__before"), F.max("__b.pos").alias("__pos")))
    ranked = prefix_sums(counts, "__v", {"__inside": "__n"}, [*by, "__i"])
    upto = F.col("__before") + F.col("__inside") + F.col("__n")

    def pick(rank: Column) -> Column:
        return F.min(F.when(upto > rank, F.col("__v")))

    lo = pick(F.floor("__pos"))
    hi = lo if lower else pick(F.ceil("__pos"))
    at = lo + (hi - lo) * F.max(F.col("__pos") - F.floor("__pos"))
    per = ranked.groupBy(*keys, "__i").agg(F.when(lo == hi, lo).otherwise(at).alias("__q"))
    return per.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == i, F.col("__q"))).alias(n) for i, n in enumerate(names)])


def exact_quantile_values(df: DataFrame, value: str, probs: Sequence[float]) -> list[float | None]:
    """The quantiles of one column as driver scalars (a fit)."""
    row = exact_quantiles(df, value, {f"q{i}": p for i, p in enumerate(probs)}).first()
    return [row[f"q{i}"] for i in range(len(probs))] if row else [None] * len(probs)


def column_quantiles(df: DataFrame, columns: dict[str, Column], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of several columns in one job: the columns are unpivoted and grouped by name."""
    items = F.array(*[F.struct(F.lit(n).alias("column"), c.cast("double").alias("x")) for n, c in columns.items()])
    got = exact_quantiles(df.select(F.inline(items)), "x", {f"q{i}": p for i, p in enumerate(probs)}, ["column"]).collect()
    found = {r["column"]: [r[f"q{i}"] for i in range(len(probs))] for r in got}
    return {n: found.get(n, [None] * len(probs)) for n in columns}


def reference_grid(df: DataFrame, value: str, points: int) -> list[float]:
    """Evenly spaced quantiles of a column as driver scalars, exact at every size.

    Distinct values are counted and ranked by running counts; those near a grid position
    (a few per point) reach the driver.
    """
    x = df.select(col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    counts = materialize(x.groupBy("x").agg(F.count(F.lit(1)).alias("n")))
    (n,) = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()
    if n == 0:
        return []
    points = max(2, min(points, n))
    pos = [k * (n - 1) / (points - 1) for k in range(points)]
    ranks = sorted({r for p in pos for r in (math.floor(p), math.ceil(p))})
    step = (points - 1) / max(n - 1, 1)
    # values whose ranks come within one of a grid position
    near = F.floor((F.col("before") + F.col("n")) * step + 1e-9) >= F.ceil((F.col("before") - 1) * step - 1e-9)
    found = prefix_sums(counts, "x", {"before": "n"}).filter(near).orderBy("before").collect()
    starts = [r["before"] for r in found]
    at = {r: found[bisect.bisect_right(starts, r) - 1]["x"] for r in ranks}
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in pos]
