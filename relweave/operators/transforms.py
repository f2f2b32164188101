"""Fit/transform column operators.

A fit is one aggregation job that ends in a few driver scalars or a code table; applying it is
a projection or a join.  Category codes follow sorted value order, so they do not depend on
row order or partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from relweave.functions import scalar as S
from relweave.functions.scalar import col
from relweave.model import CATEGORY, DATETIME, FLOAT, TEXT, TIMESTAMP, ColumnMeta, RelationalDataset, TableMeta
from relweave.operators.joins import ensure_parents
from relweave.plans.ordering import numbered, numbered_by_hash
from relweave.plans.quantiles import column_quantiles, exact_quantile_values, exact_quantiles, reference_grid
from relweave.session import discard, materialize, shuffles_freed

# ---------------------------------------------------------------- codes


def key_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes 0..n-1 of the distinct non-null values in sorted order."""
    values = df.select(col(column).alias("value")).filter("value is not null").distinct()
    return numbered(values, ["value"], out="code").select("value", (F.col("code") - 1).alias("code"))


def frequency_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code, n): codes by descending count, ties by value."""
    counts = df.filter(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    ranked = numbered(counts.withColumn("__neg", -F.col("n")), ["__neg", "value"], out="code")
    return ranked.select("value", (F.col("code") - 1).alias("code"), "n")


def apply_codes(df: DataFrame, column: str, codes: DataFrame, out: str, unknown: int | None) -> DataFrame:
    """Replace values by their code; null and unseen values get ``unknown``."""
    right = codes.select(F.col("value").alias("__v"), F.col("code").alias("__code"))
    value = F.col("__code") if unknown is None else F.coalesce("__code", F.lit(unknown).cast("long"))
    joined = df.join(right, col(column) == F.col("__v"), "left")
    return joined.withColumn(out, value).drop("__v", "__code")


def union_columns(parts: Sequence[tuple[DataFrame, str]], as_name: str = "x") -> DataFrame:
    """Single columns of several tables stacked for one shared fit."""
    return reduce(DataFrame.unionByName, [df.select(col(c).alias(as_name)) for df, c in parts])


# ---------------------------------------------------------------- column transforms


class ColumnTransform:
    """Fit on one stacked column ``x``; apply to a column of any table of the group."""

    input_dtype: str = FLOAT

    def fit(self, x: DataFrame) -> "Fitted":
        raise NotImplementedError


@dataclass
class Fitted:
    """Expressions per output column: name formatter, logical dtype, Column builder."""

    outputs: list[tuple[str, str, object]]

    def apply(self, df: DataFrame, column: str) -> tuple[DataFrame, list[ColumnMeta]]:
        new = [(fmt.format(name=column), dtype, build(col(column))) for fmt, dtype, build in self.outputs]
        keep = [c for c in df.columns if c != column]
        out = df.select(*[col(c) for c in keep], *[e.alias(n) for n, _, e in new])
        return out, [ColumnMeta(n, d) for n, d, _ in new]


class CanonicalizeNumeric(ColumnTransform):
    input_dtype = FLOAT

    def fit(self, x):
        return Fitted([("{name}", FLOAT, lambda c: c.cast("float"))])


class CanonicalizeDatetime(ColumnTransform):
    input_dtype = DATETIME

    def fit(self, x):
        return Fitted([("{name}", DATETIME, lambda c: c.cast("timestamp_ntz"))])


DATE_METHODS = {
    "YEAR": (CATEGORY, F.year),
    "MONTH": (CATEGORY, F.month),
    "DAY": (CATEGORY, F.dayofmonth),
    "DAYOFWEEK": (CATEGORY, F.weekday),
    "TIMESTAMP": (FLOAT, S.epoch_nanos),
}


class FeaturizeDatetime(ColumnTransform):
    input_dtype = DATETIME

    def __init__(self, methods: Sequence[str] = tuple(DATE_METHODS), retain: bool = False):
        self.methods, self.retain = tuple(methods), retain

    def fit(self, x):
        outs = [(f"{m}_{{name}}", DATE_METHODS[m][0], DATE_METHODS[m][1]) for m in self.methods]
        if self.retain:
            outs.append(("{name}", DATETIME, lambda c: c))
        return Fitted(outs)


@dataclass
class FittedCodes:
    codes: DataFrame
    unknown: int

    def apply(self, df, column):
        out = apply_codes(df, column, self.codes, column, self.unknown)
        return out, [ColumnMeta(column, CATEGORY, in_size=1)]


class RemapCategory(ColumnTransform):
    """Value to code; null and unseen share code ``n``, so there are ``n + 1`` categories."""

    input_dtype = CATEGORY

    def fit(self, x):
        codes = key_codes(x, "x")
        return FittedCodes(codes, codes.count())


class NormNumeric(ColumnTransform):
    """Median impute, then quantile-to-normal for skewed columns, else standard scaling."""

    input_dtype = FLOAT

    def __init__(self, skew_threshold: float = 0.99):
        self.skew_threshold = skew_threshold

    def fit(self, x):
        x = x.select(S.finite(F.col("x")).alias("x"))
        fit = fit_norm_numeric(x, "x", self.skew_threshold)
        return Fitted([("{name}", FLOAT, lambda c: fit.expression(c).cast("float"))])


@dataclass
class NormFit:
    median: float
    mean: float
    std: float
    skew: float
    quantile: "QuantileFit | None"

    def expression(self, c: Column) -> Column:
        filled = F.coalesce(S.finite(c), F.lit(self.median))
        if self.quantile is not None:
            return self.quantile.normal(filled)
        return (filled - F.lit(self.mean)) / F.lit(self.std or 1.0)


def fit_norm_numeric(df: DataFrame, column: str, skew_threshold: float = 0.99) -> NormFit:
    x = df.select(col(column).cast("double").alias("x"))
    n, skew = x.agg(F.count("x"), F.skewness("x")).first()
    (median,) = exact_quantile_values(x, "x", [0.5])
    # bias-corrected skew; undefined below three values
    adjusted = math.sqrt(n * (n - 1)) / (n - 2) * skew if n > 2 and skew is not None and not math.isnan(skew) else 0.0
    median = 0.0 if median is None else median
    filled = x.select(F.coalesce("x", F.lit(median)).alias("x"))
    if abs(adjusted) > skew_threshold:
        return NormFit(median, 0.0, 1.0, adjusted, fit_quantiles(filled, "x", 1000))
    mean, std = filled.agg(F.avg("x"), F.stddev_pop("x")).first()
    return NormFit(median, mean, std, adjusted, None)


# ---------------------------------------------------------------- quantile transform


@dataclass
class QuantileFit:
    """Reference quantiles; at most a thousand doubles."""

    q: list[float]

    def uniform(self, c: Column) -> Column:
        """Position in [0, 1]: mean of the lowest and highest position among equal quantiles."""
        return self._scores(c, normal=False)

    def normal(self, c: Column) -> Column:
        """Normal scores, kept inside the quantiles of 1e-7 and 1 - 1e-7."""
        return self._scores(c, normal=True)

    def _scores(self, c: Column, normal: bool) -> Column:
        grid = np.asarray(self.q, dtype=float)
        ref = np.linspace(0.0, 1.0, len(grid))

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            v = x.to_numpy(dtype=float)
            up = np.interp(v, grid, ref)
            down = -np.interp(-v, -grid[::-1], -ref[::-1])
            out = 0.5 * (up + down)
            out[v <= grid[0]] = 0.0
            out[v >= grid[-1]] = 1.0
            out[np.isnan(v)] = np.nan
            return pd.Series(S.normal_quantile(np.clip(out, 1e-7, 1.0 - 1e-7)) if normal else out)

        return score(c.cast("double"))


def fit_quantiles(df: DataFrame, column: str, points: int) -> QuantileFit:
    """Evenly spaced quantiles of a column, at most ``points`` and at most one per row."""
    return QuantileFit(reference_grid(df, column, points))


def quantile_normal(
    df: DataFrame, column: str, out: str, n_quantiles: int = 1000, noise: float = 0.0, seed: int = 0,
    key: Sequence[str] = (), distribution: str = "normal",
) -> DataFrame:
    """Quantile transform with ``max(min(n // 30, n_quantiles), 10)`` points; noise only at the fit."""
    x = df.select(col(column).cast("double").alias("x"), *[col(k).alias(f"__key{i}") for i, k in enumerate(key)])
    n, std = x.agg(F.count("x"), F.stddev_pop("x")).first()
    if noise > 0:
        keys = [f"__key{i}" for i in range(len(key))]
        u = S.stable_uniform(seed, *keys)
        v = S.stable_uniform(f"{seed}b", *keys)
        gauss = F.sqrt(-2 * F.ln(F.greatest(u, F.lit(1e-15)))) * F.cos(v * (2 * math.pi))
        x = x.withColumn("x", F.col("x") + gauss * (noise / max(std or 0.0, noise)))
    fit = fit_quantiles(x, "x", max(min(n // 30, n_quantiles), 10))
    expr = fit.normal(col(column)) if distribution == "normal" else fit.uniform(col(column))
    return df.withColumn(out, expr)


# ---------------------------------------------------------------- scaling and clipping


def standard_clip(
    df: DataFrame, columns: Sequence[str], limit: float = 100.0, eps: float = 1e-6, sample: bool = False,
    floor: bool = False,
) -> DataFrame:
    """(x - mean) / (std + eps) clipped to +-limit; variants use the sample std floored at eps."""
    std = F.stddev_samp if sample else F.stddev_pop
    row = df.agg(*[f(col(c).cast("double")).alias(f"{k}_{i}") for i, c in enumerate(columns)
                   for k, f in (("m", F.avg), ("s", std))]).first()
    out = {}
    for i, c in enumerate(columns):
        s = row[f"s_{i}"] or 0.0
        scale = max(s, eps) if floor else s + eps
        z = (col(c).cast("double") - F.lit(row[f"m_{i}"])) / F.lit(scale)
        out[c] = F.greatest(F.lit(-limit), F.least(F.lit(limit), z))
    return df.withColumns(out)


def outlier_bounds(df: DataFrame, columns: Sequence[str], threshold: float = 4.0) -> dict[str, tuple[float, float]]:
    """Two passes of mean +- t * std, the second without first-pass outliers."""
    def stats(frame, exprs):
        return frame.agg(*[f(e).alias(f"{k}_{i}") for i, e in enumerate(exprs)
                           for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()

    xs = [S.finite(col(c)) for c in columns]
    first = stats(df, xs)
    inside = []
    for i, x in enumerate(xs):
        m, s = first[f"m_{i}"] or 0.0, max(first[f"s_{i}"] or 0.0, 1e-6)
        inside.append(F.when((x >= m - threshold * s) & (x <= m + threshold * s), x))
    second = stats(df, inside)
    bounds = {}
    for i, c in enumerate(columns):
        m, s = second[f"m_{i}"] or 0.0, max(second[f"s_{i}"] or 0.0, 1e-6)
        bounds[c] = (m - threshold * s, m + threshold * s)
    return bounds


def clip_outliers(df: DataFrame, bounds: dict[str, tuple[float, float]], soft: bool = True) -> DataFrame:
    """Soft log clip outside the bounds, or a hard clamp to them."""
    out = {}
    for c, (low, high) in bounds.items():
        x = col(c).cast("double")
        if soft:
            up = F.greatest(F.lit(low) - F.log1p(F.abs(x)), x)
            y = F.least(F.lit(high) + F.log1p(F.abs(up)), up)
        else:
            y = F.least(F.lit(high), F.greatest(F.lit(low), x))
        out[c] = F.when(x.isNull(), x).otherwise(y)
    return df.withColumns(out)


NORMAL_IQR = 1.3489795003921634  # distance of the normal quartiles (fixed value)


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / IQR, scaled to unit variance for normal data."""
    out = {}
    for c, (q1, q2, q3) in column_quantiles(df, {c: col(c) for c in columns}, [0.25, 0.5, 0.75]).items():
        scale = (q3 - q1) / NORMAL_IQR or 1.0
        out[c] = (col(c).cast("double") - F.lit(q2)) / F.lit(scale)
    return df.withColumns(out)


# ---------------------------------------------------------------- power transform


def yeo_johnson(c: Column, lam: float | Column) -> Column:
    """Yeo-Johnson with a given lambda."""
    k = lam if isinstance(lam, Column) else F.lit(float(lam))
    pos = F.when(F.abs(k) < 1e-12, F.log1p(c)).otherwise((F.pow(c + 1, k) - 1) / k)
    neg = F.when(F.abs(k - 2) < 1e-12, -F.log1p(-c)).otherwise(-(F.pow(1 - c, 2 - k) - 1) / (2 - k))
    return F.when(c >= 0, pos).otherwise(neg)


def _box(u: Column, power: float) -> list[Column]:
    """(e^(power u) - 1) / power and its first two derivatives by the power."""
    if abs(power) < 1e-3:  # the quotient loses its digits near 0, its series does not
        def series(skip: int) -> Column:
            total, fact = F.lit(0.0), 1.0
            for k in range(12):
                fact *= k + 1
                if k >= skip:
                    fall = math.prod(range(k - skip + 1, k + 1))
                    total = total + F.lit(fall * power ** (k - skip) / fact) * F.pow(u, F.lit(float(k + 1)))
            return total

        return [series(0), series(1), series(2)]
    e = F.exp(F.lit(power) * u)
    zero = (e - 1) / F.lit(power)
    one = (u * e - zero) / F.lit(power)
    return [zero, one, (u * u * e - 2 * one) / F.lit(power)]


def _yeo_johnson_parts(x: Column, lam: float) -> list[Column]:
    """The transform of ``x`` and its first two derivatives by lambda."""
    up, down = _box(F.log1p(F.abs(x)), lam), _box(F.log1p(F.abs(x)), 2.0 - lam)
    # below zero the transform is minus the same form in 2 - lambda
    return [F.when(x >= 0, p).otherwise(sign * q) for p, q, sign in zip(up, down, (-1, 1, -1))]


def fit_yeo_johnson(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-10, passes: int = 60) -> dict[str, float | None]:
    """Maximum-likelihood lambda per column, by Newton's method on the likelihood's derivatives.

    A pass is one aggregation without a shuffle of rows: the variance of the transform, and the
    variance and covariances of its derivatives, of every column that still moves.  Steps that
    leave the bracket of known signs are halved back into it.  None (column unchanged) when
    the likelihood is never finite, such as for a constant column.
    """
    best: dict[str, float | None] = {c: None for c in columns}
    at = dict.fromkeys(columns, 1.0)
    low: dict[str, float] = {}
    high: dict[str, float] = {}
    for _ in range(passes):
        if not at:
            break
        aggs = []
        for i, (c, lam) in enumerate(at.items()):
            x = S.finite(col(c))
            y, y1, y2 = _yeo_johnson_parts(x, lam)
            aggs += [F.count(x).alias(f"n{i}"), F.var_pop(y).alias(f"v{i}"), F.covar_pop(y, y1).alias(f"c{i}"), F.var_pop(y1).alias(f"w{i}"),
                     F.covar_pop(y, y2).alias(f"d{i}"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"j{i}"),
                     (F.min(x) == F.max(x)).alias(f"s{i}")]
        row = df.agg(*aggs).first()
        for i, (c, lam) in enumerate(list(at.items())):
            n, v, cov, w, d, j = (row[f"{k}{i}"] for k in "nvcwdj")
            if not n or row[f"s{i}"]:
                del at[c]  # no value, or a constant one
                continue
            known = all(t is not None and math.isfinite(t) for t in (v, cov, w, d, j)) and v > 1e-300
            if known:
                slope = j - n * cov / v
                bend = -n * ((w + d) / v - 2 * (cov / v) ** 2)
                (low if slope > 0 else high)[c] = lam
                step = -slope / bend if bend < 0 else math.copysign(1.0, slope)
                step = max(-2.0, min(2.0, step))
                best[c] = lam
            else:  # the transform leaves the range of doubles: step back towards 1
                (high if lam > 1.0 else low)[c] = lam
                step = 1.0 - lam
            new = lam + step
            if c in low and c in high and not low[c] < new < high[c]:
                new = (low[c] + high[c]) / 2
            if known and abs(new - lam) <= tolerance * max(1.0, abs(lam)):
                best[c] = new
                del at[c]
            else:
                at[c] = new
    return best


@dataclass
class PowerFit:
    lambdas: dict[str, float | None]
    means: dict[str, float]
    stds: dict[str, float]
    marked: set[str]

    def apply(self, df: DataFrame, revert: bool = True) -> DataFrame:
        """Transformed columns; marked columns come back unchanged when ``revert`` is set."""
        out = {}
        for c, lam in self.lambdas.items():
            x = col(c).cast("double")
            if lam is None or (revert and c in self.marked):
                out[c] = x
            else:
                out[c] = (yeo_johnson(x, lam) - F.lit(self.means[c])) / F.lit(self.stds[c])
        return df.withColumns(out)


def fit_power(df: DataFrame, columns: Sequence[str], standardize: bool = True, tolerance: float = 1e-3,
              max_value: float = 100.0) -> PowerFit:
    """Fit lambdas; mark columns whose result has variance off 1 or any value above the limit."""
    lambdas = fit_yeo_johnson(df, columns)
    ys = {c: (yeo_johnson(S.finite(col(c)), lam) if lam is not None else S.finite(col(c))) for c, lam in lambdas.items()}
    row = df.agg(*[f(y).alias(f"{k}_{i}") for i, y in enumerate(ys.values())
                   for k, f in (("m", F.avg), ("s", F.stddev_pop), ("x", F.max))]).first()
    means, stds, marked = {}, {}, set()
    for i, c in enumerate(columns):
        m, s, top = row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 0.0, row[f"x_{i}"]
        plain = not standardize or lambdas[c] is None
        means[c], stds[c] = (0.0, 1.0) if plain else (m, s or 1.0)
        variance = s * s if plain else (1.0 if s else 0.0)
        high = None if top is None else (top - means[c]) / stds[c]
        if abs(variance - 1.0) > tolerance or (high is not None and high > max_value):
            marked.add(c)
    return PowerFit(lambdas, means, stds, marked)


def flat_pipeline(df: DataFrame, columns: Sequence[str], method: str = "power", threshold: float = 4.0) -> DataFrame:
    """Standard scale with clip, normalise, then clip outliers.

    Every fit scans its input, so both stage results are written to the shared folder.
    """
    x = materialize(standard_clip(df, columns))
    if method == "power":
        x = fit_power(x, columns).apply(x, revert=False)
    elif method == "quantile":
        for c in columns:
            x = x.withColumn(c, fit_quantiles(x, c, 1000).normal(col(c)))
    elif method == "quantile_rtdl":
        for c in columns:
            x = quantile_normal(x, c, c, noise=1e-3, key=columns)
        x = standard_clip(x, columns, limit=float("inf"), eps=0.0)
    elif method == "robust":
        x = robust_scale(x, columns)
    elif method != "none":
        raise ValueError(f"no such way to normalise: {method!r}")
    x = materialize(x)
    return clip_outliers(x, outlier_bounds(x, columns, threshold))


def shifted_log(df: DataFrame, column: str, out: str) -> DataFrame:
    """Mean fill, shift by |min|, add 1e-10, natural log."""
    mean, low = df.agg(F.avg(S.finite(col(column))), F.min(S.finite(col(column)))).first()
    low = min(low, mean) if low is not None else 0.0
    filled = F.coalesce(S.finite(col(column)), F.lit(mean if mean is not None else 0.0))
    return df.withColumn(out, F.ln(filled + F.lit(abs(low) + 1e-10)))


def rebalance(
    df: DataFrame, tags: dict[str, str], categorical: Sequence[str] = (), keep_originals: bool = False,
    include_categorical: bool = False, svd: bool = False,
) -> DataFrame:
    """Per-column redistribution by tag, optionally beside the originals and with SVD components.

    Tags: logNormal, quantile_uniform_10, quantile_uniform_5, quantile_norm_10, quantile_norm_5,
    power, robust, none.  Results are named ``<column>_<tag>``.
    """
    rows = df.count()
    chosen = {c: g for c, g in tags.items() if include_categorical or c not in categorical}
    out, made = df, []
    for c, tag in chosen.items():
        name = f"{c}_{tag}"
        made.append(name)
        if tag == "logNormal":
            out = shifted_log(out, c, name)
        elif tag.startswith("quantile_"):
            _, kind, div = tag.split("_")
            fit = fit_quantiles(df, c, min(1000, max(rows // int(div), 2)))
            out = out.withColumn(name, fit.uniform(col(c)) if kind == "uniform" else fit.normal(col(c)))
        elif tag == "power":
            power = fit_power(df, [c], standardize=False)
            x, lam = col(c).cast("double"), power.lambdas[c]
            out = out.withColumn(name, x if lam is None else yeo_johnson(x, lam))
            mean, std = out.agg(F.avg(S.finite(col(name))), F.stddev_pop(S.finite(col(name)))).first()
            out = out.withColumn(name, (F.coalesce(S.finite(col(name)), F.lit(mean)) - F.lit(mean)) / F.lit(std or 1.0))
        elif tag == "robust":
            out = robust_scale(out.withColumn(name, col(c)), [name])
        elif tag == "none":
            out = out.withColumn(name, col(c).cast("double"))
        else:
            raise ValueError(f"unknown redistribution tag {tag!r}")
    originals = list(df.columns)
    drop = [] if keep_originals else [c for c in chosen]
    if svd and len(tags) >= 2:
        out = svd_components(out, made, max(1, min(rows // 10 + 1, len(made) // 2)))
    return out.drop(*[c for c in originals if c in drop])


def svd_components(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """Append ``k`` right-singular projections of the scaled (not centred) columns.

    The p x p Gram matrix is summed in one pass; only it reaches the driver.
    """
    stats = df.agg(*[f(S.finite(col(c))).alias(f"{n}_{i}") for i, c in enumerate(columns)
                     for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    xs = [
        F.coalesce(S.finite(col(c)), F.lit(stats[f"m_{i}"] or 0.0)) / F.lit(stats[f"s_{i}"] or 1.0)
        for i, c in enumerate(columns)
    ]
    p = len(xs)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = df.agg(*[F.sum(xs[i] * xs[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((p, p))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"]
    values, vectors = np.linalg.eigh(gram)
    top = vectors[:, np.argsort(values)[::-1][:k]]
    top = top * np.where(top[np.abs(top).argmax(axis=0), range(top.shape[1])] < 0, -1.0, 1.0)
    return df.withColumns({
        f"svd_{j}": reduce(lambda a, b: a + b, [x * F.lit(float(w)) for x, w in zip(xs, top[:, j])])
        for j in range(top.shape[1])
    })


# ---------------------------------------------------------------- bins


def bin_by_thresholds(c: Column, thresholds: Sequence[float]) -> Column:
    """Number of thresholds strictly below the value."""
    return reduce(lambda a, b: a + b, [(c > F.lit(float(t))).cast("int") for t in thresholds], F.lit(0))


def bin_quantile(df: DataFrame, column: str, n_classes: int, out: str, clamp: float = 10_000.0) -> DataFrame:
    """Right-closed quantile bins; non-finite values take the median, values are clamped."""
    (median,) = exact_quantile_values(df.select(S.finite(col(column)).alias("x")), "x", [0.5])
    x = F.greatest(F.lit(-clamp), F.least(F.lit(clamp), F.coalesce(S.finite(col(column)), F.lit(median or 0.0))))
    cuts = exact_quantile_values(df.select(x.alias("x")), "x", [k / n_classes for k in range(1, n_classes)])
    return df.withColumn(out, bin_by_thresholds(x, cuts))


def uniform_thresholds(df: DataFrame, column: str, n_classes: int, seed: int) -> list[float]:
    """Cut points drawn uniformly between the smallest and largest value."""
    low, high = df.agg(F.min(col(column)), F.max(col(column))).first()
    us = df.sparkSession.range(n_classes - 1).select(S.stable_uniform(seed, "id").alias("u")).collect()
    return sorted(float(low) + (float(high) - float(low)) * r["u"] for r in us)


def row_thresholds(df: DataFrame, column: str, key: str, n_classes: int, seed: int) -> list[float]:
    """Cut points taken from the data: the values of the rows with the lowest key hash."""
    rows = df.filter(col(column).isNotNull()).select(col(column).cast("double").alias("x"),
                                                   S.stable_hash(seed, key).alias("h"), col(key).alias("k"))
    return sorted(r["x"] for r in rows.orderBy("h", "k").limit(n_classes - 1).collect())


def normal_thresholds(spark, n_classes: int, seed: int) -> list[float]:
    """Standard normal cut points for standardised data."""
    ids = spark.range(n_classes - 1)
    rows = ids.select(S.normal_cdf_inverse(S.stable_uniform(seed, "id")).alias("z")).collect()
    return sorted(r["z"] for r in rows)


def bin_balanced(df: DataFrame, column: str, out: str) -> DataFrame:
    """1 above the lower median, else 0."""
    row = exact_quantiles(df, column, {"m": 0.5}, lower=True).first()
    return df.withColumn(out, (col(column) > F.lit(row["m"])).cast("int"))


def permute_classes(df: DataFrame, column: str, out: str, seed: int) -> DataFrame:
    """Random relabelling of class codes: codes in hash order of the class value."""
    classes = df.select(col(column).alias("value")).filter("value is not null").distinct()
    hashed = classes.withColumn("h", S.stable_hash(seed, "value"))
    codes = numbered_by_hash(hashed, "h", ["value"], out="code").select("value", (F.col("code") - 1).alias("code"))
    return apply_codes(df, column, codes, out, None)


# ---------------------------------------------------------------- flat encoders


def fill_numeric(df: DataFrame, columns: Sequence[str], fill: str = "median", train: Column | None = None) -> DataFrame:
    """Fill nulls by the train median or mean (0 when all null)."""
    fit = df.filter(train) if train is not None else df
    values = {}
    if fill == "mean":
        row = fit.agg(*[F.avg(S.finite(col(c))).alias(f"a{i}") for i, c in enumerate(columns)]).first()
        values = {c: row[f"a{i}"] for i, c in enumerate(columns)}
    elif fill == "median":
        values = {c: q[0] for c, q in column_quantiles(fit, {c: S.finite(col(c)) for c in columns}, [0.5]).items()}
    elif fill != "zero":
        raise ValueError(f"unknown fill {fill!r}")
    return df.withColumns({
        c: F.coalesce(S.finite(col(c)), F.lit(values.get(c) if values.get(c) is not None else 0.0)) for c in columns
    })


def encode_ordinal(
    df: DataFrame, columns: Sequence[str], unknown: int | None = -1, train: Column | None = None,
    unseen_is_n: bool = False,
) -> DataFrame:
    """Sorted-value codes from the train rows; unseen and null give ``unknown`` (or n)."""
    fit = df.filter(train) if train is not None else df
    out = df
    for c in columns:
        text = fit.select(col(c).cast("string").alias("x"))
        codes = key_codes(text, "x")
        code = codes.count() if unseen_is_n else unknown
        out = apply_codes(out.withColumn("__txt", col(c).cast("string")), "__txt", codes, c, code).drop("__txt")
    return out


def flat_preprocess(df: DataFrame, numeric: Sequence[str], other: Sequence[str], train: Column | None = None) -> DataFrame:
    """Numeric columns: median fill; other columns: ordinal, -1 for null and unseen."""
    missing = [c for c in [*numeric, *other] if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return encode_ordinal(fill_numeric(df, numeric, "median", train), other, -1, train)


# categories that become a column each
WIDEST_ONEHOT = 10_000


def encode_categorical(df: DataFrame, columns: Sequence[str], strategy: str = "ordinal", seed: int = 0) -> DataFrame:
    """ordinal, ordinal_shuffled, ordinal_strict_feature_shuffled (rare-aware) or onehot.

    Unseen values are null.  A column of more than ``WIDEST_ONEHOT`` categories gets the position
    of its one, ``<column>_index``, in place of a column per category.  The rare-aware form encodes only columns whose rarest category
    has at least ten rows and which have fewer categories than a tenth of the rows.
    """
    if strategy in ("numeric", "none"):
        return df
    out = df
    if strategy == "ordinal_strict_feature_shuffled":
        n = df.count()
        keep = []
        for c in columns:
            least, k = df.groupBy(col(c)).count().agg(F.min("count"), F.count(F.lit(1))).first()
            if least >= 10 and k < n // 10:
                keep.append(c)
        columns = keep
    if strategy.startswith("ordinal"):
        for c in columns:
            if strategy.endswith("_shuffled"):
                out = permute_classes(out, c, c, seed)
            else:
                out = apply_codes(out, c, key_codes(df, c), c, None)
        return out
    if strategy == "onehot":
        made: dict[str, Column] = {}
        for c in columns:
            codes = key_codes(df, c)
            values = [r["value"] for r in codes.orderBy("code").limit(WIDEST_ONEHOT + 1).collect()]
            if len(values) > WIDEST_ONEHOT:
                # the position of the one, by a join with the class table: a table has no such width
                out = apply_codes(out, c, codes, f"{c}_index", None)
                continue
            shown = values[1:] if len(values) == 2 else values
            made |= {f"{c}_{v}": (col(c).eqNullSafe(F.lit(v))).cast("int") for v in shown}
        return out.withColumns(made).drop(*columns)
    raise ValueError(f"no such encoding of categories: {strategy!r}")


def binarize_labels(df: DataFrame, label: str, out: str, key: Sequence[str], split: str = "split", seed: int = 0) -> DataFrame:
    """Two classes: the larger string is positive; more: a random half.  A one-sided split gets
    its lowest-hash row flipped."""
    y = col(label).cast("string")
    found = df.select(y.alias("__c")).filter("__c is not null").distinct()
    classes = materialize(found.withColumn("__ch", S.stable_hash(seed, "__c")))
    n, top = classes.agg(F.count(F.lit(1)), F.max("__c")).first()
    if n < 2:
        raise ValueError("labels need at least two classes")
    if n == 2:
        marked = classes.select("__c", (F.col("__c") == F.lit(top)).alias("__pos"))
    else:
        ranked = numbered_by_hash(classes, "__ch", ["__c"], out="__cr")
        marked = ranked.select("__c", (F.col("__cr") <= max(1, n // 2)).alias("__pos"))
    # the class table joins like any other: small ones are broadcast, large ones are not
    out_df = df.join(marked, y == F.col("__c"), "left").withColumn(out, F.col("__pos").cast("int")).drop("__c", "__pos")
    sides = out_df.groupBy(col(split).alias("s")).agg(
        F.min(out).alias("lo"), F.max(out).alias("hi"),
        F.min(F.struct(S.stable_hash(seed, *key).alias("h"), *[col(k) for k in key])).alias("first"),
    )
    flips = sides.filter("lo = hi").select(F.col("s"), F.col("first"))
    mine = F.struct(S.stable_hash(seed, *key).alias("h"), *[col(k) for k in key])
    joined = out_df.withColumn("__me", mine).join(
        F.broadcast(flips), (col(split) == F.col("s")) & (F.col("__me") == F.col("first")), "left")
    return joined.withColumn(out, F.when(F.col("s").isNotNull(), 1 - col(out)).otherwise(col(out))).drop("__me", "s", "first")


# ---------------------------------------------------------------- text embedding


# tokens whose vectors a task holds at a time, and passes over the texts
TOKEN_BLOCK, MAX_TOKEN_BLOCKS = 250_000, 16


def mean_token_embedding(df: DataFrame, key: str, text: str, table: DataFrame, token: str, vector: str, dim: int) -> DataFrame:
    """Mean vector of the known tokens of each text, zeros when there is none.

    The table is broadcast in blocks of ``TOKEN_BLOCK`` tokens and a task sums its own texts, so only
    one vector per text and block is shuffled.  Of more than ``MAX_TOKEN_BLOCKS`` blocks, the rarest
    tokens are joined by shuffle instead.  Several blocks are added up one after the other, as the driver
    holds what it broadcasts: each round writes the sums so far and drops those before.
    """
    toks = df.select(col(key), F.explode(F.split(F.lower(col(text)), r"\s+")).alias("__tok")).filter("__tok <> ''")
    vec = materialize(table.select(col(token).alias("__t"), col(vector).alias("__v")))
    size, rare = vec.count(), None
    if size > TOKEN_BLOCK * MAX_TOKEN_BLOCKS:
        uses = toks.groupBy("__tok").agg(F.count(F.lit(1)).alias("__n"))
        counted = materialize(vec.join(uses, F.col("__t") == F.col("__tok")).select("__t", "__v", "__n"))
        size, least = 0, None
        for r in counted.groupBy("__n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("__n")).collect():
            if size + r["c"] > TOKEN_BLOCK * MAX_TOKEN_BLOCKS:
                break
            size, least = size + r["c"], r["__n"]
        often = F.lit(False) if least is None else F.col("__n") >= least
        vec, rare = counted.filter(often).drop("__n"), counted.filter(~often).drop("__n")
    blocks = -(-size // TOKEN_BLOCK)
    sides = [F.broadcast(vec.filter(F.pmod(F.xxhash64("__t"), F.lit(blocks)) == b)) for b in range(blocks)]
    sides += [rare] if rare is not None else []
    sides = sides or [vec]
    names = ["__all", *[f"__s{i}" for i in range(dim)]]
    sums = None
    for side in sides:
        part = toks.join(side, F.col("__tok") == F.col("__t")).groupBy(col(key)).agg(
            F.count(F.lit(1)).alias("__all"), *[F.sum(F.col("__v")[i].cast("double")).alias(f"__s{i}") for i in range(dim)])
        if len(sides) > 1:
            with shuffles_freed(df.sparkSession):
                before, sums = sums, materialize(part if sums is None else sums.unionByName(part).groupBy(col(key)).agg(*[F.sum(c).alias(c) for c in names]))
            if before is not None:
                discard(before)
        else:
            sums = part
    mean = sums.select(col(key).alias("__key"), F.array(*[F.col(f"__s{i}") / F.col("__all") for i in range(dim)]).alias("__e"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return df.join(mean, col(key) == F.col("__key"), "left").withColumn(
        "embedding", F.coalesce("__e", zeros)).drop("__key", "__e")


# ---------------------------------------------------------------- dataset transforms


class DatasetTransform:
    """Refitted on the output of the previous transform in a chain."""

    def __call__(self, ds: RelationalDataset) -> RelationalDataset:
        raise NotImplementedError


class DummyTables(DatasetTransform):
    def __call__(self, ds):
        return ensure_parents(ds)


class FillTimestamp(DatasetTransform):
    """``__timestamp__`` = 0 for tables without a time column."""

    def __call__(self, ds):
        for name, meta in list(ds.meta.items()):
            if not meta.time_column:
                cols = (*meta.columns, ColumnMeta("__timestamp__", TIMESTAMP))
                ds = ds.with_table(
                    replace(meta, columns=cols, time_column="__timestamp__"),
                    ds.tables[name].withColumn("__timestamp__", F.lit(0).cast("long")),
                )
        return ds


def distinct_with_null(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Distinct values per column with null as a value; exact only up to two, in one pass.

    ``min <> max`` or a null beside a value already proves more than one.
    """
    row = df.agg(*[f(col(c)).alias(f"{k}_{i}") for i, c in enumerate(columns)
                   for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count))],
                 F.count(F.lit(1)).alias("rows")).first()
    out = {}
    for i, c in enumerate(columns):
        some = row[f"n_{i}"] > 0
        varied = some and row[f"lo_{i}"] != row[f"hi_{i}"]
        out[c] = int(some) + int(varied) + int(row[f"n_{i}"] < row["rows"])
    return out


class DropConstantColumns(DatasetTransform):
    """Drop non-key, non-vector, non-text columns with at most one value; plus given dtypes."""

    def __init__(self, drop_dtypes: Sequence[str] = ()):
        self.drop_dtypes = tuple(drop_dtypes)

    def constant(self, meta: TableMeta, df: DataFrame) -> list[str]:
        checked = [c.name for c in meta.columns if not c.is_key and not c.is_vector and c.dtype != TEXT]
        counts = distinct_with_null(df, checked) if checked else {}
        return [c for c, n in counts.items() if n <= 1]

    def __call__(self, ds):
        for name, meta in list(ds.meta.items()):
            gone = set(self.constant(meta, ds.tables[name]))
            gone |= {c.name for c in meta.columns if c.dtype in self.drop_dtypes}
            if gone:
                keep = tuple(c for c in meta.columns if c.name not in gone)
                time = meta.time_column if meta.time_column not in gone else None
                ds = ds.with_table(replace(meta, columns=keep, time_column=time), ds.tables[name].drop(*gone))
        return ds


class KeyMapping(DatasetTransform):
    """One integer domain per primary key: its values and every foreign key referring to it.

    Null keys become -1.  The key table gains a row for each value only a foreign key has:
    other columns null, foreign keys -1, text empty.
    """

    def domains(self, ds: RelationalDataset) -> dict[tuple[str, str], DataFrame]:
        out = {}
        for name, meta in ds.meta.items():
            pk = meta.primary_key
            if pk is None:
                continue
            parts = [(ds.tables[name], pk)] + [(ds.tables[r.child], r.fk) for r in ds.backward(name)]
            out[(name, pk)] = key_codes(union_columns(parts), "x")
        return out

    def __call__(self, ds):
        from relweave.operators.joins import has_duplicate_keys

        domains = self.domains(ds)
        tables = {}
        for name, meta in ds.meta.items():
            df = ds.tables[name]
            pk = meta.primary_key
            if pk and has_duplicate_keys(df, pk):
                raise ValueError(f"duplicate primary key in {name}")
            if pk:
                known = df.select(col(pk).alias("__pk"))
                extra = domains[(name, pk)].join(known, F.col("value") == F.col("__pk"), "left_anti")
                blank = []
                for c in meta.columns:
                    t = df.schema[c.name].dataType
                    if c.name == pk:
                        blank.append(F.col("value").cast(t).alias(pk))
                    else:
                        fill = F.lit("") if c.dtype == TEXT else F.lit(None)
                        blank.append(fill.cast(t).alias(c.name))
                df = df.select(*[col(c.name) for c in meta.columns]).unionByName(extra.select(*blank))
                df = apply_codes(df, pk, domains[(name, pk)], pk, -1)
            for r in ds.forward(name):
                if (r.parent, r.pk) in domains:
                    df = apply_codes(df, r.fk, domains[(r.parent, r.pk)], r.fk, -1)
            tables[name] = df.select(*[col(c.name) for c in meta.columns])
        return replace(ds, tables=tables)


class PerColumn(DatasetTransform):
    """Column transforms in order; each declared group, and all text columns, share one fit."""

    def __init__(self, transforms: Sequence[ColumnTransform], skip: Sequence[tuple[str, str]] = ()):
        self.transforms, self.skip = list(transforms), set(skip)

    @staticmethod
    def groups(ds: RelationalDataset, dtype: str) -> list[list[tuple[str, str]]]:
        cols = [(t, c.name) for t, m in ds.meta.items() for c in m.columns if c.dtype == dtype and not c.is_vector]
        if dtype == TEXT:
            return [cols] if cols else []
        grouped = [[x for x in g if x in cols] for g in map(lambda g: [tuple(x) for x in g], ds.column_groups)]
        used = {x for g in grouped for x in g}
        return [g for g in grouped if g] + [[x] for x in cols if x not in used]

    def __call__(self, ds):
        for tr in self.transforms:
            for group in self.groups(ds, tr.input_dtype):
                members = [m for m in group if m not in self.skip]
                if not members:
                    continue
                fitted = tr.fit(union_columns([(ds.tables[t], c) for t, c in members]))
                renamed: dict[tuple[str, str], list[str]] = {}
                for t, c in members:
                    meta = ds.meta[t]
                    df, made = fitted.apply(ds.tables[t], c)
                    if meta.time_column == c and c not in [m.name for m in made]:
                        # a time column stays, as int64, under its own name
                        df = df.withColumn(c, col(next(m.name for m in made if m.name == f"TIMESTAMP_{c}")))
                        made = [m for m in made if m.name != f"TIMESTAMP_{c}"] + [ColumnMeta(c, TIMESTAMP)]
                        df = df.drop(f"TIMESTAMP_{c}")
                    at = [x.name for x in meta.columns].index(c)
                    cols = (*meta.columns[:at], *made, *meta.columns[at + 1:])
                    ds = ds.with_table(replace(meta, columns=cols), df.select(*[col(x.name) for x in cols]))
                    renamed[(t, c)] = [m.name for m in made]
                if any(tuple(x) in renamed for g in ds.column_groups for x in g):
                    new_groups = []
                    for g in ds.column_groups:
                        width = max((len(renamed.get(tuple(x), [x[1]])) for x in g), default=1)
                        for i in range(width):
                            new_groups.append([
                                (x[0], renamed.get(tuple(x), [x[1]])[min(i, len(renamed.get(tuple(x), [x[1]])) - 1)])
                                for x in g])
                    ds = replace(ds, column_groups=new_groups)
        return ds


def transform_chain(ds: RelationalDataset, steps: Sequence[DatasetTransform]) -> RelationalDataset:
    """Run transforms in order, each refitted on the previous output."""
    for step in steps:
        ds = step(ds)
    return ds


def pre_dfs_chain() -> list[DatasetTransform]:
    """Dummy tables, key mapping, canonical numbers and times, TIMESTAMP columns, no text."""
    return [DummyTables(), KeyMapping(), PerColumn([CanonicalizeNumeric(), CanonicalizeDatetime()]),
            DropConstantColumns([TEXT])]


def post_dfs_chain() -> list[DatasetTransform]:
    """Canonicalise, calendar parts, category codes, constant filter, timestamp fill."""
    return [PerColumn([CanonicalizeNumeric(), CanonicalizeDatetime(), FeaturizeDatetime(), RemapCategory()]),
            DropConstantColumns(), FillTimestamp()]


def fit_task_columns(task_columns: Sequence[str], target: TableMeta) -> tuple[list[str], list[str]]:
    """(columns to fit, transform-only columns): names already in the target table reuse its fit."""
    known = {c.name for c in target.columns}
    return [c for c in task_columns if c not in known], [c for c in task_columns if c in known]

