"""Column expressions; everything here stays inside JVM code generation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, functions as F

HASH_BITS = 60


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def stable_hash(seed: str | int, *cols: str | Column) -> Column:
    """60-bit hash of (seed, columns) that any SQL engine can recompute.

    Random choices are functions of the row key, so they do not depend on partitioning,
    on retries of lost tasks, or on process-wide random state.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def stable_uniform(seed: str | int, *cols: str | Column) -> Column:
    """Uniform double in [0, 1) from the stable hash."""
    return stable_hash(seed, *cols) / F.lit(float(1 << HASH_BITS))


def stable_seed(text: Column) -> Column:
    """First four bytes of SHA-256 as an unsigned integer."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def finite(c: Column) -> Column:
    """Null for NaN and infinities, the value otherwise."""
    d = c.cast("double")
    inf = F.lit(float("inf"))
    return F.when(F.isnan(d) | (F.abs(d) == inf), None).otherwise(d)


def year(c):
    return F.year(col(c))


def month(c):
    return F.month(col(c))


def day(c):
    return F.dayofmonth(col(c))


def dayofweek(c):
    """Monday is 0."""
    return F.weekday(col(c))


def epoch_micros(c) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def epoch_nanos(c) -> Column:
    """Datetime to int64 nanoseconds since the epoch."""
    return epoch_micros(c) * F.lit(1000)


def from_epoch_nanos(c) -> Column:
    """int64 nanoseconds to a timestamp without zone (microsecond precision)."""
    whole = F.call_function("div", col(c) - F.pmod(col(c), F.lit(1000)), F.lit(1000))
    return F.timestamp_micros(whole).cast("timestamp_ntz")


def canon_numeric(c) -> Column:
    return col(c).try_cast("float")


def canon_datetime(c) -> Column:
    return col(c).try_cast("timestamp_ntz")


def cast_feature(c, dtype: str, in_size: int = 1) -> Column:
    """Cast to the output type of a logical dtype, with its null convention."""
    x = col(c)
    if in_size > 1:
        zeros = F.array_repeat(F.lit(0.0).cast("float"), in_size)
        return F.coalesce(x.cast("array<float>"), zeros)
    if dtype == "float":
        return x.cast("float")
    if dtype == "text":
        return F.coalesce(x.cast("string"), F.lit(""))
    if dtype == "datetime":
        return x.cast("timestamp_ntz")
    if dtype == "timestamp":
        return x.cast("long")
    return x.cast("string")


def nan_stack(c, dim: int) -> Column:
    """Null vectors become zero vectors."""
    return F.coalesce(col(c), F.array_repeat(F.lit(0.0), dim).cast("array<double>"))


def explode_vector(c: str, dim: int, prefix: str | None = None) -> list[Column]:
    """One scalar column per dimension of a fixed-width vector."""
    return [col(c)[i].alias(f"{prefix or c}_{i}") for i in range(dim)]


# coefficients of Acklam's published approximation of the normal quantile (fixed values)
_PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
          1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
          6.680131188771972e01, -1.328068155288572e01)
_PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
          -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_PPF_LOW = 0.02425


def _horner(coef: Sequence[float], x):
    out = coef[0]
    for k in coef[1:]:
        out = x * out + k
    return out


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Standard normal quantile of an array (relative error 1.15e-9)."""
    q_tail = np.sqrt(-2.0 * np.log(np.minimum(p, 1.0 - p)))
    tail = _horner(_PPF_C, q_tail) / (_horner(_PPF_D, q_tail) * q_tail + 1.0)
    q = p - 0.5
    r = q * q
    centre = _horner(_PPF_A, r) * q / (_horner(_PPF_B, r) * r + 1.0)
    return np.where(p < _PPF_LOW, tail, np.where(p > 1.0 - _PPF_LOW, -tail, centre))


def normal_cdf_inverse(p: Column) -> Column:
    """The same quantile as one column expression."""
    q_tail = F.sqrt(F.lit(-2.0) * F.ln(F.least(p, F.lit(1.0) - p)))
    tail = _horner(_PPF_C, q_tail) / (_horner(_PPF_D, q_tail) * q_tail + F.lit(1.0))
    q = p - F.lit(0.5)
    r = q * q
    centre = _horner(_PPF_A, r) * q / (_horner(_PPF_B, r) * r + F.lit(1.0))
    return F.when(p < _PPF_LOW, tail).when(p > 1.0 - _PPF_LOW, -tail).otherwise(centre)


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; null if a side is constant."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
