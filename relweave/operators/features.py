"""Row-wise feature builders."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from relweave.functions import scalar as S
from relweave.functions.scalar import col
from relweave.plans.ordering import numbered


def flatten_features(
    df: DataFrame, keys: Sequence[str] = (), numeric: Sequence[str] = (), categories: Sequence[str] = (),
    vectors: dict[str, int] | None = None,
) -> DataFrame:
    """Feature columns only: vectors as scalars, categories kept, names free of special signs."""
    def clean(name: str) -> str:
        return re.sub(r"[^0-9A-Za-z_]+", "_", name).strip("_")

    cols = [col(k) for k in keys] + [col(c).alias(clean(c)) for c in (*numeric, *categories)]
    for v, dim in (vectors or {}).items():
        cols += S.explode_vector(v, dim, clean(v))
    return df.select(*cols)


def row_fingerprint(
    df: DataFrame, columns: Sequence[str], key: str, salt: int = 0, training: bool = True, out: str = "fingerprint"
) -> DataFrame:
    """SHA-256 of the salted row as a double in [0, 1).

    In training mode equal rows get different fingerprints: copy k is hashed with salt + k.
    Copies are numbered by ``key``; a hot row value is cut along that order, not one task.
    """
    def fp(extra):
        text = F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns],
                           (F.lit(salt) + extra).cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 52, 13), 16, 10).cast("long") / F.lit(float(1 << 52))

    plain = df.withColumn(out, fp(F.lit(0)))
    if not training:
        return plain
    copies = numbered(plain, [key], [out], "__copy")
    return copies.withColumn(out, F.when(F.col("__copy") == 1, col(out)).otherwise(fp(F.col("__copy") - 1))).drop("__copy")


def interaction_pairs(df: DataFrame, columns: Sequence[str], max_pairs: int = 100, seed: int = 0) -> list[tuple[str, str]]:
    """Up to ``max_pairs`` distinct pairs (self-pairs allowed) in hash order; names only."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    frame = df.sparkSession.createDataFrame(pairs, "a string, b string")
    rows = frame.orderBy(S.stable_hash(seed, "a", "b"), "a", "b").limit(max_pairs).collect()
    return [(r["a"], r["b"]) for r in rows]


def poly_interactions(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Columns scaled by their population std (not centred), then products of the given pairs."""
    row = df.agg(*[F.stddev_pop(col(c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    scaled = {c: col(c) / F.lit(row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}
    rest = [col(c) for c in df.columns if c not in columns]
    return df.select(
        *rest, *[e.alias(c) for c, e in scaled.items()],
        *[(scaled[a] * scaled[b]).alias(f"{a}*{b}") for a, b in pairs],
    )
