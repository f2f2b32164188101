"""Fixed-shape task blocks for training corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from relweave.functions import scalar as S
from relweave.functions.scalar import col
from relweave.operators import splits as P, transforms as T


def dense_pad(c: str, width: int, value: float = 0.0, on_mismatch: str = "pad"):
    """A ragged row as a fixed-width array; wider rows are an error, or null with "skip"."""
    x = col(c).cast("array<float>")
    fill = F.array_repeat(F.lit(value).cast("float"), F.greatest(F.lit(0), F.lit(width) - F.size(x)))
    padded = F.concat(x, fill)
    if on_mismatch == "skip":
        return F.when(F.size(x) == width, x)
    wide = F.raise_error(F.concat(F.lit("row wider than "), F.lit(str(width)))).cast("array<float>")
    return F.when(F.size(x) > width, wide).otherwise(padded)


def task_block(
    rows: DataFrame, dataset: str, task: str, numeric: Sequence[str], categorical: Sequence[str], label: str, key: Sequence[str],
    entity: str | None, foreign_keys: Sequence[str], parents: dict[str, DataFrame], total: int, width: int,
    min_ratio: float = 0.3, max_ratio: float = 0.8, seed: int = 0, split: str = "split",
) -> DataFrame:
    """One classification task as ``total`` long-form rows.

    Columns: dataset, task, row, X (padded to ``width``), y, num_features, single_eval_pos,
    fk_values, entity_id, parent_entity_ids (-1 where missing).  Encoders are fitted on train
    rows, whole entities are sampled together, and row order is a hash of the key.
    ``parents`` maps a foreign key to (row_index, entity_id).
    """
    from relweave.operators.joins import parent_entity_ids

    base = rows.filter(col(split).isin(P.TRAIN, P.TEST))
    train = col(split) == P.TRAIN
    enc = T.fill_numeric(base, numeric, "mean", train)
    enc = T.encode_ordinal(enc, categorical, train=train, unseen_is_n=True)
    enc = T.binarize_labels(enc, label, "__y", key, split, seed)
    for i, k in enumerate(foreign_keys):
        if k in parents:
            enc = parent_entity_ids(enc, k, parents[k], "row_index", "entity_id", f"__pe{i}")
        else:
            enc = enc.withColumn(f"__pe{i}", F.lit(-1).cast("long"))
    if entity:
        picked = P.entity_cluster_sample(enc, entity, key, total, seed)
    else:
        picked = P.capped_rows(enc, total, key, seed).withColumn("copy", F.lit(0))
    # at most `total` rows, the fixed block length
    order = Window.partitionBy(F.lit(1)).orderBy(S.stable_hash(f"{seed}o", *key, "copy"), *[col(k) for k in key], "copy")
    numbered = picked.withColumn("row", F.row_number().over(order) - 1)
    features = [*numeric, *categorical]
    x = F.array(*[col(c).cast("float") for c in features])
    u = S.stable_uniform(seed, F.lit(dataset), F.lit(task))
    pos = F.greatest(F.lit(1), F.least(F.lit(total - 1), F.round((F.lit(min_ratio) + u * (max_ratio - min_ratio)) * total).cast("int")))
    minus = F.lit(-1).cast("long")
    none = F.array().cast("array<bigint>")
    out = numbered.withColumn("__x", x)
    return out.select(
        F.lit(dataset).alias("dataset"), F.lit(task).alias("task"), "row", dense_pad("__x", width).alias("X"),
        F.col("__y").alias("y"), F.lit(len(features)).alias("num_features"), pos.alias("single_eval_pos"),
        (F.array(*[F.coalesce(col(k).cast("long"), minus) for k in foreign_keys]) if foreign_keys else none).alias("fk_values"),
        (F.coalesce(col(entity).cast("long"), minus) if entity else minus).alias("entity_id"),
        (F.array(*[F.col(f"__pe{i}") for i in range(len(foreign_keys))]) if foreign_keys else none).alias("parent_entity_ids"))


def block_extract(
    blocks: DataFrame, width: int, categorical: Sequence[int] = (), every: int = 1, min_test_rows: int = 0
) -> DataFrame:
    """Flat rows of a block: ``feat_i`` / ``cat_i`` columns, ``target`` and train or test.

    Tasks are taken at even spacing in name order, among those with enough test rows.
    """
    sizes = blocks.groupBy("dataset", "task").agg(
        F.sum((F.col("row") >= F.col("single_eval_pos")).cast("long")).alias("tests")).filter(F.col("tests") >= min_test_rows)
    from relweave.plans.ordering import numbered

    ranked = numbered(sizes.select("dataset", "task"), ["dataset", "task"], out="__rn")
    chosen = ranked.filter(F.pmod(F.col("__rn") - 1, F.lit(every)) == 0).select("dataset", "task")
    cols = [F.col("X")[i].alias(f"cat_{i}" if i in categorical else f"feat_{i}") for i in range(width)]
    return blocks.join(chosen, ["dataset", "task"], "left_semi").select(
        "dataset", "task", "row", *cols, F.col("y").alias("target"),
        F.when(F.col("row") < F.col("single_eval_pos"), "train").otherwise("test").alias("split"))
