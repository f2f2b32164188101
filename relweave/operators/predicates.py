"""Projections, predicates and column filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from relweave.functions import scalar as S
from relweave.functions.scalar import col
from relweave.plans.ordering import prefix_sums, top_per_group

OPERATORS = {
    ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v,
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v,
    "in": lambda c, v: c.isin(list(v)), "not_in": lambda c, v: ~c.isin(list(v)),
}


def predicate(c: str | Column, op: str, threshold) -> Column:
    """Comparison or membership test; null gives false."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(OPERATORS[op](col(c), threshold), F.lit(False))


def predicate_label(c: str | Column, op: str, threshold) -> Column:
    return predicate(c, op, threshold).cast("int")


def node_filter(df: DataFrame, conditions: dict[str, dict]) -> DataFrame:
    """Conjunction of ``{column: {"operator": op, "value": v}}``."""
    for c, rule in conditions.items():
        df = df.filter(predicate(c, rule["operator"], rule["value"]))
    return df


def project_alias(df: DataFrame, key: str, value: str, key_alias: str, value_alias: str) -> DataFrame:
    return df.select(col(key).alias(key_alias), col(value).alias(value_alias))


def feature_statistics(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long (by..., column, n_rows, n_values) with exact distinct counts of finite values.

    Unpivot then combine per (column, value): no row is multiplied per distinct aggregate
    beyond its own columns, and a hot column spreads over its values.
    """
    keys = [col(c) for c in by]
    items = F.array(*[F.struct(F.lit(c).alias("column"), S.finite(col(c)).alias("v")) for c in columns])
    long = df.select(*keys, F.inline(items)).groupBy(*keys, "column", "v").agg(F.count(F.lit(1)).alias("n"))
    return long.groupBy(*keys, "column").agg(F.sum("n").alias("n_rows"), F.count("v").alias("n_values"))


def unique_feature_filter(df: DataFrame, columns: Sequence[str], threshold: int = 1) -> DataFrame:
    """(column, n_values, keep): more than ``threshold`` values, or too few rows to judge."""
    return feature_statistics(df, columns).select(
        "column", "n_values", ((F.col("n_rows") <= threshold) | (F.col("n_values") > threshold)).alias("keep"))


def valid_feature_filter(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """(column, keep): not one value in every row, not all null in train or in test."""
    def one(c: str):
        x = S.finite(col(c))
        varied = (F.min(x) != F.max(x)) | ((F.count(x) > 0) & (F.count(x) < F.count(F.lit(1))))
        sides = (F.count(F.when(train, x)) > 0) & (F.count(F.when(~train, x)) > 0)
        return F.struct(F.lit(c).alias("column"), (F.coalesce(varied, F.lit(False)) & sides).alias("keep"))

    return df.agg(F.array(*[one(c) for c in columns]).alias("xs")).select(F.inline("xs"))


def constant_fraction(tables: dict[str, tuple[DataFrame, Sequence[str]]], threshold: float = 0.5) -> DataFrame:
    """Per table: checked and constant columns, fraction, validity; ``database_valid`` on each row.

    A column is constant when all its finite values are equal or none is finite.
    """
    out = None
    for name, (df, columns) in tables.items():
        def constant(c: str) -> Column:
            x = S.finite(col(c)) if dict(df.dtypes)[c] != "string" else col(c)
            return F.coalesce(F.min(x) == F.max(x), F.lit(True)).cast("int")

        total = sum((constant(c) for c in columns[1:]), constant(columns[0])) if columns else F.lit(0)
        part = df.agg(total.alias("constant_columns")).select(
            F.lit(name).alias("table_name"), F.lit(len(columns)).alias("checked_columns"), "constant_columns")
        out = part if out is None else out.unionByName(part)
    frac = F.when(F.col("checked_columns") > 0, F.col("constant_columns") / F.col("checked_columns")).otherwise(F.lit(0.0))
    judged = out.withColumn("constant_fraction", frac).withColumn("is_valid", F.col("constant_fraction") <= threshold)
    # one row per table of the schema, so the window is as small as the metadata
    return judged.withColumn("database_valid", F.min("is_valid").over(Window.partitionBy(F.lit(1))))


def select_features(
    catalogue: DataFrame, max_columns: int, importance: DataFrame | None = None, top_k: int | None = None, seed: int = 0
) -> DataFrame:
    """(dataset, task, feature) kept: top-k of an importance list where there is one, else a
    seeded choice of at most ``max_columns``.

    ``catalogue`` (dataset, task, feature) lists float and category non-target columns;
    ``importance`` (dataset, task, feature, importance).
    """
    keys = ["dataset", "task"]
    hashed = catalogue.withColumn("h", S.stable_hash(seed, "dataset", "task", "feature"))
    if importance is None:
        return top_per_group(hashed, keys, [F.col("h"), F.col("feature")], max_columns).select(*keys, "feature")
    listed = importance.select(*keys).distinct()
    ranked = importance.join(catalogue, [*keys, "feature"], "left_semi")
    best = top_per_group(ranked, keys, [F.col("importance").desc(), F.col("feature")], min(top_k or max_columns, max_columns))
    rest = top_per_group(hashed.join(listed, keys, "left_anti"), keys, [F.col("h"), F.col("feature")], max_columns)
    return best.select(*keys, "feature").unionByName(rest.select(*keys, "feature"))


# name patterns of synthesised features (fixed values)
AGG_PATTERN = r"(?:^|\.)[A-Z]+\("
AGG_CHILD_PATTERN = r"[A-Z]+\(([^).\[]+)"
TIME_PATTERN = r"(?:^|\.)(TIMESTAMP|YEAR|MONTH|DAY|DAYOFWEEK|QUARTER|WEEK|HOUR|MINUTE|SECOND)_"


def classify_columns(names: DataFrame, name: str = "column", target: str | None = None) -> DataFrame:
    """Feature names to native / aggregate (with child) / joined (with parent) / other."""
    n = F.col(name)
    low = F.lower(n)
    other = n.rlike(TIME_PATTERN) | low.isin("index", "target", "label") | low.endswith("id")
    agg = n.rlike(AGG_PATTERN)
    prefix = F.substring_index(n, ".", 1)
    joined = n.contains(".") & (prefix != F.lit(target) if target else F.lit(True))
    kind = F.when(other, "other").when(agg, "aggregate").when(joined, "joined").otherwise("native")
    via = F.when(kind == "aggregate", F.regexp_extract(n, AGG_CHILD_PATTERN, 1)).when(kind == "joined", prefix)
    return names.withColumns({"kind": kind, "via": via})


def gap_runs(df: DataFrame, value: str, by: Sequence[str], gap: float, weight: str = "n") -> DataFrame:
    """Size of each run of ordered distinct values whose neighbours differ by at most ``gap``.

    Input has one row per (by, value) with a count.
    """
    seen = prefix_sums(df, value, {}, by, previous="__prev")
    new = F.when(F.col("__prev").isNull() | (col(value) - F.col("__prev") > gap), 1).otherwise(0)
    runs = prefix_sums(seen.withColumn("__new", new), value, {"__upto": "__new"}, by)
    return runs.withColumn("run", F.col("__upto") + F.col("__new")).groupBy(*[col(c) for c in by], "run").agg(
        F.sum(col(weight)).alias("n"))


def dominant_ratio(df: DataFrame, by: Sequence[str], columns: Sequence[str], atol: float) -> DataFrame:
    """Share of the most common value per (by, column); values within ``atol`` chain as equal."""
    keys = [col(c) for c in by]
    items = F.array(*[F.struct(F.lit(c).alias("column"), S.finite(col(c)).alias("v")) for c in columns])
    counts = df.select(*keys, F.inline(items)).filter("v is not null").groupBy(*keys, "column", "v").agg(
        F.count(F.lit(1)).alias("n"))
    runs = gap_runs(counts, "v", [*by, "column"], atol)
    return runs.groupBy(*keys, "column").agg((F.max("n") / F.sum("n")).alias("ratio"))


def repetitive_filter(
    ratios: DataFrame, by: Sequence[str], inspected: int, sampled: int, ratio: float, limit: float, safety: float = 1.0
) -> DataFrame:
    """Expected repetitive columns per dataset and whether the dataset is kept."""
    flagged = F.sum((F.col("ratio") >= ratio).cast("long"))
    expected = flagged / F.lit(inspected) * F.lit(min(sampled, max(1, inspected))) * F.lit(safety)
    return ratios.groupBy(*[col(c) for c in by]).agg(
        flagged.alias("flagged"), expected.alias("expected"), (expected <= limit).alias("keep"))
