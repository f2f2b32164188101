"""Key, type and shape inference.  Each table costs one aggregation pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from relweave.functions.scalar import col
from relweave.session import materialize

# naming rules and cut-offs (fixed values)
TIME_NAMES = ("date", "timestamp", "time", "datetime")
INTEGER_CATEGORY_BELOW = 100
STRING_CATEGORY_BELOW = 10_000
CLASSIFICATION_AT_MOST = 20
# relative error of the sketches of distinct values, and how near to a bound they are not trusted
SKETCH_ERROR = 0.01
SKETCH_MARGIN = 0.1


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, distinct) with exact counts.

    Values are unpivoted and combined per (column, value) before the shuffle, so the work
    spreads over values instead of expanding every row once per distinct aggregate.
    """
    items = F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("v")) for c in columns
    ])
    pairs = df.select(F.inline(items)).filter("v is not null").distinct()
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    counts = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("distinct"))


def unique_columns(tables: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """(table, column) of the id columns with one row per value, in two jobs whatever the number of tables.

    A sketch of the distinct values screens every column in one scan of its table; only a column
    whose sketch comes near the row count is grouped to make sure.
    """
    parts = []
    for t, df in tables.items():
        ids = [c for c in df.columns if c.lower().endswith("id")]
        if ids:
            row = df.agg(F.count(F.lit(1)).alias("rows"), *[f(col(c)).alias(f"{k}{i}") for i, c in enumerate(ids) for k, f in (
                ("a", lambda c: F.approx_count_distinct(c, SKETCH_ERROR)), ("p", F.count))])
            items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("approx"), F.col(f"p{i}").alias("present")) for i, c in enumerate(ids)])
            parts.append(row.select(F.lit(t).alias("t"), "rows", F.inline(items)))
    if not parts:
        return []
    screened = reduce(DataFrame.unionByName, parts).filter(
        (F.col("rows") > 0) & (F.col("present") == F.col("rows")) & (F.col("approx") >= F.col("rows") * (1 - SKETCH_MARGIN))).collect()
    maybe = [(r["t"], r["column"]) for r in screened]
    if not maybe:
        return []
    repeats = reduce(DataFrame.unionByName, [
        tables[t].groupBy(col(c).alias("v")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).select(F.lit(t).alias("t"), F.lit(c).alias("column"))
        for t, c in maybe]).collect()
    return [m for m in maybe if m not in {(r["t"], r["column"]) for r in repeats}]


def infer_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column, role, parent) for primary keys, foreign keys and time columns.

    A primary key is the first column named ``id`` or after its table (with or without the
    plural's s, with or without an underscore before ``id``), or else the first ``*id`` column
    with one row per value. A foreign key is named like another table's primary key, the first
    such table in the given order. All rules run over one catalogue of the tables' columns.
    """
    spark = next(iter(tables.values())).sparkSession
    names = [(t, i, c, j) for i, (t, df) in enumerate(tables.items()) for j, c in enumerate(df.columns)]
    columns = spark.createDataFrame(names, "table_name string, t int, column string, c int").withColumn("low", F.lower("column"))
    stem = F.regexp_replace("table_name", "s+$", "")
    short = F.regexp_replace("low", "_?id$", "")
    called = F.col("low").endswith("id") & ((F.col("low") == "id") | (~F.col("low").isin("_id") & ((short == F.col("table_name")) | (short == stem))))
    marked = columns.withColumn("named", called)
    plain = [r[0] for r in marked.groupBy("table_name").agg(F.bool_or("named").alias("has")).filter("not has").select("table_name").collect()]
    unique = unique_columns({t: tables[t] for t in plain})
    by_value = spark.createDataFrame(unique, "table_name string, column string").withColumn("single", F.lit(True))
    keyed = marked.join(by_value, ["table_name", "column"], "left").filter("named or single")
    pk = keyed.groupBy("table_name", "t").agg(F.min_by("column", "c").alias("column"))
    primary = pk.select("table_name", "column", F.lit("primary_key").alias("role"), F.lit(None).cast("string").alias("parent"))
    others = columns.join(pk.select("table_name", "column"), ["table_name", "column"], "left_anti")
    target = pk.select(F.col("table_name").alias("p_name"), F.col("t").alias("p_t"), F.col("column").alias("p_column"), F.lower("column").alias("low"))
    foreign = others.join(target, "low").filter("p_name <> table_name").groupBy("table_name", "column").agg(
        F.min_by(F.concat_ws(".", "p_name", "p_column"), "p_t").alias("parent"))
    foreign = foreign.select("table_name", "column", F.lit("foreign_key").alias("role"), "parent")
    times = columns.filter(F.col("low").isin(list(TIME_NAMES))).groupBy("table_name").agg(F.min_by("column", "c").alias("column"))
    times = times.select("table_name", "column", F.lit("time").alias("role"), F.lit(None).cast("string").alias("parent"))
    return primary.unionByName(foreign).unionByName(times)


def infer_dtypes(df: DataFrame) -> DataFrame:
    """(column, dtype) from the physical type, whitespace, castability and cardinality."""
    spark = df.sparkSession
    ints, strings, fixed = [], [], []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.IntegralType):
            ints.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            strings.append(f.name)
        elif isinstance(f.dataType, (T.FractionalType, T.DecimalType)):
            fixed.append((f.name, "float"))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            fixed.append((f.name, "datetime"))
        elif isinstance(f.dataType, T.ArrayType):
            fixed.append((f.name, "float"))
        else:
            fixed.append((f.name, "text"))
    out = spark.createDataFrame(fixed, "column string, dtype string") if fixed else None
    scanned = ints + strings
    if scanned:
        # one scan: flags of the text columns and a sketch of every column's distinct values
        aggs = []
        for i, c in enumerate(scanned):
            v = col(c).cast("string")
            aggs += [F.approx_count_distinct(col(c), SKETCH_ERROR).alias(f"n{i}"), F.count(v).alias(f"p{i}")]
            if c in strings:
                aggs += [F.bool_or(v.rlike(r"\s")).alias(f"b{i}"),
                         F.bool_and(v.try_cast("timestamp").isNotNull() | v.isNull()).alias(f"t{i}")]
        row = df.agg(*aggs).first()
        counts = {c: row[f"n{i}"] for i, c in enumerate(scanned)}
        # a column near its cut-off is counted exactly: it has few values, so little is exchanged
        near = [c for c in scanned if abs(counts[c] - (INTEGER_CATEGORY_BELOW if c in ints else STRING_CATEGORY_BELOW))
                <= SKETCH_MARGIN * counts[c] + 1]
        if near:
            counts |= {r["column"]: r["distinct"] for r in distinct_counts(df, near).collect()}
        facts = [(c, c in strings, counts[c] if row[f"p{i}"] else None, bool(c in strings and row[f"b{i}"]), bool(c in strings and row[f"t{i}"]))
                 for i, c in enumerate(scanned)]
        stats = spark.createDataFrame(facts, "column string, is_text boolean, n long, blank boolean, is_time boolean")
        dtype = (
            F.when(~F.col("is_text"), F.when(F.col("n") < INTEGER_CATEGORY_BELOW, "category").otherwise("float"))
            .when(F.col("is_time"), "datetime")
            .when(F.col("blank"), "text")
            .when(F.col("n") < STRING_CATEGORY_BELOW, "category")
            .otherwise("text")
        )
        # a column of nulls has no values: text is a category, a number stays a number
        empty = F.when(F.col("is_text"), "category").otherwise("float")
        got = stats.select("column", F.when(F.col("n").isNull(), empty).otherwise(dtype).alias("dtype"))
        out = got if out is None else out.unionByName(got)
    return out


def table_archetype(catalogue: DataFrame) -> DataFrame:
    """source / ts_child / non_ts_child per (db, table_name) from its column roles."""
    has_fk = F.bool_or(F.col("role") == "foreign_key")
    has_time = F.bool_or(F.col("role") == "time")
    kind = F.when(~has_fk, "source").when(has_time, "ts_child").otherwise("non_ts_child")
    return catalogue.groupBy("db", "table_name").agg(kind.alias("archetype"))


def schema_topology(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables, unique parent edges and longest key path per database; a cycle is an error.

    ``tables`` (db, table_name), ``edges`` (db, child, parent).  Level k holds the tables ending
    a path of length k, so the loop runs once per level for all databases together; a path longer than the largest
    database has tables must come back to one of them.
    """
    e = edges.select("db", "child", "parent").distinct()
    nodes = e.select("db", F.col("child").alias("node")).unionByName(e.select("db", F.col("parent").alias("node"))).distinct()
    most = nodes.groupBy("db").count().agg(F.max("count")).first()[0] or 0
    level = e.select("db", F.col("child").alias("node"), F.lit(1).alias("depth")).distinct()
    levels = [level]
    for depth in range(2, max(most, 2) + 1):
        level = materialize(
            level.join(e, (level["node"] == e["parent"]) & (level["db"] == e["db"]))
            .select(level["db"], F.col("child").alias("node"), F.lit(depth).alias("depth")).distinct()
        )
        if level.isEmpty():
            break
        levels.append(level)
    else:
        raise ValueError("the keys of a database lead back to one of its tables")
    deep = levels[0]
    for more in levels[1:]:
        deep = deep.unionByName(more)
    deepest = deep.groupBy("db").agg(F.max("depth").alias("depth"))
    n_edges = e.groupBy("db").agg(F.count(F.lit(1)).alias("n_edges"))
    return (
        tables.groupBy("db").agg(F.count_distinct("table_name").alias("n_tables"))
        .join(n_edges, "db", "left").join(deepest, "db", "left")
        .select("db", "n_tables", F.coalesce("n_edges", F.lit(0)).alias("n_edges"),
                F.coalesce("depth", F.lit(0)).alias("depth"))
    )


def count_tasks(labels: DataFrame) -> DataFrame:
    """Per db: classification (at most 20 distinct labels) and regression tasks.

    ``labels`` is long: (db, task, label).
    """
    distinct = labels.filter("label is not null").select("db", "task", "label").distinct()
    n = distinct.groupBy("db", "task").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("db").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.sum((F.col("n") <= CLASSIFICATION_AT_MOST).cast("long")).alias("n_classification"),
        F.sum((F.col("n") > CLASSIFICATION_AT_MOST).cast("long")).alias("n_regression"),
    )


def corpus_accounting(catalogue: DataFrame, requested: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per corpus: requested, complete and taskful databases, tables, rows, cells, tasks.

    ``catalogue`` (corpus, db, table_name, n_rows, n_cols) lists stored tables, ``requested``
    (corpus, db) all databases asked for, ``tasks`` (corpus, db, task) stored tasks.
    """
    done = catalogue.groupBy("corpus").agg(
        F.count_distinct("db").alias("completed"), F.count(F.lit(1)).alias("n_tables"),
        F.sum("n_rows").alias("n_rows"), F.sum(F.col("n_rows") * F.col("n_cols")).alias("n_cells"),
    )
    stored = tasks.join(catalogue.select("corpus", "db").distinct(), ["corpus", "db"], "left_semi")
    with_tasks = stored.groupBy("corpus").agg(
        F.count_distinct("db").alias("with_tasks"), F.count_distinct("db", "task").alias("n_tasks"))
    asked = requested.groupBy("corpus").agg(F.count_distinct("db").alias("requested"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return asked.join(done, "corpus", "left").join(with_tasks, "corpus", "left").select(
        "corpus", "requested", *[zero(c) for c in
                                 ("completed", "with_tasks", "n_tables", "n_rows", "n_cells", "n_tasks")])


def evaluation_manifest(
    rows: DataFrame, n_features: int, metric: str, support_cap: int = 512, test_cap: int = 50_000,
    seeds: int = 10, expected: int | None = None,
) -> DataFrame:
    """Per classification task: pool sizes, caps and seeds; fails on an unexpected task count.

    ``rows`` is long: (dataset, task, split, label).
    """
    out = rows.groupBy("dataset", "task").agg(
        F.sum((F.col("split") == "train").cast("long")).alias("train_pool_rows"),
        F.sum((F.col("split") == "test").cast("long")).alias("test_pool_rows"),
    ).select(
        "dataset", "task", F.lit(metric).alias("metric"), "train_pool_rows", "test_pool_rows",
        F.lit(n_features).alias("n_features"), F.lit(support_cap).alias("support_cap"),
        F.lit(test_cap).alias("test_cap"), F.lit(",".join(str(i) for i in range(seeds))).alias("evaluation_seeds"),
    )
    if expected is not None:
        found = out.count()
        if found != expected:
            raise RuntimeError(f"{found} classification tasks where {expected} were announced")
    return out

