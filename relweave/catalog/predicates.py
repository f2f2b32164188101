"""Projections, predicates and column filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.catalog.base import Tables, query, testdata_dataset
from relweave.operators import predicates as P
from relweave.operators.joins import backward_aggregate
from relweave.operators.transforms import distinct_with_null
from relweave.plans.dfs import synthesize
from relweave.sources.readers import describe_columns


@query("project_alias", "SELECT l_orderkey AS join_key, l_extendedprice AS feature FROM lineitem")
def project_alias(t: Tables):
    return P.project_alias(t.lineitem, "l_orderkey", "l_extendedprice", "join_key", "feature")


@query(
    "coalesce_count_zero",
    """SELECT c_custkey, coalesce(n, 0) AS n_events, m AS max_value FROM customer
       LEFT JOIN (SELECT user_id, count(*) AS n, max(value) AS m FROM events GROUP BY 1) ON user_id = c_custkey""",
)
def coalesce_count_zero(t: Tables):
    return backward_aggregate(t.customer.select("c_custkey"), t.events, "c_custkey", "user_id",
                              {"n_events": F.count(F.lit(1)), "max_value": F.max("value")}, counts=["n_events"])


@query(
    "drop_constant_columns",
    """WITH o AS (SELECT *, 1 AS k, NULL::INTEGER AS z, CASE WHEN o_orderstatus = 'F' THEN 1 END AS part FROM orders),
       s AS (SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) + max((o_orderstatus IS NULL)::INT) AS n FROM o
         UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice) + max((o_totalprice IS NULL)::INT) FROM o
         UNION ALL SELECT 'k', count(DISTINCT k) + max((k IS NULL)::INT) FROM o
         UNION ALL SELECT 'z', count(DISTINCT z) + max((z IS NULL)::INT) FROM o
         UNION ALL SELECT 'part', count(DISTINCT part) + max((part IS NULL)::INT) FROM o)
       SELECT "column", n <= 1 AS dropped FROM s""",
)
def drop_constant_columns(t: Tables):
    o = t.orders.withColumns({
        "k": F.lit(1), "z": F.lit(None).cast("int"), "part": F.when(F.col("o_orderstatus") == "F", 1)})
    counts = distinct_with_null(o, ["o_orderstatus", "o_totalprice", "k", "z", "part"])
    return t.spark.createDataFrame([(c, n <= 1) for c, n in counts.items()], "column string, dropped boolean")


@query(
    "unique_feature_filter",
    """WITH s AS (SELECT 'l_linenumber' AS "column", count(DISTINCT l_linenumber) AS n_values FROM lineitem
         UNION ALL SELECT 'l_discount', count(DISTINCT l_discount) FROM lineitem
         UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice) FROM lineitem
         UNION ALL SELECT 'k', count(DISTINCT 1) FROM lineitem)
       SELECT "column", n_values, n_values > 7 AS keep FROM s""",
)
def unique_feature_filter(t: Tables):
    return P.unique_feature_filter(t.lineitem.withColumn("k", F.lit(1)),
                                   ["l_linenumber", "l_discount", "l_extendedprice", "k"], 7)


@query(
    "validate_constant_fraction",
    """WITH s AS (SELECT 'customer' AS table_name, 3 AS checked_columns,
           ((min(c_acctbal) = max(c_acctbal))::INT + (min(c_mktsegment) = max(c_mktsegment))::INT + 1) AS constant_columns
         FROM customer
         UNION ALL SELECT 'part', 2, (min(p_size) = max(p_size))::INT + (min(p_retailprice) = max(p_retailprice))::INT FROM part
         UNION ALL SELECT 'events', 2, 2 FROM events HAVING count(*) > 0)
       SELECT *, constant_columns / checked_columns AS constant_fraction,
              constant_columns / checked_columns <= 0.5 AS is_valid,
              min((constant_columns / checked_columns <= 0.5)::INT) OVER () = 1 AS database_valid FROM s""",
)
def validate_constant_fraction(t: Tables):
    return P.constant_fraction({
        "customer": (t.customer.withColumn("k", F.lit(3.0)), ["c_acctbal", "c_mktsegment", "k"]),
        "part": (t.part, ["p_size", "p_retailprice"]),
        "events": (t.events.withColumns({"a": F.lit(float("nan")), "b": F.lit(1.0)}), ["a", "b"]),
    })


@query(
    "predicate_label",
    """SELECT o_orderkey, (o_totalprice > 250000)::INT AS is_large, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS is_hot,
              (o_orderstatus <> 'F')::INT AS is_open FROM orders""",
)
def predicate_label(t: Tables):
    return t.orders.select(
        "o_orderkey", P.predicate_label("o_totalprice", ">", 250000).alias("is_large"),
        P.predicate_label("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]).alias("is_hot"),
        P.predicate_label("o_orderstatus", "!=", "F").alias("is_open"))


@query(
    "node_filter",
    """SELECT p_partkey, p_brand, p_size FROM part WHERE p_size >= 10 AND p_size < 30
       AND p_brand NOT IN ('Brand#1', 'Brand#2')""",
)
def node_filter(t: Tables):
    sized = P.node_filter(t.part, {"p_size": {"operator": ">=", "value": 10},
                                   "p_brand": {"operator": "not_in", "value": ["Brand#1", "Brand#2"]}})
    return P.node_filter(sized, {"p_size": {"operator": "<", "value": 30}}).select("p_partkey", "p_brand", "p_size")


_LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    "select_features",
    """WITH u AS (UNPIVOT (SELECT l_returnflag AS dataset, l_linestatus AS task, l_quantity, l_extendedprice, l_discount, l_tax,
                           l_linenumber::DOUBLE AS l_linenumber FROM lineitem)
                  ON l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber INTO NAME feature VALUE v),
       s AS (SELECT dataset, task, feature, stddev_pop(v) AS importance FROM u GROUP BY ALL),
       best AS (SELECT *, row_number() OVER (PARTITION BY dataset, task ORDER BY importance DESC, feature) AS rn
                FROM s WHERE dataset <> 'N'),
       rest AS (SELECT *, row_number() OVER (PARTITION BY dataset, task ORDER BY
                  ('0x' || substr(md5('0|' || dataset || '|' || task || '|' || feature), 1, 15))::BIGINT, feature) AS rn
                FROM s WHERE dataset = 'N')
       SELECT dataset, task, feature FROM best WHERE rn <= 2 UNION ALL SELECT dataset, task, feature FROM rest WHERE rn <= 3""",
)
def select_features(t: Tables):
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in _LINE_FEATURES])
    long = t.lineitem.select(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("task"), F.inline(items))
    stats = long.groupBy("dataset", "task", "feature").agg(F.stddev_pop("v").alias("importance"))
    return P.select_features(stats.select("dataset", "task", "feature"), 3, stats.filter("dataset <> 'N'"), 2)


@query(
    "classify_dfs_columns",
    """WITH e AS (SELECT user_id, count(*) AS n, max(value) AS m FROM events GROUP BY 1),
       f AS (SELECT c.*, n_name, coalesce(n, 0) AS n, m, c_acctbal IS NOT NULL AS b FROM customer c
             LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN e ON user_id = c_custkey)
       SELECT 'c_mktsegment' AS "column", count(c_mktsegment) AS present, 'native' AS kind, NULL AS via FROM f
       UNION ALL SELECT 'nation.n_name', count(n_name), 'joined', 'nation' FROM f
       UNION ALL SELECT 'COUNT(events)', count(n), 'aggregate', 'events' FROM f
       UNION ALL SELECT 'MAX(events.value)', count(m), 'aggregate', 'events' FROM f
       UNION ALL SELECT 'customer_id', count(c_custkey), 'other', NULL FROM f""",
)
def classify_dfs_columns(t: Tables):
    ds = testdata_dataset(t.spark, t.sf_dir, ["nation", "customer", "events"])
    task = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    wide = synthesize(ds, task, "customer", ["c_custkey", "c_nationkey"], 1, ("max", "count"),
                      features=["nation.n_name", "COUNT(events)", "MAX(events.value)"], name=str)
    wide = wide.withColumnRenamed("c_custkey", "customer_id").drop("c_nationkey")
    return P.classify_columns(describe_columns(wide), target="customer").select("column", "present", "kind", "via")


@query(
    "dominant_ratio_filter",
    """WITH u AS (UNPIVOT (SELECT l_returnflag AS dataset, l_quantity, round(l_discount, 1) AS disc,
                           CASE WHEN l_tax > 0.01 THEN 0.0 ELSE l_tax END AS tax FROM lineitem)
                  ON l_quantity, disc, tax INTO NAME "column" VALUE v),
       g AS (SELECT dataset, "column", v, count(*) AS n FROM u GROUP BY ALL),
       f AS (SELECT *, CASE WHEN v - lag(v) OVER w > 1e-6 OR lag(v) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM g
             WINDOW w AS (PARTITION BY dataset, "column" ORDER BY v)),
       r AS (SELECT *, sum(nw) OVER (PARTITION BY dataset, "column" ORDER BY v) AS run FROM f),
       z AS (SELECT dataset, "column", run, sum(n) AS n FROM r GROUP BY ALL),
       q AS (SELECT dataset, "column", max(n) / sum(n) AS ratio FROM z GROUP BY ALL)
       SELECT dataset, count(*) FILTER (ratio >= 0.5) AS flagged,
              round(count(*) FILTER (ratio >= 0.5) / 3.0 * 3 * 1.5, 6) AS expected,
              count(*) FILTER (ratio >= 0.5) / 3.0 * 3 * 1.5 <= 2.0 AS keep FROM q GROUP BY 1""",
)
def dominant_ratio_filter(t: Tables):
    li = t.lineitem.select(
        F.col("l_returnflag").alias("dataset"), "l_quantity", F.round("l_discount", 1).alias("disc"),
        F.when(F.col("l_tax") > 0.01, 0.0).otherwise(F.col("l_tax")).alias("tax"))
    ratios = P.dominant_ratio(li, ["dataset"], ["l_quantity", "disc", "tax"], 1e-6)
    out = P.repetitive_filter(ratios, ["dataset"], 3, 10, 0.5, 2.0, 1.5)
    return out.withColumn("expected", F.round("expected", 6))


