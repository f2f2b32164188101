"""Join operators over the key graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.catalog.base import ORACLE, Tables, query, testdata_dataset
from relweave.model import ColumnMeta, RelationalDataset, TableMeta
from relweave.operators import joins as J
from relweave.plans.pointintime import Spec

CUT = "TIMESTAMP '1998-01-01'"


@query(
    "direct_feature",
    """SELECT o_orderkey, o_custkey, c_mktsegment AS customer_mktsegment, c_acctbal AS customer_acctbal
       FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def direct_feature(t: Tables):
    return J.direct_feature(
        t.orders.select("o_orderkey", "o_custkey"), t.customer, "o_custkey", "c_custkey",
        {"c_mktsegment": "customer_mktsegment", "c_acctbal": "customer_acctbal"},
    )


@query(
    "backward_join_agg",
    """SELECT o_orderkey, coalesce(n, 0) AS n_lines, mx AS max_price, mn AS min_qty, round(av, 6) AS mean_qty
       FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_extendedprice) AS mx, min(l_quantity) AS mn,
                              avg(l_quantity) AS av FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def backward_join_agg(t: Tables):
    return J.backward_aggregate(
        t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey",
        {"n_lines": F.count(F.lit(1)), "max_price": F.max("l_extendedprice"), "min_qty": F.min("l_quantity"),
         "mean_qty": F.round(F.avg("l_quantity"), 6)},
        counts=["n_lines"],
    )


@query(
    "skip_backward_join",
    """SELECT c_custkey, coalesce(n, 0) AS n_lines, mx AS max_price FROM customer LEFT JOIN (
         SELECT o_custkey, count(l_orderkey) AS n, max(l_extendedprice) AS mx
         FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey""",
)
def skip_backward_join(t: Tables):
    return J.skip_backward_aggregate(
        t.customer.select("c_custkey"), "c_custkey", t.orders, "o_custkey", "o_orderkey", t.lineitem, "l_orderkey",
        {"n_lines": F.count("__m"), "max_price": F.max("l_extendedprice")}, counts=["n_lines"],
    )


def _user_pairs(t: Tables):
    """(customer, cutoff) for every order: the cutoffs differ per row."""
    return J.cutoff_pairs(t.orders.select("o_custkey", F.col("o_orderdate").alias("cutoff")), "o_custkey", "cutoff")


@query(
    "asof_cutoff_join",
    """SELECT p.o_custkey, p.cutoff, o.o_orderkey, o.o_totalprice
       FROM (SELECT DISTINCT o_custkey, o_orderdate AS cutoff FROM orders) p
       LEFT JOIN orders o ON o.o_custkey = p.o_custkey AND o.o_orderdate < p.cutoff""",
)
def asof_cutoff_join(t: Tables):
    """Every row before each cutoff: as many as pairs of a cutoff and an earlier row."""
    return J.asof_join(
        _user_pairs(t), t.orders, "o_custkey", "cutoff", "o_custkey", "o_orderdate", ["o_orderkey", "o_totalprice"]
    )


@query(
    "asof_cutoff_aggregate",
    """SELECT p.o_custkey, p.cutoff, count(o.o_orderkey) AS n_before, round(avg(o.o_totalprice), 6) AS mean_price,
              max(o.o_totalprice) AS max_price, min(o.o_totalprice) AS min_price
       FROM (SELECT DISTINCT o_custkey, o_orderdate AS cutoff FROM orders) p
       LEFT JOIN orders o ON o.o_custkey = p.o_custkey AND o.o_orderdate < p.cutoff GROUP BY 1, 2""",
)
def asof_cutoff_aggregate(t: Tables):
    out = J.asof_aggregate(
        _user_pairs(t), t.orders, "o_custkey", "cutoff", "o_custkey", "o_orderdate",
        [Spec("n_before", "count", "o_orderkey"), Spec("mean_price", "mean", "o_totalprice"),
         Spec("max_price", "max", "o_totalprice"), Spec("min_price", "min", "o_totalprice")], counts=["n_before"])
    return out.withColumn("mean_price", F.round("mean_price", 6))


@query("asof_cutoff_rows", ORACLE["asof_cutoff_join"])
def asof_cutoff_rows(t: Tables):
    """The same rows under their second name."""
    return asof_cutoff_join(t)


@query(
    "cutoff_propagation",
    """WITH p AS (SELECT DISTINCT o_custkey, o_orderdate AS cutoff FROM orders),
       d1 AS (SELECT o.o_orderkey, p.cutoff FROM p LEFT JOIN orders o
              ON o.o_custkey = p.o_custkey AND o.o_orderdate < p.cutoff),
       d2 AS (SELECT l.l_partkey, d1.cutoff FROM d1 LEFT JOIN lineitem l
              ON l.l_orderkey = d1.o_orderkey AND l.l_shipdate < d1.cutoff)
       SELECT DISTINCT p_partkey, cutoff FROM d2 LEFT JOIN part ON p_partkey = l_partkey""",
)
def cutoff_propagation(t: Tables):
    return J.reach(_user_pairs(t), "o_custkey", "cutoff", [
        (t.orders, "o_custkey", "o_orderkey", "o_orderdate"), (t.lineitem, "l_orderkey", "l_partkey", "l_shipdate"),
        (t.part, "p_partkey", "p_partkey", None)], "p_partkey")


@query(
    "cutoff_visibility",
    """WITH p AS (SELECT DISTINCT o_orderstatus AS k, date_trunc('month', o_orderdate)::TIMESTAMP AS cutoff FROM orders)
       SELECT DISTINCT o.o_custkey, p.cutoff FROM p LEFT JOIN orders o ON o.o_orderstatus = p.k AND o.o_orderdate < p.cutoff""",
)
def cutoff_visibility(t: Tables):
    """Three keys with every month as a cutoff: a hop keeps each node once per key."""
    months = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("cutoff")
    pairs = J.cutoff_pairs(t.orders.select(F.col("o_orderstatus").alias("k"), months), "k", "cutoff")
    return J.reach(pairs, "k", "cutoff", [(t.orders, "o_orderstatus", "o_custkey", "o_orderdate")], "o_custkey")


@query(
    "cutoff_feature_join",
    """WITH p AS (SELECT DISTINCT o_custkey, o_orderdate AS cutoff FROM orders),
       f AS (SELECT p.o_custkey, p.cutoff, count(o.o_orderkey) AS n_before FROM p LEFT JOIN orders o
             ON o.o_custkey = p.o_custkey AND o.o_orderdate < p.cutoff GROUP BY 1, 2)
       SELECT o_orderkey, o_orderdate AS cutoff, n_before FROM orders
       LEFT JOIN f ON f.o_custkey = orders.o_custkey AND f.cutoff = orders.o_orderdate""",
)
def cutoff_feature_join(t: Tables):
    f = J.asof_aggregate(_user_pairs(t), t.orders, "o_custkey", "cutoff", "o_custkey", "o_orderdate",
                         [Spec("n_before", "count", "o_orderkey")], counts=["n_before"])
    rows = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("cutoff"))
    return J.cutoff_feature_join(rows, f, "o_custkey", "cutoff", "o_custkey", "cutoff", ["n_before"]).drop("o_custkey")


@query(
    "merge_features",
    """SELECT c_custkey, n_name, n_orders, n_events FROM customer
       LEFT JOIN nation ON n_nationkey = c_nationkey
       LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey
       LEFT JOIN (SELECT user_id, count(*) AS n_events FROM events GROUP BY 1) ON user_id = c_custkey""",
)
def merge_features(t: Tables):
    task = t.customer.select("c_custkey")
    names = J.direct_feature(t.customer, t.nation, "c_nationkey", "n_nationkey", {"n_name": "n_name"})
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    events = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_events"))
    return J.merge_features(task, "c_custkey", [names.select("c_custkey", "n_name"), orders, events])


_SELF = "CASE WHEN p_partkey > 0 THEN p_partkey - 1 END"


@query(
    "selfloop_split",
    f"""SELECT 'part_selfloop' AS table_name, {_SELF} AS parent_partkey, p_partkey, NULL AS p_name FROM part
        UNION ALL SELECT 'part', NULL, p_partkey, p_name FROM part""",
)
def selfloop_split(t: Tables):
    part = t.part.select(
        "p_partkey", "p_name", F.when(F.col("p_partkey") > 0, F.col("p_partkey") - 1).alias("parent_partkey")
    )
    ds = RelationalDataset("d", {"part": part}, {"part": TableMeta("part", (
        ColumnMeta("p_partkey", "primary_key"), ColumnMeta("p_name", "text"),
        ColumnMeta("parent_partkey", "foreign_key", "part.p_partkey")))})
    ds = J.selfloop_tables(ds, "part")
    edges = ds.tables["part_selfloop"].withColumn("table_name", F.lit("part_selfloop"))
    base = ds.tables["part"].withColumn("table_name", F.lit("part"))
    return edges.unionByName(base, allowMissingColumns=True).select(
        "table_name", "parent_partkey", "p_partkey", "p_name")


@query(
    "extra_task_fk",
    f"""SELECT c_custkey, {CUT} AS cutoff, coalesce(n, 0) AS "COUNT_orders" FROM customer
        LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate < {CUT} GROUP BY 1)
        ON o_custkey = c_custkey""",
)
def extra_task_fk(t: Tables):
    from relweave.plans.dfs import synthesize

    ds = testdata_dataset(t.spark, t.sf_dir, ["customer", "orders"])
    task = t.customer.select("c_custkey", F.expr("timestamp_ntz '1998-01-01 00:00:00'").alias("cutoff"))
    # the child table meets the task rows through the key it shares with the target table
    return synthesize(ds, task, "customer", ["c_custkey"], 1, ("count",), "cutoff", features=["COUNT(orders)"])


@query(
    "dup_pk_as_fk",
    """WITH task AS (SELECT c_custkey, TIMESTAMP '1997-01-01' AS cutoff FROM customer
                     UNION ALL SELECT c_custkey, TIMESTAMP '1999-01-01' FROM customer)
       SELECT t.c_custkey, t.cutoff, c.c_mktsegment AS customer_c_mktsegment,
              (SELECT count(*) FROM orders o WHERE o.o_custkey = t.c_custkey AND o.o_orderdate < t.cutoff)
                AS "customer_COUNT_orders"
       FROM task t LEFT JOIN customer c ON c.c_custkey = t.c_custkey""",
)
def dup_pk_as_fk(t: Tables):
    from relweave.plans.dfs import synthesize

    ds = testdata_dataset(t.spark, t.sf_dir, ["customer", "orders"])
    first = t.customer.select("c_custkey", F.expr("timestamp_ntz '1997-01-01 00:00:00'").alias("cutoff"))
    second = t.customer.select("c_custkey", F.expr("timestamp_ntz '1999-01-01 00:00:00'").alias("cutoff"))
    return synthesize(ds, first.unionByName(second), "customer", ["c_custkey"], 2, ("count",), "cutoff",
                      features=["customer.c_mktsegment", "customer.COUNT(orders)"])


@query(
    "ensure_parent",
    """SELECT DISTINCT user_id FROM (SELECT user_id FROM events UNION ALL SELECT o_custkey FROM orders)
       WHERE user_id IS NOT NULL""",
)
def ensure_parent(t: Tables):
    return J.ensure_parent([(t.events, "user_id"), (t.orders, "o_custkey")], "user_id")


@query(
    "join_related_features",
    """WITH o AS (SELECT o_custkey, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders GROUP BY 1),
       l AS (SELECT o_custkey, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
       SELECT c_custkey, n_name AS nation_n_name, round(o.m, 6) AS orders_mean, round(o.s, 5) AS orders_std,
              round(l.m, 6) AS lineitem_mean, round(l.s, 6) AS lineitem_std
       FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
       LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey""",
)
def join_related_features(t: Tables):
    ds = testdata_dataset(t.spark, t.sf_dir, ["nation", "customer", "orders", "lineitem"])
    out = J.join_related(ds, "customer", ["nation", "orders", "lineitem"],
                         {"nation": ["n_name"], "orders": ["o_totalprice"], "lineitem": ["l_quantity"]})
    return out.select(
        "c_custkey", "nation_n_name",
        F.round("orders_o_totalprice_mean", 6).alias("orders_mean"),
        F.round("orders_o_totalprice_std", 5).alias("orders_std"),
        F.round("lineitem_l_quantity_mean", 6).alias("lineitem_mean"),
        F.round("lineitem_l_quantity_std", 6).alias("lineitem_std"),
    )


@query(
    "bridge_join",
    """SELECT c_custkey, round(m, 6) AS price_mean, round(s, 4) AS price_std FROM customer LEFT JOIN (
         SELECT o_custkey, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s
         FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) ON o_custkey = c_custkey""",
)
def bridge_join(t: Tables):
    out = J.bridge_join(t.customer.select("c_custkey"), "c_custkey", t.orders, "o_custkey", "o_orderkey",
                        t.lineitem, "l_orderkey", {"l_extendedprice": "price"})
    return out.select("c_custkey", F.round("price_mean", 6).alias("price_mean"), F.round("price_std", 4).alias("price_std"))


@query(
    "fk_path_walk",
    """SELECT r_regionkey AS focal_pk, l_partkey, count(*) AS n
       FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey
       LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2""",
)
def fk_path_walk(t: Tables):
    ds = testdata_dataset(t.spark, t.sf_dir, ["region", "nation", "supplier", "lineitem"])
    walk = J.walk_keys(ds, "region", "lineitem", ["l_partkey"])
    return walk.groupBy("focal_pk", "l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "terminal_lookup",
    """SELECT c_custkey AS focal_pk, o_orderkey AS terminal_pk, o_orderpriority, o_totalprice
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey""",
)
def terminal_lookup(t: Tables):
    ds = testdata_dataset(t.spark, t.sf_dir, ["customer", "orders"])
    return J.terminal_lookup(J.walk_keys(ds, "customer", "orders"), t.orders, "o_orderkey",
                             ["o_orderpriority", "o_totalprice"])


@query(
    "fk_semi_filter",
    """WITH c AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'),
       p AS (SELECT * FROM part WHERE p_type = 'ECONOMY'),
       o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
       SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
       WHERE l_orderkey IN (SELECT o_orderkey FROM o) AND l_partkey IN (SELECT p_partkey FROM p)""",
)
def fk_semi_filter(t: Tables):
    ds = testdata_dataset(t.spark, t.sf_dir, ["customer", "part", "orders", "lineitem"])
    kept = J.fk_semi_filter(
        ds,
        {"customer": t.customer.filter("c_mktsegment = 'BUILDING'"), "part": t.part.filter("p_type = 'ECONOMY'")},
        ["customer", "part", "orders", "lineitem"],
    )
    return kept["lineitem"].select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")


@query(
    "parent_entity_ids",
    """WITH f AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS fk FROM events),
       p AS (SELECT c_custkey AS ri, c_nationkey::BIGINT AS e FROM customer WHERE c_acctbal >= 0)
       SELECT event_id, fk, coalesce(e, -1) AS parent_entity FROM f LEFT JOIN p ON ri = fk""",
)
def parent_entity_ids(t: Tables):
    rows = t.events.select("event_id", F.when(F.col("event_type") == "error", None).otherwise(F.col("user_id")).alias("fk"))
    parent = t.customer.filter("c_acctbal >= 0")
    return J.parent_entity_ids(rows, "fk", parent, "c_custkey", "c_nationkey", "parent_entity")


def score_tables(t: Tables):
    """Two result sets (dataset, task, seed, metric_value) measured on the given tables."""
    def side(value):
        rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        return rows.groupBy(
            F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("task"),
            F.year("o_orderdate").alias("seed"),
        ).agg(value.alias("metric_value"))

    left = side(F.avg((F.col("o_orderstatus") == "F").cast("double")))
    right = side(F.avg((F.col("o_orderstatus") == "O").cast("double")))
    return left, right


SCORES = """
    base AS (SELECT c_mktsegment AS dataset, o_orderpriority AS task, year(o_orderdate)::INTEGER AS seed, o_orderstatus AS st
             FROM orders JOIN customer ON o_custkey = c_custkey),
    lhs AS (SELECT dataset, task, seed, avg((st = 'F')::INTEGER) AS metric_value FROM base GROUP BY ALL),
    rhs AS (SELECT dataset, task, seed, avg((st = 'O')::INTEGER) AS metric_value FROM base GROUP BY ALL)
"""


@query(
    "paired_compare_join",
    f"""WITH {SCORES} SELECT dataset, task, seed, round(l.metric_value, 8) AS metric_value_left,
        round(r.metric_value, 8) AS metric_value_right FROM lhs l JOIN rhs r USING (dataset, task, seed)""",
)
def paired_compare_join(t: Tables):
    left, right = score_tables(t)
    out = J.paired_join(left, right, ["dataset", "task", "seed"], "metric_value")
    return out.withColumns({c: F.round(c, 8) for c in ("metric_value_left", "metric_value_right")})


@query(
    "anti_positive",
    """WITH neg AS (SELECT o_custkey AS user_key, l_suppkey AS item FROM orders JOIN lineitem
                    ON l_orderkey = o_orderkey + 1),
       pos AS (SELECT DISTINCT o_custkey AS user_key, l_suppkey AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
       SELECT * FROM neg n WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.user_key = n.user_key AND p.item = n.item)""",
)
def anti_positive(t: Tables):
    o, l = t.orders, t.lineitem
    neg = o.join(l, F.col("l_orderkey") == F.col("o_orderkey") + 1)
    pos = o.join(l, F.col("l_orderkey") == F.col("o_orderkey"))
    cols = [F.col("o_custkey").alias("user_key"), F.col("l_suppkey").alias("item")]
    return J.drop_false_negatives(neg.select(*cols), pos.select(*cols).distinct(), ["user_key", "item"])
