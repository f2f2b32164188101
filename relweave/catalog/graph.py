"""Graph tables and neighbour sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.catalog.base import Tables, query, testdata_dataset
from relweave.functions.scalar import epoch_micros
from relweave.model import ColumnMeta, RelationalDataset, TableMeta, TaskMeta
from relweave.operators import graph as G


def shop(t: Tables) -> RelationalDataset:
    """nation, supplier, part and the two-key table of who supplies what, -1 for missing keys."""
    ds = testdata_dataset(t.spark, t.sf_dir, ["nation", "supplier", "part"])
    supply = t.lineitem.select(
        F.col("l_partkey").alias("part_id"),
        F.when(F.col("l_quantity") > 45, -1).otherwise(F.col("l_suppkey")).alias("supp_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("day"))
    return ds.with_table(TableMeta("supply", (
        ColumnMeta("part_id", "foreign_key", "part.p_partkey"), ColumnMeta("supp_id", "foreign_key", "supplier.s_suppkey"),
        ColumnMeta("quantity", "float"), ColumnMeta("day", "datetime")), "day"), supply)


@query(
    "build_nodes",
    """SELECT 'nation' AS node_type, n_nationkey::BIGINT AS node, n_name AS label, NULL::DOUBLE AS amount FROM nation
       UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, p_retailprice FROM part""",
)
def build_nodes(t: Tables):
    nodes = G.build_nodes(shop(t))
    shown = {"nation": ("n_name", None), "supplier": ("s_name", "s_acctbal"), "part": ("p_name", "p_retailprice")}
    parts = [nodes[n].select(F.lit(n).alias("node_type"), "node", F.col(a).alias("label"), (F.col(b) if b else F.lit(None)).cast("double").alias("amount"))
             for n, (a, b) in shown.items() if set(nodes) == set(shown)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "node_counts",
    """SELECT 'nation' AS node_type, count(*) AS n FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier
       UNION ALL SELECT 'part', count(*) FROM part""",
)
def node_counts(t: Tables):
    return G.node_counts(G.build_nodes(shop(t)))


_SUPPLY = """s AS (SELECT l_partkey AS p, l_suppkey AS q, l_quantity AS quantity, epoch_us(l_shipdate) * 1000 AS ts FROM lineitem WHERE l_quantity <= 45)"""


@query(
    "build_edges",
    f"""WITH {_SUPPLY} SELECT 'supplier:supplier-s_nationkey:nation' AS etype, 'supplier' AS src_type, s_suppkey AS src, 'nation' AS dst_type, s_nationkey::BIGINT AS dst FROM supplier
        UNION ALL SELECT 'nation:reverse_supplier-s_nationkey:supplier', 'nation', s_nationkey, 'supplier', s_suppkey FROM supplier
        UNION ALL SELECT 'part:supply:supplier', 'part', p, 'supplier', q FROM s
        UNION ALL SELECT 'supplier:reverse_supply:part', 'supplier', q, 'part', p FROM s""",
)
def build_edges(t: Tables):
    return G.build_edges(shop(t))


@query(
    "edge_features",
    f"""WITH {_SUPPLY} SELECT 'part:supply:supplier' AS etype, 'part' AS src_type, p AS src, 'supplier' AS dst_type, q AS dst, ts, quantity, 'supply' AS group_id FROM s
        UNION ALL SELECT 'supplier:reverse_supply:part', 'supplier', q, 'part', p, ts, quantity, 'supply' FROM s""",
)
def edge_features(t: Tables):
    return G.edge_features(shop(t), "supply")


@query(
    "graph_task",
    """SELECT 'node' AS kind, 'orders' AS seed_type, o_orderkey AS seed, o_orderstatus AS label, epoch_us(o_orderdate) * 1000 AS seed_ts, o_custkey FROM orders""",
)
def graph_task(t: Tables):
    ds = testdata_dataset(t.spark, t.sf_dir, ["customer", "orders"])
    task = TaskMeta("status", "orders", "o_orderstatus", ("o_orderkey", "o_custkey"), "o_orderdate")
    return G.graph_task(ds, task, t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"))


def order_graph(t: Tables):
    """(edges, order times, customer nodes) of nations, customers and orders."""
    ds = testdata_dataset(t.spark, t.sf_dir, ["nation", "customer", "orders"])
    edges = G.build_edges(ds)
    times = t.orders.select(F.lit("orders").alias("node_type"), F.col("o_orderkey").alias("node"), epoch_micros("o_orderdate").alias("ts"))
    seeds = t.customer.select(F.lit("customer").alias("node_type"), F.col("c_custkey").alias("node"), "c_mktsegment")
    return edges, times, seeds


_GRAPH = """
    e AS (SELECT 'orders:orders-o_custkey:customer' AS etype, 'orders' AS st, o_orderkey AS src, 'customer' AS dt, o_custkey AS dst FROM orders
          UNION ALL SELECT 'customer:reverse_orders-o_custkey:orders', 'customer', o_custkey, 'orders', o_orderkey FROM orders
          UNION ALL SELECT 'customer:customer-c_nationkey:nation', 'customer', c_custkey, 'nation', c_nationkey::BIGINT FROM customer
          UNION ALL SELECT 'nation:reverse_customer-c_nationkey:customer', 'nation', c_nationkey::BIGINT, 'customer', c_custkey FROM customer)
"""


_FANOUT = """row_number() OVER (PARTITION BY etype, dst ORDER BY ('0x' || substr(md5('0:{hop}|' || etype || '|' || src || '|' || dst), 1, 15))::BIGINT, src)"""


@query(
    "neighbor_sample_global",
    f"""WITH {_GRAPH}, tm AS (SELECT o_orderkey AS n, o_orderdate < TIMESTAMP '1998-01-01' OR o_orderdate = TIMESTAMP '1998-01-01' AS ok FROM orders),
        s AS (SELECT 'customer' AS ty, c_custkey AS n FROM customer),
        h0 AS (SELECT * FROM (SELECT e.*, {_FANOUT.format(hop=0)} AS rn FROM e JOIN s ON s.ty = dt AND s.n = dst) WHERE rn <= 10
               AND (st <> 'orders' OR src IN (SELECT n FROM tm WHERE ok)) AND (dt <> 'orders' OR dst IN (SELECT n FROM tm WHERE ok))),
        f AS (SELECT * FROM s UNION SELECT st, src FROM h0),
        h1 AS (SELECT * FROM (SELECT e.*, {_FANOUT.format(hop=1)} AS rn FROM e JOIN f ON f.ty = dt AND f.n = dst) WHERE rn <= 5
               AND (st <> 'orders' OR src IN (SELECT n FROM tm WHERE ok)) AND (dt <> 'orders' OR dst IN (SELECT n FROM tm WHERE ok)))
        SELECT 0 AS hop, etype, st AS src_type, src, dt AS dst_type, dst FROM h0
        UNION ALL SELECT 1, etype, st, src, dt, dst FROM h1""",
)
def neighbor_sample_global(t: Tables):
    edges, times, seeds = order_graph(t)
    out = G.neighbor_sample(edges, times, seeds, [5, 10], threshold=883612800000000)  # 1998-01-01
    return out.drop("eid")


_TIMED = """row_number() OVER (PARTITION BY etype, et.dst, {s}.ts ORDER BY
             ('0x' || substr(md5('0:{hop}|' || etype || '|' || src || '|' || et.dst), 1, 15))::BIGINT, src)"""


@query(
    "neighbor_sample_temporal",
    f"""WITH {_GRAPH}, s AS (SELECT DISTINCT 'customer' AS ty, o_custkey AS n, epoch_us(o_orderdate) AS ts FROM orders),
        tm AS (SELECT 'orders' AS ty, o_orderkey AS n, epoch_us(o_orderdate) AS ts FROM orders),
        et AS (SELECT e.*, tm.ts AS ets FROM e LEFT JOIN tm ON tm.ty = st AND tm.n = src),
        h0 AS (SELECT * FROM (SELECT etype, st, src, dt, et.dst, s.ts AS seed_ts, {_TIMED.format(s="s", hop=0)} AS rn
               FROM et JOIN s ON s.ty = dt AND s.n = et.dst WHERE ets IS NULL OR ets <= s.ts) WHERE rn <= 4),
        f AS (SELECT ty, n, ts FROM s UNION SELECT st, src, seed_ts FROM h0),
        h1 AS (SELECT * FROM (SELECT etype, st, src, dt, et.dst, f.ts AS seed_ts, {_TIMED.format(s="f", hop=1)} AS rn
               FROM et JOIN f ON f.ty = dt AND f.n = et.dst WHERE ets IS NULL OR ets <= f.ts) WHERE rn <= 2)
        SELECT 0 AS hop, etype, st AS src_type, src, dt AS dst_type, dst, seed_ts FROM h0
        UNION ALL SELECT 1, etype, st, src, dt, dst, seed_ts FROM h1""",
)
def neighbor_sample_temporal(t: Tables):
    edges, times, _ = order_graph(t)
    seeds = t.orders.select(
        F.lit("customer").alias("node_type"), F.col("o_custkey").alias("node"), epoch_micros("o_orderdate").alias("seed_ts"))
    return G.neighbor_sample_temporal(edges, times, seeds, [2, 4]).drop("eid")


@query(
    "khop_subgraph",
    f"""WITH {_GRAPH}, s AS (SELECT 'customer' AS ty, c_custkey AS n FROM customer WHERE c_mktsegment = 'BUILDING'),
        h0 AS (SELECT st AS ty, src AS n FROM e SEMI JOIN s ON s.ty = dt AND s.n = dst),
        f AS (SELECT * FROM s UNION SELECT * FROM h0)
        SELECT etype, src, dst FROM e SEMI JOIN f a ON a.ty = st AND a.n = src SEMI JOIN f b ON b.ty = dt AND b.n = dst
        WHERE etype <> 'customer:customer-c_nationkey:nation'""",
)
def khop_subgraph(t: Tables):
    edges, _, nodes = order_graph(t)
    seeds = nodes.filter("c_mktsegment = 'BUILDING'")  # the part of the graph around one segment
    edges = G.with_edge_id(edges)
    gone = edges.filter("etype = 'customer:customer-c_nationkey:nation'")
    return G.khop_subgraph(edges, None, seeds, [None], exclude=gone).select("etype", "src", "dst")
