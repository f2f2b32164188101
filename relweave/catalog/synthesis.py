"""Feature synthesis over the key graph: dfs and its building blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.catalog.base import Tables, query, testdata_dataset
from relweave.operators import aggregates as agg
from relweave.plans.dfs import CustomAgg, synthesize

CUT = "TIMESTAMP '1998-01-01'"
SPARK_CUT = "timestamp_ntz '1998-01-01 00:00:00'"


@query(
    "dfs",
    f"""
    WITH task AS (SELECT c_custkey, c_nationkey, {CUT} AS cutoff FROM customer),
    o AS (SELECT * FROM orders WHERE o_orderdate < {CUT}),
    li AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_shipdate < {CUT} GROUP BY 1),
    agg AS (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS mean_price, max(n) AS max_lines
            FROM o LEFT JOIN li ON l_orderkey = o_orderkey GROUP BY 1),
    m AS (SELECT o_custkey, o_orderpriority FROM (
            SELECT o_custkey, o_orderpriority,
                   row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn
            FROM o GROUP BY 1, 2) WHERE rn = 1),
    sk AS (SELECT o_custkey, count(l.l_orderkey) AS n_lines, avg(l_quantity) AS mean_qty
           FROM o LEFT JOIN (SELECT * FROM lineitem WHERE l_shipdate < {CUT}) l ON l.l_orderkey = o.o_orderkey
           GROUP BY 1)
    SELECT t.c_custkey, t.c_nationkey, t.cutoff, n_name AS nation_n_name,
           coalesce(n_orders, 0) AS "COUNT_orders", round(mean_price, 6) AS "MEAN_orders_o_totalprice",
           m.o_orderpriority AS "MODE_orders_o_orderpriority", max_lines AS "MAX_orders_COUNT_lineitem",
           coalesce(n_lines, 0) AS "COUNT_lineitem", round(mean_qty, 6) AS "MEAN_lineitem_l_quantity"
    FROM task t LEFT JOIN nation ON n_nationkey = t.c_nationkey
    LEFT JOIN agg a ON a.o_custkey = t.c_custkey LEFT JOIN m ON m.o_custkey = t.c_custkey
    LEFT JOIN sk ON sk.o_custkey = t.c_custkey
    """,
)
def dfs(t: Tables):
    ds = testdata_dataset(t.spark, t.sf_dir, ["nation", "customer", "orders", "lineitem"])
    task = t.customer.select("c_custkey", "c_nationkey", F.expr(SPARK_CUT).alias("cutoff"))
    out = synthesize(
        ds, task, "customer", ["c_custkey", "c_nationkey"], depth=2, primitives=("max", "mean", "count", "mode"),
        cutoff="cutoff",
        features=["nation.n_name", "COUNT(orders)", "MEAN(orders.o_totalprice)", "MODE(orders.o_orderpriority)",
                  "MAX(orders.COUNT(lineitem))", "COUNT(lineitem)", "MEAN(lineitem.l_quantity)"],
    )
    return out.withColumns({
        "MEAN_orders_o_totalprice": F.round("MEAN_orders_o_totalprice", 6),
        "MEAN_lineitem_l_quantity": F.round("MEAN_lineitem_l_quantity", 6),
    })


@query(
    "dfs_per_row_cutoff",
    """
    WITH task AS (SELECT o_orderkey AS row_id, o_custkey AS c_custkey, o_orderdate AS cutoff FROM orders),
    p AS (SELECT DISTINCT c_custkey, cutoff FROM task),
    a AS (SELECT p.c_custkey, p.cutoff, count(o.o_orderkey) AS n, max(o.o_totalprice) AS mx
          FROM p LEFT JOIN orders o ON o.o_custkey = p.c_custkey AND o.o_orderdate < p.cutoff GROUP BY 1, 2),
    li AS (SELECT o.o_orderkey, p.cutoff, count(*) AS n
           FROM p JOIN orders o ON o.o_custkey = p.c_custkey AND o.o_orderdate < p.cutoff
           JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_shipdate < p.cutoff GROUP BY 1, 2),
    s AS (SELECT p.c_custkey, p.cutoff, max(li.n) AS mxl
          FROM p JOIN orders o ON o.o_custkey = p.c_custkey AND o.o_orderdate < p.cutoff
          JOIN li ON li.o_orderkey = o.o_orderkey AND li.cutoff = p.cutoff GROUP BY 1, 2)
    SELECT t.row_id, t.c_custkey, t.cutoff, c.c_acctbal AS customer_c_acctbal, n.n_name AS customer_nation_n_name,
           coalesce(a.n, 0) AS "customer_COUNT_orders", a.mx AS "customer_MAX_orders_o_totalprice",
           s.mxl AS "customer_MAX_orders_COUNT_lineitem"
    FROM task t JOIN customer c USING (c_custkey) JOIN nation n ON n_nationkey = c_nationkey
    LEFT JOIN a USING (c_custkey, cutoff) LEFT JOIN s USING (c_custkey, cutoff)
    """,
)
def dfs_per_row_cutoff(t: Tables):
    ds = testdata_dataset(t.spark, t.sf_dir, ["nation", "customer", "orders", "lineitem"])
    task = t.orders.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("cutoff")
    )
    return synthesize(
        ds, task, "customer", ["c_custkey"], depth=3, primitives=("max", "count"), cutoff="cutoff",
        features=["customer.c_acctbal", "customer.nation.n_name", "customer.COUNT(orders)",
                  "customer.MAX(orders.o_totalprice)", "customer.MAX(orders.COUNT(lineitem))"],
    )


@query(
    "dfs_stacked_agg",
    """
    WITH li AS (SELECT l_orderkey, count(*) AS n, avg(l_quantity) AS q FROM lineitem GROUP BY 1),
    o AS (SELECT o_custkey, max(n) AS mx, avg(q) AS mq FROM orders LEFT JOIN li ON l_orderkey = o_orderkey GROUP BY 1),
    r AS (SELECT c_nationkey, avg(c_acctbal) AS bal, avg(mx) AS mmx
          FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1)
    SELECT n_nationkey, round(bal, 5) AS "MEAN_customer_c_acctbal",
           round(mmx, 6) AS "MEAN_customer_MAX_orders_COUNT_lineitem",
           round((SELECT max(mq) FROM o JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey), 6)
             AS "MAX_customer_MEAN_orders_MEAN_lineitem_l_quantity"
    FROM nation LEFT JOIN r ON c_nationkey = n_nationkey
    """,
)
def dfs_stacked_agg(t: Tables):
    ds = testdata_dataset(t.spark, t.sf_dir, ["nation", "customer", "orders", "lineitem"])
    out = synthesize(
        ds, t.nation.select("n_nationkey"), "nation", ["n_nationkey"], depth=3, primitives=("max", "mean", "count"),
        features=["MEAN(customer.c_acctbal)", "MEAN(customer.MAX(orders.COUNT(lineitem)))",
                  "MAX(customer.MEAN(orders.MEAN(lineitem.l_quantity)))"],
    )
    return out.select(
        "n_nationkey",
        F.round("MEAN_customer_c_acctbal", 5).alias("MEAN_customer_c_acctbal"),
        F.round("MEAN_customer_MAX_orders_COUNT_lineitem", 6).alias("MEAN_customer_MAX_orders_COUNT_lineitem"),
        F.round("MAX_customer_MEAN_orders_MEAN_lineitem_l_quantity", 6)
        .alias("MAX_customer_MEAN_orders_MEAN_lineitem_l_quantity"),
    )


def _simple(kind: str, sql_fn: str, value: str):
    @query(
        f"dfs_agg_{kind}",
        f"""SELECT c_custkey, {sql_fn} AS feature FROM customer
            LEFT JOIN (SELECT user_id, {value} AS v, count(*) AS n FROM events GROUP BY 1) e ON user_id = c_custkey""",
    )
    def run(t: Tables):
        ds = testdata_dataset(t.spark, t.sf_dir, ["customer", "events"])
        name = "COUNT(events)" if kind == "count" else f"{kind.upper()}(events.value)"
        out = synthesize(ds, t.customer.select("c_custkey"), "customer", ["c_custkey"], 1, (kind,), features=[name])
        feature = F.col(out.columns[-1])
        return out.select("c_custkey", (F.round(feature, 6) if kind == "mean" else feature).alias("feature"))


_simple("max", "v", "max(value)")
_simple("min", "v", "min(value)")
_simple("mean", "round(v, 6)", "avg(value)")
_simple("count", "coalesce(n, 0)", "1")


@query(
    "dfs_agg_mode",
    """
    WITH k AS (SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_shipdate) AS rn FROM k)
    SELECT l_suppkey, l_shipdate AS mode_shipdate, n FROM r WHERE rn = 1
    """,
)
def dfs_agg_mode(t: Tables):
    return agg.mode_by(t.lineitem, ["l_suppkey"], "l_shipdate").select(
        "l_suppkey", F.col("value").alias("mode_shipdate"), "n"
    )


@query(
    "dfs_agg_join",
    """WITH r AS (SELECT conv_id, turn, role, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 4 AS part
                  FROM conversations WHERE text IS NOT NULL)
       SELECT conv_id, part::BIGINT AS part, string_agg(text, chr(10) ORDER BY turn, role, text) AS text FROM r GROUP BY ALL""",
)
def dfs_agg_join(t: Tables):
    """The join of each group as numbered chunks of four rows, so that no cell grows with its group."""
    return agg.join_text(t.conversations, ["conv_id"], "text", ["turn", "role", "text"], chunk=4, parts=True)


@query(
    "dfs_agg_join_whole",
    """SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id""",
)
def dfs_agg_join_whole(t: Tables):
    """One cell per group, where a user wants that."""
    return agg.join_text(t.conversations, ["conv_id"], "text", ["turn", "role", "text"])


@query(
    "dfs_agg_concat",
    """
    WITH r AS (SELECT conv_id, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1) // 4 AS part
               FROM conversations WHERE text IS NOT NULL),
    k AS (SELECT conv_id, part, turn, text, unnest(string_split(text, ' ')) AS tok, generate_subscripts(string_split(text, ' '), 1) AS pos FROM r)
    SELECT conv_id, part::BIGINT AS part, count(*) AS n_tokens, list(tok ORDER BY turn, text, pos) AS tokens FROM k GROUP BY ALL
    """,
)
def dfs_agg_concat(t: Tables):
    tok = t.conversations.withColumn("tokens", F.split("text", " "))
    out = agg.concat_tokens(tok, ["conv_id"], "tokens", ["turn", "text"], chunk=4, parts=True)
    return out.select("conv_id", "part", F.size("tokens").cast("long").alias("n_tokens"), "tokens")


@query(
    "dfs_agg_concat_whole",
    """
    WITH k AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS tok,
                      generate_subscripts(string_split(text, ' '), 1) AS pos FROM conversations)
    SELECT conv_id, count(*) AS n_tokens, list(tok ORDER BY turn, pos) AS tokens FROM k GROUP BY conv_id
    """,
)
def dfs_agg_concat_whole(t: Tables):
    tok = t.conversations.withColumn("tokens", F.split("text", " "))
    out = agg.concat_tokens(tok, ["conv_id"], "tokens", ["turn"])
    return out.select("conv_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens")


_VEC = """
    WITH e AS (SELECT label, CASE WHEN embedding[1] < -0.15 THEN NULL ELSE embedding END AS v FROM embeddings),
    n AS (SELECT label, count(*) AS n_all, count(v) AS n_vec FROM e GROUP BY 1),
    x AS (SELECT label, unnest(v)::DOUBLE AS x, generate_subscripts(v, 1) AS pos FROM e WHERE v IS NOT NULL),
    g AS (SELECT label, pos, max(x) AS mx, min(x) AS mn, sum(x) AS sm FROM x GROUP BY 1, 2)
    SELECT n.label, CASE WHEN n_vec > 0 THEN list(round(CASE WHEN n_vec < n_all THEN {nul} ELSE {val} END, 6) ORDER BY pos) END AS vec
    FROM n LEFT JOIN g ON g.label = n.label GROUP BY n.label, n_vec, n_all
"""


def _vector(kind: str, val: str, nul: str):
    @query(f"dfs_agg_{kind}", _VEC.format(val=val, nul=nul))
    def run(t: Tables):
        e = t.embeddings.select(
            "label", F.when(F.col("embedding")[0] < -0.15, None).otherwise(F.col("embedding")).alias("v")
        )
        out = agg.vector_by(e, ["label"], "v", kind)
        return out.select("label", F.transform("v", lambda x: F.round(x, 6)).alias("vec"))


_vector("arraymax", "mx", "greatest(mx, 0)")
_vector("arraymin", "mn", "least(mn, 0)")
_vector("arraymean", "sm / n_all", "sm / n_all")


@query(
    "custom_agg",
    """
    SELECT c_custkey, round(v, 4) AS "RANGE_orders_o_totalprice",
           coalesce(n, 0) AS "COUNT_orders" FROM customer
    LEFT JOIN (SELECT o_custkey, max(o_totalprice) - min(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1) o
      ON o_custkey = c_custkey
    """,
)
def custom_agg(t: Tables):
    ds = testdata_dataset(t.spark, t.sf_dir, ["customer", "orders"])
    spread = CustomAgg("range", "float", lambda c: F.max(c) - F.min(c))
    out = synthesize(
        ds, t.customer.select("c_custkey"), "customer", ["c_custkey"], 1, (spread, "count"),
        features=["RANGE(orders.o_totalprice)", "COUNT(orders)"],
    )
    return out.withColumn("RANGE_orders_o_totalprice", F.round("RANGE_orders_o_totalprice", 4))
