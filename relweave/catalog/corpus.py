"""Task blocks of a training corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.catalog.base import Tables, query
from relweave.catalog.sources import _SPLIT_SQL, split_orders
from relweave.catalog.splits import h
from relweave.operators import corpus as B


def order_block(t: Tables, total: int = 600):
    rows = split_orders(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_custkey", "o_totalprice", "c_acctbal", "o_orderpriority", "o_orderstatus", "c_nationkey", "split")
    parents = {"o_custkey": t.customer.select(F.col("c_custkey").alias("row_index"), F.col("c_nationkey").alias("entity_id"))}
    return B.task_block(
        rows, "testdata", "status", ["o_totalprice", "c_acctbal"], ["o_orderpriority"], "o_orderstatus", ["o_orderkey"],
        "o_custkey", ["o_custkey"], parents, total, 5)


@query(
    "task_block",
    f"""WITH b AS (SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice, c_acctbal, o_orderpriority, o_orderstatus, c_nationkey, {_SPLIT_SQL} AS split
                     FROM orders JOIN customer ON o_custkey = c_custkey) WHERE split IN ('train', 'test')),
        m AS (SELECT avg(o_totalprice) AS mp, avg(c_acctbal) AS mb, count(DISTINCT o_orderpriority) AS np FROM b WHERE split = 'train'),
        cd AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM b WHERE split = 'train')),
        cl AS (SELECT c, row_number() OVER (ORDER BY {h("'0'", "c")}, c) <= greatest(1, count(*) OVER () // 2) AS low, c = max(c) OVER () AS top, count(*) OVER () AS n
               FROM (SELECT DISTINCT o_orderstatus AS c FROM b)),
        y AS (SELECT b.*, {h("'0'", "o_orderkey")} AS hk, (CASE WHEN n = 2 THEN top ELSE low END)::INT AS y0 FROM b JOIN cl ON c = o_orderstatus),
        z AS (SELECT *, CASE WHEN min(y0) OVER (PARTITION BY split) = max(y0) OVER (PARTITION BY split)
                              AND row_number() OVER (PARTITION BY split ORDER BY hk, o_orderkey) = 1 THEN 1 - y0 ELSE y0 END AS y FROM y),
        e AS (SELECT o_custkey, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= 2),
        k AS (SELECT greatest(1, 600 // greatest(2, floor(median(n))::BIGINT)) AS k FROM e),
        ch AS (SELECT o_custkey FROM (SELECT o_custkey, row_number() OVER (ORDER BY {h("'0'", "o_custkey")}, o_custkey) AS rn FROM e), k WHERE rn <= k),
        p AS (SELECT * FROM z ORDER BY CASE WHEN o_custkey IN (SELECT o_custkey FROM ch) THEN 0 ELSE 1 END, hk, o_orderkey LIMIT 600),
        u AS (SELECT {h("'0'", "'testdata'", "'status'")} / 1152921504606846976.0 AS u)
        SELECT 'testdata' AS dataset, 'status' AS task, (row_number() OVER (ORDER BY {h("'0o'", "o_orderkey", "0")}, o_orderkey) - 1)::INTEGER AS row,
               list_transform([coalesce(o_totalprice, mp)::FLOAT, coalesce(c_acctbal, mb)::FLOAT, coalesce(code, np)::FLOAT, 0, 0], lambda x: round(x::DOUBLE, 2)) AS X, y,
               3 AS num_features, greatest(1, least(599, round((0.3 + u * 0.5) * 600)))::INTEGER AS single_eval_pos, [o_custkey] AS fk_values, o_custkey AS entity_id,
               [c_nationkey::BIGINT] AS parent_entity_ids
        FROM p LEFT JOIN cd ON v = o_orderpriority, m, u""",
)
def task_block(t: Tables):
    return order_block(t).withColumn("X", F.transform("X", lambda x: F.round(x.cast("double"), 2)))


@query(
    "dense_pad",
    """SELECT vec_id, list_concat(embedding[1:1 + label], list_transform(range(10 - len(embedding[1:1 + label])), lambda x: 0.0::FLOAT)) AS x FROM embeddings""",
)
def dense_pad(t: Tables):
    ragged = t.embeddings.select("vec_id", F.slice("embedding", F.lit(1), F.col("label") + 1).alias("x"))
    return ragged.select("vec_id", B.dense_pad("x", 10).alias("x"))


@query(
    "block_extract",
    """WITH b AS (SELECT doc_id, n_chars::FLOAT AS a, length(source)::FLOAT AS b, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS row FROM documents),
       tk AS (SELECT lang, count(*) FILTER (row >= 50) AS tests FROM b GROUP BY 1),
       p AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS rn FROM tk WHERE tests >= 10)
       SELECT 'docs' AS dataset, lang AS task, row::INTEGER AS row, a AS feat_0, b AS cat_1, (a > 500)::INT AS target,
              CASE WHEN row < 50 THEN 'train' ELSE 'test' END AS split FROM b SEMI JOIN (SELECT lang FROM p WHERE rn % 2 = 0) q USING (lang)""",
)
def block_extract(t: Tables):
    from relweave.plans.ordering import numbered

    docs = numbered(t.documents.select("doc_id", "lang", "n_chars", "source"), ["doc_id"], ["lang"], "rn")
    blocks = docs.select(
        F.lit("docs").alias("dataset"), F.col("lang").alias("task"), (F.col("rn") - 1).cast("int").alias("row"),
        F.array(F.col("n_chars").cast("float"), F.length("source").cast("float")).alias("X"),
        (F.col("n_chars") > 500).cast("int").alias("y"), F.lit(50).alias("single_eval_pos"))
    return B.block_extract(blocks, 2, categorical=[1], every=2, min_test_rows=10)
