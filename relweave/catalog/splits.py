"""Order, splits, samples, negatives and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.catalog.base import Tables, query
from relweave.catalog.sources import split_orders
from relweave.operators import joins as J, splits as P
from relweave.plans.ordering import top_per_group

H = "('0x' || substr(md5({0}), 1, 15))::BIGINT"


def h(*parts: str) -> str:
    """The stable hash in SQL."""
    return H.format(" || '|' || ".join(parts))


@query(
    "query_idx",
    """SELECT event_id, event_type, user_id, dense_rank() OVER (ORDER BY event_type, user_id) - 1 AS query_idx FROM events""",
)
def query_idx(t: Tables):
    return P.query_index(t.events.select("event_id", "event_type", "user_id"), ["event_id"])


_RATIO = """CASE WHEN rn <= floor(n * {a}) THEN 'train' WHEN rn <= floor(n * {a}) + floor(n * {b}) THEN 'validation' ELSE 'test' END"""


@query(
    "ratio_split",
    f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
        SELECT o_orderkey, {_RATIO.format(a=0.8, b=0.1)} AS split FROM r""",
)
def ratio_split(t: Tables):
    return P.ratio_split(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "shuffled_split",
    f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {h("'s1'", 'o_orderkey')}, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
        SELECT o_orderkey, {_RATIO.format(a=0.75, b=0.05)} AS split FROM r""",
)
def shuffled_split(t: Tables):
    return P.shuffled_split(t.orders.select("o_orderkey"), ["o_orderkey"], 0.75, 0.05, "s1")


@query(
    "rank_codes",
    """WITH c AS (SELECT p_brand AS v, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS code FROM part WHERE p_size <= 40 GROUP BY 1)
       SELECT p_partkey, code FROM part LEFT JOIN c ON v = CASE WHEN p_size <= 40 THEN p_brand END""",
)
def rank_codes(t: Tables):
    part = t.part.select("p_partkey", F.when(F.col("p_size") <= 40, F.col("p_brand")).alias("b"))
    return P.rank_codes(part, "b", "code", 100).drop("b")


@query(
    "topk_per_task",
    """WITH s AS (SELECT o_orderpriority AS dataset, o_orderstatus AS task, o_custkey AS feature, sum(o_totalprice::DECIMAL(20,2))::DOUBLE AS importance
                  FROM orders GROUP BY ALL),
       r AS (SELECT *, row_number() OVER (PARTITION BY dataset, task ORDER BY importance DESC, feature) AS rn FROM s)
       SELECT dataset, task, feature, rn FROM r WHERE rn <= 5""",
)
def topk_per_task(t: Tables):
    s = t.orders.groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("task"),
                         F.col("o_custkey").alias("feature")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("importance"))
    return top_per_group(s, ["dataset", "task"], [F.col("importance").desc(), F.col("feature")], 5).drop("importance")


@query(
    "retrieval_rank",
    """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders""",
)
def retrieval_rank(t: Tables):
    from relweave.operators.metrics import candidate_ranks

    return candidate_ranks(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice",
                           "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query(
    "tail_temporal",
    """WITH r AS (SELECT epoch_us(ts) AS x, row_number() OVER (ORDER BY ts) - 1 AS i, (1 - 2500.0 / count(*) OVER ()) * (count(*) OVER () - 1) AS pos FROM events),
       q AS (SELECT max(x) FILTER (i = floor(pos)) AS lo, max(x) FILTER (i = ceil(pos)) AS hi, max(pos - floor(pos)) AS w FROM r)
       SELECT event_id, ts FROM events, q WHERE epoch_us(ts) > lo + (hi - lo) * w""",
)
def tail_temporal(t: Tables):
    return P.tail_temporal(t.events.select("event_id", "ts"), "ts", 2500)


@query("stable_task_order", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey")
def stable_task_order(t: Tables):
    return P.stable_order(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")


@query(
    "capped_rows",
    f"""SELECT o_orderkey, o_totalprice FROM orders ORDER BY {h("'cap'", 'o_orderkey')}, o_orderkey LIMIT 500""",
)
def capped_rows(t: Tables):
    return P.capped_rows(t.orders.select("o_orderkey", "o_totalprice"), 500, ["o_orderkey"], "cap")


@query(
    "focal_sample",
    f"""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) AS ri FROM customer)
        SELECT i AS draw, c_custkey, c_mktsegment FROM range(400) d(i)
        JOIN r ON ri = {h("'3'", 'i')} % (SELECT count(*) FROM customer) + 1""",
)
def focal_sample(t: Tables):
    return P.focal_sample(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", 400, 3)


@query(
    "union_splits",
    """SELECT CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'validation'
              ELSE 'test' END AS split, o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN o_orderstatus END AS o_orderstatus FROM orders""",
)
def union_splits(t: Tables):
    from relweave.sources.writers import task_table

    rows = split_orders(t).select("o_orderkey", "o_orderstatus", "split")
    parts = {s: rows.filter(F.col("split") == s).drop("split") for s in ("train", "validation")}
    parts["test"] = rows.filter("split = 'test'").select("o_orderkey")  # no label column
    return task_table(parts)


@query(
    "union_key_domain",
    "SELECT c_custkey AS key FROM customer UNION SELECT o_custkey FROM orders UNION SELECT user_id FROM events",
)
def union_key_domain(t: Tables):
    return P.union_key_domain([(t.customer, "c_custkey"), (t.orders, "o_custkey"), (t.events, "user_id")])


@query(
    "distinct_forward",
    """SELECT DISTINCT c_nationkey, o_orderdate AS cutoff FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def distinct_forward(t: Tables):
    pairs = t.orders.select("o_custkey", F.col("o_orderdate").alias("cutoff"))
    return J.propagate_cutoff(pairs, t.customer, "o_custkey", "cutoff", "c_custkey", ["c_nationkey"], None, forward=True)


def result_rows(t: Tables, value):
    """(model, dataset, task, seed, metric_value) measured on the given tables."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("o_orderstatus").alias("model"), F.col("c_mktsegment").alias("dataset"),
        F.col("o_orderpriority").alias("task"), F.year("o_orderdate").alias("seed"),
    ).agg(value.alias("metric_value"))


RESULTS = """
    res AS (SELECT o_orderstatus AS model, c_mktsegment AS dataset, o_orderpriority AS task, year(o_orderdate)::INTEGER AS seed,
                   max(o_totalprice) AS metric_value, min(o_totalprice) AS low, count(*) AS n
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
"""


@query(
    "upsert_results",
    f"""WITH {RESULTS} SELECT model, dataset, task, seed, CASE WHEN seed >= 1999 THEN low ELSE metric_value END AS metric_value,
        CASE WHEN seed >= 1999 THEN n END AS n FROM res""",
)
def upsert_results(t: Tables):
    old = result_rows(t, F.max("o_totalprice"))
    new = result_rows(t, F.min("o_totalprice")).filter("seed >= 1999")
    n = result_rows(t, F.count(F.lit(1))).withColumnRenamed("metric_value", "n")
    keys = ["model", "dataset", "task", "seed"]
    return P.upsert([old, new.join(n, keys)], keys)


@query(
    "common_ids",
    """SELECT c_custkey, CASE WHEN c_custkey IN (SELECT user_id FROM events) THEN 'complete' ELSE 'missing' END AS status FROM customer""",
)
def common_ids(t: Tables):
    return P.common_ids(t.customer, t.events.select(F.col("user_id").alias("c_custkey")), "c_custkey")


@query(
    "temporal_split",
    """WITH d AS (SELECT DISTINCT epoch_us(o_orderdate) AS t FROM orders),
       q AS (SELECT quantile_cont(t, 0.8) AS a, quantile_cont(t, 0.9) AS b FROM d)
       SELECT o_orderkey, CASE WHEN epoch_us(o_orderdate) <= a THEN 'train' WHEN epoch_us(o_orderdate) <= b THEN 'validation' ELSE 'test' END AS split
       FROM orders, q""",
)
def temporal_split(t: Tables):
    return P.temporal_split(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query(
    "column_split",
    """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'train' ELSE 'validation' END AS split
       FROM lineitem WHERE l_returnflag <> 'R'""",
)
def column_split(t: Tables):
    li = t.lineitem.withColumn("part", F.when(F.col("l_returnflag") == "A", "train").when(
        F.col("l_returnflag") == "N", "valid").otherwise("other"))
    return P.column_split(li, "part").select("l_orderkey", "l_linenumber", "split")


@query("global_cutoff", "SELECT event_id, max(ts) OVER () AS cutoff FROM events")
def global_cutoff(t: Tables):
    return P.global_cutoff(t.events.select("event_id", "ts"), "ts", "cutoff").drop("ts")


_SPLIT3 = """CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'validation' ELSE 'test' END"""


@query(
    "split_cutoff",
    f"""WITH s AS (SELECT *, {_SPLIT3} AS split FROM orders)
        SELECT o_orderkey, split, (SELECT max(o_orderdate) FROM s b WHERE b.split = CASE WHEN s.split = 'test' THEN 'validation' ELSE 'train' END) AS cutoff FROM s""",
)
def split_cutoff(t: Tables):
    return P.split_cutoff(split_orders(t), "o_orderdate", "cutoff").select("o_orderkey", "split", "cutoff")


def _clicks(t: Tables):
    return t.events.select(F.col("user_id").alias("u"), F.col("event_type").alias("ty"), F.floor("value").alias("item")).distinct()


@query(
    "eval_negatives",
    f"""WITH r AS (SELECT DISTINCT user_id AS u, event_type AS ty, floor(value)::BIGINT AS item FROM events),
        p AS (SELECT item, row_number() OVER (ORDER BY u, ty, item) AS ri FROM r),
        d AS (SELECT u, ty, {h("'7n'", 'u', 'ty', 'item', 'k')} % (SELECT count(*) FROM r) + 1 AS want FROM r, range(1, 4) s(k)),
        n AS (SELECT DISTINCT u, ty, p.item FROM d JOIN p ON ri = want),
        b AS (SELECT u, ty, item, 1 AS label FROM r UNION ALL SELECT u, ty, item, 0 FROM n WHERE (u, ty, item) NOT IN (SELECT (u, ty, item) FROM r))
        SELECT *, dense_rank() OVER (ORDER BY u, ty) - 1 AS query_idx FROM b""",
)
def eval_negatives(t: Tables):
    rows = _clicks(t)
    return P.eval_negatives(rows, rows, "item", 3, 7)


@query(
    "batch_negatives",
    f"""WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS q FROM orders)
        SELECT o_orderkey, o_custkey, q AS query_idx, 1 AS label, 0 AS copy FROM r
        UNION ALL SELECT o_orderkey, {h("('1t' || c)", 'o_orderkey')} % 1500, q, 0, c::INTEGER FROM r, range(1, 3) s(c)""",
)
def batch_negatives(t: Tables):
    return P.batch_negatives(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 1500, 2, 1)


@query(
    "entity_cluster_sample",
    f"""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 2),
        k AS (SELECT greatest(1, 700 // greatest(2, floor(median(n))::BIGINT)) AS k FROM c),
        e AS (SELECT o_custkey FROM (SELECT o_custkey, row_number() OVER (ORDER BY {h("'0'", 'o_custkey')}, o_custkey) AS rn FROM c), k WHERE rn <= k)
        SELECT o_orderkey, o_custkey, 0 AS copy FROM orders
        ORDER BY CASE WHEN o_custkey IN (SELECT o_custkey FROM e) THEN 0 ELSE 1 END, {h("'0'", 'o_orderkey')}, o_orderkey LIMIT 700""",
)
def entity_cluster_sample(t: Tables):
    return P.entity_cluster_sample(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"], 700)


@query(
    "aligned_downsample",
    f"""SELECT event_id AS x, event_id + 100 AS y, event_id + 200 AS fk, event_id + 300 AS entity, NULL::BIGINT AS parent
        FROM events ORDER BY {h("'a'", 'event_id')}, event_id LIMIT 1000""",
)
def aligned_downsample(t: Tables):
    e = F.col("event_id")
    rows = t.events.select(e.alias("x"), (e + 100).alias("y"), (e + 200).alias("fk"), (e + 300).alias("entity"),
                           F.lit(None).cast("long").alias("parent"))
    return P.capped_rows(rows, 1000, ["x"], "a")


@query(
    "seeded_eval_sample",
    f"""WITH s AS (SELECT o_orderkey, c_mktsegment AS d, o_orderpriority AS tk, {_SPLIT3} AS split,
                     CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS x
                   FROM orders JOIN customer ON o_custkey = c_custkey),
        r AS (SELECT *, row_number() OVER (PARTITION BY d, tk, split ORDER BY
                {h("''", "(d || ':' || tk || ':' || CASE WHEN split = 'train' THEN '4' ELSE 'test' END)", 'o_orderkey')}, o_orderkey) AS rn
              FROM s WHERE split <> 'validation'),
        k AS (SELECT * FROM r WHERE rn <= CASE WHEN split = 'train' THEN 64 ELSE 20 END),
        m AS (SELECT d, tk, median(x) AS m FROM k WHERE split = 'train' GROUP BY ALL)
        SELECT o_orderkey, k.d AS dataset, k.tk AS task, split, round(coalesce(x, m, 0), 6) AS x FROM k LEFT JOIN m ON m.d = k.d AND m.tk = k.tk""",
)
def seeded_eval_sample(t: Tables):
    rows = split_orders(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("task"), "split",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("x"))
    out = P.seeded_eval_sample(rows, "dataset", "task", ["o_orderkey"], ["x"], 64, 20, seed=4)
    return out.withColumn("x", F.round("x", 6))


@query(
    "stratified_split",
    f"""WITH r AS (SELECT o_orderkey, o_orderstatus, {h("'f'", 'o_orderkey')} AS h, count(*) OVER (PARTITION BY o_orderstatus) AS n,
                     row_number() OVER (PARTITION BY o_orderstatus ORDER BY {h("'f'", 'o_orderkey')}, o_orderkey) AS rn FROM orders),
        s AS (SELECT *, CASE WHEN rn <= round(n * 0.3) THEN 'test' ELSE 'train' END AS split FROM r)
        SELECT o_orderkey, o_orderstatus, split FROM s""",
)
def stratified_split(t: Tables):
    return P.stratified_split(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"], 0.3, "f")


@query(
    "stratified_exact",
    f"""WITH c AS (SELECT o_orderpriority AS y, count(*) AS n, count(*) * 1024.0::DOUBLE / (SELECT count(*) FROM orders) AS raw FROM orders GROUP BY 1),
        short AS (SELECT 1024 - sum(floor(raw)) AS k FROM c),
        q AS (SELECT y, floor(raw) + (row_number() OVER (ORDER BY raw - floor(raw) DESC, y) <= (SELECT k FROM short))::INT AS quota FROM c),
        r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {h("'0'", "'0'", 'o_orderkey')}, o_orderkey) AS rn FROM orders)
        SELECT o_orderkey, o_orderpriority, 0 AS set_id FROM r JOIN q ON y = o_orderpriority WHERE rn <= quota""",
)
def stratified_exact(t: Tables):
    return P.stratified_exact(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"])


@query(
    "ovr_labels",
    """SELECT o_orderkey, c AS class, (o_orderstatus = c)::INT AS ovr_label FROM orders, (SELECT DISTINCT o_orderstatus AS c FROM orders)""",
)
def ovr_labels(t: Tables):
    return P.ovr_labels(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus").drop("o_orderstatus")


@query(
    "mixture_sample",
    f"""WITH s AS (SELECT i AS step, CASE WHEN {h("'2'", 'i')} / 1152921504606846976.0 < 0.5 THEN 'customer'
                     WHEN {h("'2'", 'i')} / 1152921504606846976.0 < 0.8 THEN 'supplier' ELSE 'part' END AS source FROM range(5000) r(i)),
        n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY step) - 1 AS k FROM s),
        p AS (SELECT 'customer' AS source, c_custkey AS row_key, row_number() OVER (ORDER BY c_custkey) - 1 AS rn, count(*) OVER () AS sz FROM customer
              UNION ALL SELECT 'supplier', s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1, count(*) OVER () FROM supplier
              UNION ALL SELECT 'part', p_partkey, row_number() OVER (ORDER BY p_partkey) - 1, count(*) OVER () FROM part)
        SELECT step, n.source, row_key FROM n JOIN p ON p.source = n.source AND rn = k % sz""",
)
def mixture_sample(t: Tables):
    return P.mixture_sample({
        "customer": (t.customer, "c_custkey", 5.0), "supplier": (t.supplier, "s_suppkey", 3.0), "part": (t.part, "p_partkey", 2.0),
    }, 5000, 2)


@query(
    "corrupt_labels",
    f"""WITH a AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders),
        b AS (SELECT o_orderstatus, row_number() OVER (ORDER BY {h("'0'", 'o_orderkey')}, o_orderkey) AS rn FROM orders)
        SELECT o_orderkey, o_totalprice, o_orderstatus FROM a JOIN b USING (rn)""",
)
def corrupt_labels(t: Tables):
    return P.corrupt_labels(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])


@query(
    "corrupt_features",
    f"""WITH a AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events),
        b AS (SELECT value, row_number() OVER (ORDER BY {h("'0:value'", 'event_id')}, event_id) AS rn FROM events),
        c AS (SELECT event_type, row_number() OVER (ORDER BY {h("'0:event_type'", 'event_id')}, event_id) AS rn FROM events)
        SELECT event_id, value, event_type FROM a JOIN b USING (rn) JOIN c USING (rn)""",
)
def corrupt_features(t: Tables):
    return P.corrupt_features(t.events.select("event_id", "value", "event_type"), ["value", "event_type"], ["event_id"])


