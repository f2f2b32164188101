"""Labels by aggregation and structure analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.catalog.base import Tables, query, testdata_dataset
from relweave.operators import structure as A
from relweave.operators.joins import walk_keys


def rnd(df, columns, digits=6):
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


@query(
    "agg_label",
    """WITH w AS (SELECT o_custkey AS k, avg(l_extendedprice) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
       SELECT c_custkey, coalesce((v > (SELECT median(v) FROM w))::INT, 0) AS label FROM customer LEFT JOIN w ON k = c_custkey""",
)
def agg_label(t: Tables):
    ds = testdata_dataset(t.spark, t.sf_dir, ["customer", "orders", "lineitem"])
    walk = walk_keys(ds, "customer", "lineitem", ["l_extendedprice"])
    return A.agg_label(t.customer.select("c_custkey"), "c_custkey", walk, "l_extendedprice", "AVG")


@query(
    "direct_label",
    """SELECT n_nationkey, arg_min(s_acctbal, s_suppkey) AS label FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""",
)
def direct_label(t: Tables):
    ds = testdata_dataset(t.spark, t.sf_dir, ["nation", "supplier"])
    walk = walk_keys(ds, "nation", "supplier", ["s_acctbal"])
    return A.direct_label(t.nation.select("n_nationkey"), "n_nationkey", walk, "s_acctbal")


@query(
    "agg_apply",
    """SELECT c_custkey, coalesce(round(stddev_samp(value), 8), 0.0) AS value FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1""",
)
def agg_apply(t: Tables):
    rows = t.customer.join(t.events, F.col("user_id") == F.col("c_custkey"), "left")
    return rnd(A.agg_apply(rows, ["c_custkey"], "value", "STD"), ["value"], 8)


def fk_rates(t: Tables):
    """Null rates of three keys over corpora cut from the tables by a category."""
    o = t.orders.select(F.col("o_orderpriority").alias("db"), F.lit("orders").alias("table_name"),
                        F.when(F.col("o_totalprice") <= 400000, F.col("o_custkey")).alias("fk"))
    l = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("db"), F.lit("lineitem").alias("table_name"),
                          F.when(F.col("l_quantity") >= 10, F.col("l_partkey")).alias("fk"))
    e = t.events.select(F.col("event_type").alias("db"), F.lit("events").alias("table_name"),
                        F.when(F.col("value") >= 0.2, F.col("user_id")).alias("fk"))
    return A.fk_null_rate(o.unionByName(l).unionByName(e), ["db", "table_name"], "fk")


_RATES = """
    r AS (SELECT o_orderpriority AS db, 'orders' AS table_name, o_totalprice > 400000 AS isn FROM orders
          UNION ALL SELECT l_returnflag || l_linestatus, 'lineitem', l_quantity < 10 FROM lineitem
          UNION ALL SELECT event_type, 'events', value < 0.2 FROM events),
    q AS (SELECT db, table_name, sum(isn::INT)::BIGINT AS null_count, count(*) AS total_rows, sum(isn::INT) / count(*) AS null_rate
          FROM r GROUP BY ALL)
"""
_EDGES = [0.0, 0.01, 0.05, 0.10, 0.15, 0.20, 0.30, 0.50, 1.0]
_HIST = ", ".join(f"count(*) FILTER (null_rate >= {a} AND null_rate < {b}) AS bucket_{i}"
                  for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])))


@query(
    "fk_null_rate",
    f"""WITH {_RATES} SELECT count(*) AS relations, round(avg(null_rate), 8) AS mean, round(median(null_rate), 8) AS median,
        round(min(null_rate), 8) AS min, round(max(null_rate), 8) AS max, round(stddev_pop(null_rate), 8) AS std, {_HIST} FROM q""",
)
def fk_null_rate(t: Tables):
    return rnd(A.null_rate_summary(fk_rates(t)), ["mean", "median", "min", "max", "std"], 8)


@query(
    "top_n_sparsest",
    f"""WITH {_RATES} SELECT db, table_name, null_count, total_rows, round(null_rate, 8) AS null_rate FROM q
        ORDER BY q.null_rate DESC, db, table_name LIMIT 10""",
)
def top_n_sparsest(t: Tables):
    return rnd(A.top_sparsest(fk_rates(t), ["db", "table_name"]), ["null_rate"], 8)


@query(
    "entity_density",
    """WITH e AS (SELECT event_type AS task, CASE WHEN value < 1 THEN NULL ELSE user_id END AS e FROM events),
       p AS (SELECT task, e, count(*) AS n FROM e GROUP BY ALL)
       SELECT task, sum(n)::BIGINT AS n_rows, count(e) AS n_entities, min(n) FILTER (e IS NOT NULL) AS min_snapshots,
              round(avg(n) FILTER (e IS NOT NULL), 8) AS avg_snapshots, max(n) FILTER (e IS NOT NULL) AS max_snapshots,
              round(sum(n) FILTER (e IS NOT NULL) / sum(n), 8) AS coverage, round(1.0 / count(e), 8) AS pair_bound FROM p GROUP BY 1""",
)
def entity_density(t: Tables):
    rows = t.events.select(F.col("event_type").alias("task"), F.when(F.col("value") >= 1, F.col("user_id")).alias("e"))
    return rnd(A.entity_density(rows, ["task"], "e"), ["avg_snapshots", "coverage", "pair_bound"], 8)


@query(
    "effective_parent_coverage",
    """WITH c AS (SELECT user_id, count(*) AS n FROM events SEMI JOIN customer ON c_custkey = user_id GROUP BY 1),
       p AS (SELECT n / sum(n) OVER () AS p, n FROM c)
       SELECT sum(n)::BIGINT AS child_rows, (SELECT count(*) FROM customer) AS parents,
              round(exp(-sum(p * ln(p))) / (SELECT count(*) FROM customer), 9) AS coverage FROM p""",
)
def effective_parent_coverage(t: Tables):
    return rnd(A.effective_parent_coverage(t.events, "user_id", t.customer, "c_custkey"), ["coverage"], 9)


@query(
    "multi_parent_nmi",
    """WITH j AS (SELECT l_partkey AS x, l_suppkey AS y, count(*) AS n FROM lineitem GROUP BY ALL),
       t AS (SELECT sum(n)::DOUBLE AS n FROM j),
       x AS (SELECT -sum(n / t * ln(n / t)) AS h FROM (SELECT x, sum(n)::DOUBLE AS n FROM j GROUP BY 1), (SELECT n AS t FROM t)),
       y AS (SELECT -sum(n / t * ln(n / t)) AS h FROM (SELECT y, sum(n)::DOUBLE AS n FROM j GROUP BY 1), (SELECT n AS t FROM t)),
       xy AS (SELECT -sum(n / t * ln(n / t)) AS h FROM (SELECT n::DOUBLE AS n FROM j), (SELECT n AS t FROM t))
       SELECT round((x.h + y.h - xy.h) / ((x.h + y.h) / 2), 8) AS nmi FROM x, y, xy""",
)
def multi_parent_nmi(t: Tables):
    return rnd(A.multi_parent_nmi(t.lineitem, "l_partkey", "l_suppkey"), ["nmi"], 8)


def time_columns(t: Tables):
    """(name, ts) of every time column, lineitem cut by return flag."""
    o = t.orders.select(F.concat(F.lit("orders "), "o_orderstatus").alias("name"), F.col("o_orderdate").alias("ts"))
    l = t.lineitem.select(F.concat(F.lit("lineitem "), "l_returnflag").alias("name"), F.col("l_shipdate").alias("ts"))
    e = t.events.select(F.lit("events").alias("name"), "ts")  # after the axis ends: no curve
    return o.unionByName(l).unionByName(e)


_CURVES = """
    m AS (SELECT 'orders ' || o_orderstatus AS name, (year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS month FROM orders
          UNION ALL SELECT 'lineitem ' || l_returnflag, (year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1 FROM lineitem
          UNION ALL SELECT 'events', (year(ts) - 1970) * 12 + month(ts) - 1 FROM events),
    k AS (SELECT name, month, count(*) AS n FROM m GROUP BY ALL),
    x AS (SELECT min(month) AS lo, max(month) AS hi FROM k),
    s AS (SELECT name, sum(n) AS total FROM k GROUP BY 1
          HAVING sum(n) >= 2 AND (count(*) < (SELECT hi - lo + 1 FROM x) OR min(n) < max(n))),
    c AS (SELECT s.name, i::INTEGER AS month, coalesce(n, 0) / total AS share
          FROM s CROSS JOIN (SELECT unnest(range(lo, hi + 1)) AS i FROM x) r LEFT JOIN k ON k.name = s.name AND k.month = i)
"""


@query("monthly_activity", f"WITH {_CURVES} SELECT name, month, round(share, 9) AS share FROM c")
def monthly_activity(t: Tables):
    return rnd(A.monthly_activity(time_columns(t), "name", "ts"), ["share"], 9)


@query(
    "calendar_synchrony",
    f"""WITH {_CURVES} SELECT a.name AS a, b.name AS b, round(corr(a.share, b.share), 8) AS r
        FROM c a JOIN c b ON a.month = b.month AND a.name < b.name GROUP BY ALL""",
)
def calendar_synchrony(t: Tables):
    return rnd(A.calendar_synchrony(A.monthly_activity(time_columns(t), "name", "ts")), ["r"], 8)


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    "feature_variance_corr",
    """WITH v AS (SELECT l_returnflag AS f, unnest([var_samp(l_quantity), var_samp(l_extendedprice), var_samp(l_discount),
                    var_samp(l_tax), var_samp(l_linenumber)]) AS v FROM lineitem GROUP BY 1),
       r AS (SELECT l_returnflag AS f, unnest([corr(l_quantity, l_extendedprice), corr(l_quantity, l_discount), corr(l_quantity, l_tax),
               corr(l_quantity, l_linenumber), corr(l_extendedprice, l_discount), corr(l_extendedprice, l_tax),
               corr(l_extendedprice, l_linenumber), corr(l_discount, l_tax), corr(l_discount, l_linenumber),
               corr(l_tax, l_linenumber)]) AS r FROM lineitem GROUP BY 1)
       SELECT l_returnflag, 5 AS n_features, (SELECT round(median(v), 6) FROM v WHERE f = l_returnflag) AS feature_var_p50,
              (SELECT round(avg(v), 2) FROM v WHERE f = l_returnflag) AS feature_var_mean,
              (SELECT round(median(abs(r)), 8) FROM r WHERE f = l_returnflag) AS avg_abs_corr_p50,
              (SELECT round(avg(abs(r)), 8) FROM r WHERE f = l_returnflag) AS avg_abs_corr_mean
       FROM (SELECT DISTINCT l_returnflag FROM lineitem)""",
)
def feature_variance_corr(t: Tables):
    out = A.feature_variance_corr(t.lineitem, _COLS, ["l_returnflag"])
    return rnd(rnd(rnd(out, ["feature_var_p50"], 6), ["feature_var_mean"], 2), ["avg_abs_corr_p50", "avg_abs_corr_mean"], 8)


@query(
    "group_abs_corr",
    """WITH w AS (SELECT l_quantity AS a, l_discount AS b, p_size AS c, p_retailprice AS d, o_totalprice AS e, l_returnflag AS f
                  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
       r AS (SELECT f, corr(a, b) AS ab, corr(a, c) AS ac, corr(a, d) AS ad, corr(a, e) AS ae, corr(b, c) AS bc, corr(b, d) AS bd,
                    corr(b, e) AS be, corr(c, d) AS cd, corr(c, e) AS ce, corr(d, e) AS de FROM w GROUP BY 1)
       SELECT f AS l_returnflag, 'native' AS pair_kind, round(abs(ab), 8) AS mean_abs_corr, 1::BIGINT AS n_pairs FROM r
       UNION ALL SELECT f, 'joined', round(abs(cd), 8), 1 FROM r
       UNION ALL SELECT f, 'cross_parent', round((abs(ce) + abs(de)) / 2, 8), 2 FROM r
       UNION ALL SELECT f, 'native_joined', round((abs(ac) + abs(ad) + abs(ae) + abs(bc) + abs(bd) + abs(be)) / 6, 8), 6 FROM r""",
)
def group_abs_corr(t: Tables):
    wide = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(
        t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    groups = t.spark.createDataFrame(
        [("l_quantity", "native", None), ("l_discount", "native", None), ("p_size", "joined", "part"),
         ("p_retailprice", "joined", "part"), ("o_totalprice", "joined", "orders")], "column string, kind string, parent string")
    pairs = A.pairwise_corr(wide, ["l_quantity", "l_discount", "p_size", "p_retailprice", "o_totalprice"], ["l_returnflag"])
    return rnd(A.group_abs_corr(pairs, groups, ["l_returnflag"]), ["mean_abs_corr"], 8)


@query(
    "feature_label_corr",
    """WITH a AS (SELECT 'ts_child' AS archetype, unnest([abs(corr(l_quantity, y)), abs(corr(l_discount, y)), abs(corr(l_extendedprice, y))]) AS c
                  FROM (SELECT *, (l_returnflag = 'R')::INT AS y FROM lineitem)),
       b AS (SELECT 'source', unnest([abs(corr(p_size, y)), abs(corr(p_retailprice, y))]) FROM (SELECT *, (p_type = 'ECONOMY')::INT AS y FROM part)),
       u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
       SELECT archetype, count(*) AS n_features, round(avg(c), 8) AS mean_corr, round(max(c), 8) AS max_corr FROM u GROUP BY 1""",
)
def feature_label_corr(t: Tables):
    li = t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    pa = t.part.withColumn("y", (F.col("p_type") == "ECONOMY").cast("int"))
    a = A.feature_label_corr(li, ["l_quantity", "l_discount", "l_extendedprice"], "y").withColumn("archetype", F.lit("ts_child"))
    b = A.feature_label_corr(pa, ["p_size", "p_retailprice"], "y").withColumn("archetype", F.lit("source"))
    out = a.unionByName(b).groupBy("archetype").agg(
        F.count(F.lit(1)).alias("n_features"), F.avg("abs_corr").alias("mean_corr"), F.max("abs_corr").alias("max_corr"))
    return rnd(out, ["mean_corr", "max_corr"], 8)


@query(
    "strong_corr_rate",
    """WITH b AS (SELECT l_quantity AS a, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS b, l_quantity * 2 + l_tax AS c, l_discount AS d FROM lineitem),
       f AS (SELECT a, coalesce(b, (SELECT median(b) FROM b)) AS b, c, d FROM b),
       r AS (SELECT unnest([corr(a, b), corr(a, c), corr(a, d), corr(b, c), corr(b, d), corr(c, d)]) AS r FROM f)
       SELECT round(avg((abs(r) >= 0.9)::INT), 8) AS rate, count(*) AS n_pairs FROM r""",
)
def strong_corr_rate(t: Tables):
    b = t.lineitem.select(
        F.col("l_quantity").alias("a"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("b"),
        (F.col("l_quantity") * 2 + F.col("l_tax")).alias("c"), F.col("l_discount").alias("d"))
    return rnd(A.strong_corr_rate(b, ["a", "b", "c", "d"]), ["rate"], 8)


@query(
    "effective_rank",
    """WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem),
       e AS (SELECT (1 + r) / 2 AS a, (1 - r) / 2 AS b FROM r), h AS (SELECT a, -(a * ln(a) + b * ln(b)) AS h FROM e)
       SELECT 2::INTEGER AS n_features, round(exp(h) / 2, 6) AS effective_rank, round(h / ln(2), 6) AS eigen_entropy,
              1.0::DOUBLE AS top5_ratio, CASE WHEN a >= 0.95 THEN 0.5 ELSE 1.0 END::DOUBLE AS rank95_ratio FROM h""",
)
def effective_rank(t: Tables):
    """Two columns, where the spectrum is 1 plus and minus their correlation."""
    out = A.effective_rank(t.lineitem, ["l_quantity", "l_extendedprice"])
    return rnd(out, ["effective_rank", "eigen_entropy", "top5_ratio", "rank95_ratio"], 6)


@query("effective_rank_wide")
def effective_rank_wide(t: Tables):
    out = A.effective_rank(t.lineitem, _COLS)
    return rnd(out, ["effective_rank", "eigen_entropy", "top5_ratio", "rank95_ratio"], 6)


def task_metrics(t: Tables):
    """(corpus, task, metric): average order value per segment and nation."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_mktsegment").alias("corpus"), F.col("c_nationkey").alias("task")).agg(
        (F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double") / F.count(F.lit(1))).alias("metric"))


_METRICS = """m AS (SELECT c_mktsegment AS corpus, c_nationkey AS task, sum(o_totalprice::DECIMAL(20,2))::DOUBLE / count(*) AS metric
                    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


@query(
    "corpus_summary",
    f"""WITH {_METRICS}, q AS (SELECT corpus, count(*) AS n_tasks, median(metric) AS median, quantile_cont(metric, 0.25) AS q1,
                                quantile_cont(metric, 0.75) AS q3 FROM m GROUP BY 1),
        d AS (SELECT m.corpus, task, row_number() OVER (PARTITION BY m.corpus ORDER BY abs(metric - median), task) AS rn
              FROM m JOIN q ON q.corpus = m.corpus)
        SELECT q.corpus, n_tasks, round(median, 5) AS median, round(q1, 5) AS q1, round(q3, 5) AS q3, task AS exemplar
        FROM q JOIN d ON d.corpus = q.corpus AND rn = 1""",
)
def corpus_summary(t: Tables):
    return rnd(A.corpus_summary(task_metrics(t), "corpus", "task", "metric"), ["median", "q1", "q3"], 5)


@query(
    "inter_db_dispersion",
    f"""WITH {_METRICS} SELECT corpus, count(metric) AS n, round(avg(metric), 5) AS mean, round(stddev_pop(metric), 5) AS std,
        round(stddev_pop(metric) / avg(metric), 9) AS cv, round(quantile_cont(metric, 0.1), 5) AS p10, round(quantile_cont(metric, 0.9), 5) AS p90
        FROM m GROUP BY 1""",
)
def inter_db_dispersion(t: Tables):
    out = A.dispersion(task_metrics(t), "corpus", "metric")
    return rnd(rnd(out, ["mean", "std", "p10", "p90"], 5), ["cv"], 9)


@query(
    "entity_overlap",
    """WITH e AS (SELECT event_type AS task, CASE WHEN value < 0.5 THEN NULL ELSE user_id END AS e, ts < TIMESTAMP '2024-01-03' AS sup FROM events),
       s AS (SELECT task, e, count(*) AS n FROM e WHERE sup AND e IS NOT NULL GROUP BY ALL),
       q AS (SELECT e.task, e.e, coalesce(n, 0) AS n FROM e LEFT JOIN s ON s.task = e.task AND s.e = e.e WHERE NOT sup)
       SELECT task, count(e) AS n_query_valid, count(*) FILTER (n > 0) AS n_query_matched, round(count(e) / count(*), 8) AS valid_query_fraction,
              round(count(*) FILTER (n > 0) / count(e), 8) AS query_support_overlap,
              round(median(n) FILTER (n > 0), 6) AS matched_median, round(quantile_cont(n, 0.9) FILTER (n > 0), 6) AS matched_p90 FROM q GROUP BY 1""",
)
def entity_overlap(t: Tables):
    rows = t.events.select(F.col("event_type").alias("task"), F.when(F.col("value") >= 0.5, F.col("user_id")).alias("e"),
                           (F.col("ts") < F.expr("timestamp_ntz '2024-01-03 00:00:00'")).alias("sup"))
    out = A.entity_overlap(rows, ["task"], "e", F.col("sup"))
    out = rnd(out, ["valid_query_fraction", "query_support_overlap"], 8)
    return rnd(out, ["matched_median", "matched_p90"], 6)


@query(
    "homophily_rate",
    """WITH c AS (SELECT l_suppkey AS b, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY ALL),
       b AS (SELECT b, sum(n) AS t, sum(n * (n - 1) / 2) AS same FROM c GROUP BY 1)
       SELECT round(sum(same) / sum(t * (t - 1) / 2), 9) AS homophily, sum(t * (t - 1) / 2)::DOUBLE AS pairs FROM b""",
)
def homophily_rate(t: Tables):
    return rnd(A.homophily_rate(t.lineitem, "l_suppkey", "l_returnflag"), ["homophily"], 9)


@query(
    "label_constancy",
    """WITH e AS (SELECT o_orderpriority AS task, CASE WHEN o_totalprice < 5000 THEN NULL ELSE o_custkey END AS e, o_orderstatus AS y FROM orders),
       p AS (SELECT task, e, count(*) AS n, count(DISTINCT y) AS k FROM e GROUP BY ALL)
       SELECT task, sum(n)::BIGINT AS n_rows, count(e) AS n_entities, round(avg((k = 1)::INT) FILTER (e IS NOT NULL), 9) AS constant_share FROM p GROUP BY 1
       UNION ALL SELECT 'no entity', count(*), 0, -1.0 FROM events""",
)
def label_constancy(t: Tables):
    rows = t.orders.select(F.col("o_orderpriority").alias("task"), "o_orderstatus",
                           F.when(F.col("o_totalprice") >= 5000, F.col("o_custkey")).alias("e"))
    plain = t.events.select(F.lit("no entity").alias("task"), "event_type")
    out = A.label_constancy(rows, "task", "e", "o_orderstatus").unionByName(A.label_constancy(plain, "task", None, "event_type"))
    return rnd(out, ["constant_share"], 9)
