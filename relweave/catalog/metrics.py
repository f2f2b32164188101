"""Evaluation metrics, result tables and paired comparison."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from relweave.catalog.base import Tables, query
from relweave.catalog.joins import SCORES, score_tables
from relweave.catalog.splits import RESULTS, result_rows
from relweave.catalog.structure import rnd
from relweave.operators import compare as C, metrics as M


def predictions(t: Tables):
    """Labels, class predictions and scores with many ties, from the lines."""
    return t.lineitem.select(
        F.col("l_returnflag").alias("y"),
        F.when(F.col("l_discount") < 0.03, "A").when(F.col("l_discount") < 0.07, "N").otherwise("R").alias("pred"),
        F.col("l_discount").alias("score"), F.col("l_linestatus").alias("task"),
        (0.1 + F.col("l_tax")).alias("pa"), (0.2 + F.col("l_discount")).alias("pn"),
        (0.7 - F.col("l_tax") - F.col("l_discount")).alias("pr"))


_PRED = """
    b AS (SELECT l_returnflag AS y, CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END AS pred, l_linestatus AS task,
                 l_discount AS score, 0.1 + l_tax AS pa, 0.2 + l_discount AS pn, 0.7 - l_tax - l_discount AS pr FROM lineitem),
    k AS (SELECT c.c AS c, count(*) FILTER (y = c.c) AS s, count(*) FILTER (y = c.c AND pred = c.c) AS tp, count(*) FILTER (pred = c.c) AS g
          FROM b, (SELECT DISTINCT y AS c FROM b) c GROUP BY 1)
"""


def _class_metric(name: str, column: str, sql: str):
    @query(name, f"WITH {_PRED} SELECT sum(s)::BIGINT AS n, round({sql}, 9) AS {column} FROM k")
    def run(t: Tables):
        return rnd(M.classification_metrics(predictions(t), "y", "pred").select("n", column), [column], 9)


_class_metric("metric_accuracy", "accuracy", "sum(tp) / sum(s)")
_class_metric("metric_balanced_acc", "balanced_acc", "avg(tp / s)")
_class_metric("metric_recall_w", "recall_w", "sum(s * (tp / s)) / sum(s)")
_class_metric("metric_f1_w", "f1_w", "sum(s * 2.0 * tp / (s + g)) / sum(s)")


_AUC = """(SELECT (sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos)::DOUBLE * count(*) FILTER (NOT pos))
           FROM (SELECT y = '{c}' AS pos, rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0 AS rk FROM b))"""


@query(
    "metric_auroc",
    f"""WITH {_PRED}, r AS (SELECT task, y = 'R' AS pos, rank() OVER (PARTITION BY task ORDER BY score) + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0 AS rk FROM b)
        SELECT task, round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0)
               / (count(*) FILTER (pos)::DOUBLE * count(*) FILTER (NOT pos)), 9) AS auroc FROM r GROUP BY 1
        UNION ALL SELECT 'macro', round(({_AUC.format(c='A', p='pa')} + {_AUC.format(c='N', p='pn')} + {_AUC.format(c='R', p='pr')}) / 3, 9)""",
)
def metric_auroc(t: Tables):
    b = predictions(t)
    binary = M.auroc(b, F.col("y") == "R", "score", ["task"])
    macro = M.one_vs_rest(b, "y", {"A": "pa", "N": "pn", "R": "pr"}, M.auroc).select(F.lit("macro").alias("task"), "auroc")
    return rnd(binary.unionByName(macro), ["auroc"], 9)


@query(
    "metric_ap",
    f"""WITH {_PRED}, c AS (SELECT task, score, count(*) FILTER (y = 'R') AS p, count(*) AS n FROM b GROUP BY ALL),
        s AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY task) AS tp FROM c WINDOW w AS (PARTITION BY task ORDER BY score DESC))
        SELECT task, round(sum(cp / cn * p / tp), 9) AS ap FROM s GROUP BY 1""",
)
def metric_ap(t: Tables):
    return rnd(M.average_precision(predictions(t), F.col("y") == "R", "score", ["task"]), ["ap"], 9)


@query(
    "metric_logloss",
    f"WITH {_PRED} SELECT round(avg(-ln(CASE y WHEN 'A' THEN pa WHEN 'N' THEN pn ELSE pr END)), 9) AS logloss FROM b",
)
def metric_logloss(t: Tables):
    return rnd(M.logloss(predictions(t), "y", {"A": "pa", "N": "pn", "R": "pr"}), ["logloss"], 9)


@query(
    "metric_hinge",
    f"""WITH {_PRED} SELECT round(avg(greatest(0, 1 - CASE y WHEN 'A' THEN pa - greatest(pn, pr) WHEN 'N' THEN pn - greatest(pa, pr)
        ELSE pr - greatest(pa, pn) END)), 9) AS hinge FROM b""",
)
def metric_hinge(t: Tables):
    return rnd(M.hinge(predictions(t), "y", {"A": "pa", "N": "pn", "R": "pr"}), ["hinge"], 9)


@query(
    "metric_regression",
    """WITH b AS (SELECT l_returnflag AS g, l_extendedprice AS y, l_quantity * 2000 + 500 AS p FROM lineitem)
       SELECT g, round(avg(abs(p - y)), 5) AS mae, round(avg((p - y) ** 2), 1) AS mse, round(avg((ln(1 + p) - ln(1 + y)) ** 2), 8) AS msle,
              round(sqrt(avg((p - y) ** 2)), 5) AS rmse, round(corr(y, p), 9) AS pearson, round(1 - sum((p - y) ** 2) / (var_pop(y) * count(y)), 8) AS r2
       FROM b GROUP BY 1""",
)
def metric_regression(t: Tables):
    b = t.lineitem.select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000 + 500).alias("p"))
    out = M.regression_metrics(b, "y", "p", ["g"])
    return rnd(rnd(rnd(rnd(out, ["mae", "rmse"], 5), ["mse"], 1), ["msle", "r2"], 8), ["pearson"], 9)


_RANK = """
    r AS (SELECT o_custkey AS q, o_orderstatus = 'F' AS rel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders),
    p AS (SELECT q, max((rel AND rk <= 5)::INT) AS hr, coalesce(1.0 / min(rk) FILTER (rel), 0) AS mrr,
                 coalesce(sum(1.0 / log2(rk + 1)) FILTER (rel), 0) AS dcg, count(*) FILTER (rel) AS m FROM r GROUP BY 1),
    i AS (SELECT m, sum(1.0 / log2(j + 1)) AS idcg FROM (SELECT DISTINCT m FROM p), range(1, 1000) g(j) WHERE j <= m GROUP BY 1)
"""


def _retrieval(name: str, column: str, sql: str, k):
    @query(name, f"WITH {_RANK} SELECT count(*) AS n_queries, round(avg({sql}), 9) AS {column} FROM p LEFT JOIN i ON i.m = p.m")
    def run(t: Tables):
        ranked = M.candidate_ranks(t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"),
                                   "o_custkey", "o_totalprice", "o_orderkey")
        out = M.retrieval_metrics(ranked, "o_custkey", F.col("o_orderstatus") == "F", k)
        return rnd(out.select("n_queries", column), [column], 9)


_retrieval("metric_hr", "hr", "hr", 5)
_retrieval("metric_mrr", "mrr", "mrr", None)
_retrieval("metric_ndcg", "ndcg", "coalesce(dcg / idcg, 0)", None)


@query(
    "metric_auto_mean",
    f"""WITH {RESULTS} SELECT model, dataset, task, round(avg(CASE WHEN seed = 1996 THEN NULL ELSE metric_value END), 5) AS mean_value, count(*) AS n_runs
        FROM res GROUP BY ALL""",
)
def metric_auto_mean(t: Tables):
    res = result_rows(t, F.max("o_totalprice")).withColumn(
        "metric_value", F.when(F.col("seed") == 1996, F.lit(float("nan"))).otherwise(F.col("metric_value")))
    return rnd(C.seed_means(res), ["mean_value"], 5)


_SEGMENT_NAMES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_PRIORITY_NAMES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_PIVOT = ", ".join(f"max(v) FILTER (name = '{d}/{p}') AS \"{d}/{p}\"" for d in _SEGMENT_NAMES for p in _PRIORITY_NAMES)


@query(
    "results_pivot",
    f"""WITH {RESULTS}, c AS (SELECT model, dataset || '/' || task AS name, round(avg(n / 1000.0), 4) AS v FROM res GROUP BY ALL)
        SELECT model, {_PIVOT}, round(avg(v), 4) AS average FROM c GROUP BY 1""",
)
def results_pivot(t: Tables):
    return C.results_pivot(result_rows(t, F.count(F.lit(1)) / 1000.0))


@query(
    "results_long",
    f"WITH {RESULTS} SELECT model, dataset, task, seed, metric_value FROM res ORDER BY ALL",
)
def results_long(t: Tables):
    return C.results_long(result_rows(t, F.max("o_totalprice")), ["model", "dataset", "task", "seed", "metric_value"])


def customer_pairs(t: Tables):
    """(unit, group, left, right): average order value of each customer before and after a date."""
    early = F.col("o_orderdate") < F.expr("timestamp_ntz '1998-06-01 00:00:00'")
    side = lambda c: F.max(F.when(c, F.col("o_totalprice")))
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("metric")).agg(
        side(early).alias("x"), side(~early).alias("z"))


def poisson_sql(u: str) -> str:
    """Poisson(1) weight of a uniform number of 16 bits, which never exceeds 7, in SQL."""
    acc, p, cuts = 0.0, math.exp(-1.0), []
    for k in range(8):
        acc += p
        cuts.append(f"WHEN {u} < {acc!r} THEN {k}")
        p /= k + 1
    return f"CASE {' '.join(cuts)} ELSE 8 END"


_PAIRS = """p AS (SELECT c_custkey AS u, c_mktsegment AS metric, max(o_totalprice) FILTER (o_orderdate < TIMESTAMP '1998-06-01') AS x,
                    max(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1998-06-01') AS z FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
       f AS (SELECT *, z - x AS d FROM p WHERE x IS NOT NULL AND z IS NOT NULL)"""


def _bootstrap_sql(group: str) -> str:
    """Medians of 10,000 draws per group; a hash of (unit, block) gives the weights of sixteen draws."""
    digits = "substr(hash, 1 + 4 * j, 4)"
    return f"""
       hs AS (SELECT {group} AS g, d, blk, sha256('20270720|' || u || '|' || blk) AS hash FROM f, range(625) b(blk)),
       e AS (SELECT g, d, blk * 16 + j AS draw, {poisson_sql(f"(('0x' || {digits})::BIGINT / 65536.0)")} AS w FROM hs, range(16) i(j)),
       ws AS (SELECT g, draw, d, sum(w) AS w FROM e WHERE w > 0 GROUP BY ALL),
       c AS (SELECT g, draw, d, sum(w) OVER (PARTITION BY g, draw ORDER BY d) AS upto, sum(w) OVER (PARTITION BY g, draw) AS t FROM ws),
       m AS (SELECT g, draw, (min(d) FILTER (upto > floor((t - 1) / 2.0)) + min(d) FILTER (upto > ceil((t - 1) / 2.0))) / 2 AS m FROM c GROUP BY ALL),
       ci AS (SELECT g, count(*) AS draws, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM m GROUP BY 1)"""


@query(
    "paired_bootstrap",
    f"""WITH {_PAIRS}, {_bootstrap_sql("metric")}
       SELECT metric, count(*) AS n_pairs, round(avg((d > 1e-12)::INT), 9) AS higher, round(avg((abs(d) <= 1e-12)::INT), 9) AS tied,
              round(avg((d < -1e-12)::INT), 9) AS lower, round(median(x), 5) AS left_median, round(quantile_cont(x, 0.25), 5) AS left_q1,
              round(quantile_cont(x, 0.75), 5) AS left_q3, round(median(z), 5) AS right_median, round(quantile_cont(z, 0.25), 5) AS right_q1,
              round(quantile_cont(z, 0.75), 5) AS right_q3, round(median(d), 5) AS diff_median,
              round(any_value(ci_low), 4) AS ci_low, round(any_value(ci_high), 4) AS ci_high FROM f JOIN ci ON g = metric GROUP BY 1""",
)
def paired_bootstrap(t: Tables):
    out = C.paired_summary(customer_pairs(t), ["metric"], "x", "z", "unit")
    out = rnd(rnd(out, ["higher", "tied", "lower"], 9), [c for c in out.columns if c.split("_")[0] in ("left", "right", "diff")], 5)
    return rnd(out, ["ci_low", "ci_high"], 4)


@query(
    "paired_bootstrap_interval",
    f"""WITH {_PAIRS}, {_bootstrap_sql("0")} SELECT draws, round(ci_low, 4) AS ci_low, round(ci_high, 4) AS ci_high FROM ci""",
)
def paired_bootstrap_interval(t: Tables):
    return rnd(C.bootstrap_median_interval(customer_pairs(t), "unit", "x", "z"), ["ci_low", "ci_high"], 4)


_T975 = "CASE n " + " ".join(f"WHEN {n} THEN {C.t_quantile(0.975, n - 1)!r}" for n in range(2, 41)) + " END"


@query(
    "paired_t_interval",
    f"""WITH {SCORES}, d AS (SELECT dataset, l.metric_value - r.metric_value AS d FROM lhs l JOIN rhs r USING (dataset, task, seed)),
        s AS (SELECT dataset, count(d) AS n, avg(d) AS m, stddev_samp(d) / sqrt(count(d)) AS se FROM d GROUP BY 1)
        SELECT dataset, n, round(m, 8) AS mean, round(m - {_T975} * se, 8) AS ci_low, round(m + {_T975} * se, 8) AS ci_high FROM s""",
)
def paired_t_interval(t: Tables):
    from relweave.operators.joins import paired_join

    d = paired_join(*score_tables(t), ["dataset", "task", "seed"], "metric_value").withColumn(
        "d", F.col("metric_value_left") - F.col("metric_value_right"))
    return rnd(C.paired_t_interval(d, "d", ["dataset"]), ["mean", "ci_low", "ci_high"], 8)


_FLIP = f"""
    {SCORES}, d AS (SELECT dataset, task, seed, l.metric_value - r.metric_value AS d FROM lhs l JOIN rhs r USING (dataset, task, seed)),
    o AS (SELECT dataset, task, abs(avg(d)) AS obs, count(*) AS n, list(d ORDER BY d) AS ds, list_sum(list(d ORDER BY d)) AS tot FROM d GROUP BY ALL),
    f AS (SELECT dataset, task, obs, n, abs(list_sum(list_transform(ds, lambda x, i: CASE WHEN (bits >> (i - 1)) & 1 = 1 THEN x ELSE -x END)) / n) AS m
          FROM o, range(1 << 7) g(bits) WHERE bits < (1 << n)),
    p AS (SELECT dataset, task, max(n) AS n, avg((m >= obs - 1e-15)::INT) AS p_value FROM f GROUP BY ALL)
"""


@query("sign_flip_p", f"WITH {_FLIP} SELECT dataset, task, n, round(p_value, 9) AS p_value FROM p")
def sign_flip_p(t: Tables):
    from relweave.operators.joins import paired_join

    d = paired_join(*score_tables(t), ["dataset", "task", "seed"], "metric_value").withColumn(
        "d", F.col("metric_value_left") - F.col("metric_value_right"))
    return rnd(C.sign_flip_p(d, "d", ["dataset", "task"]), ["p_value"], 9)


@query(
    "holm_adjust",
    """WITH s AS (SELECT l_suppkey, avg(l_discount) AS m FROM lineitem GROUP BY 1),
       t AS (SELECT l_suppkey, CASE WHEN m > 0.0505 THEN NULL ELSE round(m - 0.045, 6) END AS p FROM s),
       r AS (SELECT l_suppkey, p, row_number() OVER (ORDER BY p, l_suppkey) AS rn, count(*) OVER () AS mm FROM t WHERE p IS NOT NULL)
       SELECT l_suppkey, p, round(least(1, max((mm - rn + 1) * p) OVER (ORDER BY rn)), 8) AS holm_p FROM r
       UNION ALL SELECT l_suppkey, NULL, NULL FROM t WHERE p IS NULL""",
)
def holm_adjust(t: Tables):
    m = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_discount").alias("m"))
    tests = m.select("l_suppkey", F.when(F.col("m") <= 0.0505, F.round(F.col("m") - 0.045, 6)).alias("p"))
    return rnd(C.holm_adjust(tests, "p", ["l_suppkey"]), ["holm_p"], 8)


@query(
    "compare_runs",
    f"""WITH {_FLIP}, g AS (SELECT dataset, task, avg(l.metric_value) AS lm, avg(r.metric_value) AS rm, avg(l.metric_value - r.metric_value) AS md
                          FROM lhs l JOIN rhs r USING (dataset, task, seed) GROUP BY ALL),
        z AS (SELECT g.*, p.n AS n_seeds, p.p_value, row_number() OVER (ORDER BY p_value, dataset, task) AS rn, count(*) OVER () AS mm FROM g JOIN p USING (dataset, task)),
        h AS (SELECT *, least(1, max((mm - rn + 1) * p_value) OVER (ORDER BY rn)) AS holm_p FROM z)
        SELECT dataset, task, n_seeds, round(lm, 8) AS left_mean, round(rm, 8) AS right_mean, round(md, 8) AS mean_difference,
               round(p_value, 8) AS exact_p, round(holm_p, 8) AS holm_p, holm_p < 0.05 AS holm_significant FROM h
        UNION ALL SELECT 'suite', 'suite', (SELECT count(DISTINCT seed) FROM lhs), round((SELECT avg(x) FROM (SELECT avg(metric_value) AS x FROM lhs GROUP BY seed)), 8),
               round((SELECT avg(x) FROM (SELECT avg(metric_value) AS x FROM rhs GROUP BY seed)), 8), NULL, NULL,
               count(*) FILTER (md > 0)::DOUBLE, count(*) FILTER (holm_p < 0.05) > 0 FROM h""",
)
def compare_runs(t: Tables):
    tasks, suite = C.compare_runs(*score_tables(t), "F - O")
    tasks = rnd(tasks, ["left_mean", "right_mean", "mean_difference", "exact_p", "holm_p"], 8).select(
        "dataset", "task", "n_seeds", "left_mean", "right_mean", "mean_difference", "exact_p", "holm_p", "holm_significant")
    whole = suite.select(
        F.lit("suite").alias("dataset"), F.lit("suite").alias("task"), "n_seeds", F.round("left_mean", 8).alias("left_mean"),
        F.round("right_mean", 8).alias("right_mean"), F.lit(None).cast("double").alias("mean_difference"),
        F.lit(None).cast("double").alias("exact_p"), F.col("left_task_wins").cast("double").alias("holm_p"),
        (F.col("holm_significant_tasks") > 0).alias("holm_significant"))
    return tasks.unionByName(whole)


@query(
    "did_interaction",
    """WITH b AS (SELECT year(o_orderdate)::INTEGER AS seed, o_orderpriority AS v, avg((o_orderstatus = 'F')::INT) AS m FROM orders GROUP BY ALL),
       w AS (SELECT seed, max(m) FILTER (v = '1-URGENT') AS a, max(m) FILTER (v = '2-HIGH') AS b, max(m) FILTER (v = '3-MEDIUM') AS c, max(m) FILTER (v = '5-LOW') AS d FROM b GROUP BY 1)
       SELECT seed, round(a - b - c + d, 9) AS interaction FROM w""",
)
def did_interaction(t: Tables):
    res = t.orders.select(F.year("o_orderdate").alias("seed"), F.col("o_orderpriority").alias("variant"),
                          (F.col("o_orderstatus") == "F").cast("double").alias("metric_value"))
    out = C.did_interaction(res, ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])
    return rnd(out.select("seed", "interaction"), ["interaction"], 9)


