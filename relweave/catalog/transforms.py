"""Fit/transform column operators."""

from __future__ import annotations


from pyspark.sql import functions as F

from relweave.catalog.base import Tables, query, testdata_dataset
from relweave.model import ColumnMeta, RelationalDataset, TableMeta
from relweave.operators import transforms as T


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


def events_dataset(t: Tables) -> RelationalDataset:
    """Customers (a few left out) with events, whose users are then partly without a parent."""
    ds = testdata_dataset(t.spark, t.sf_dir, ["customer", "events"])
    return ds.with_table(ds.meta["customer"], t.customer.filter("c_mktsegment <> 'BUILDING'").drop("c_nationkey"))


@query(
    "transform_chain",
    """WITH k AS (SELECT c_custkey AS v FROM customer WHERE c_mktsegment <> 'BUILDING' UNION SELECT user_id FROM events),
       m AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM k),
       ev AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS code FROM events)
       SELECT ev.code AS event_id, m.code AS user_id, value::FLOAT AS value,
              dense_rank() OVER (ORDER BY event_type) - 1 AS event_type,
              dense_rank() OVER (ORDER BY day(ts)) - 1 AS "DAY_ts", epoch_us(ts) * 1000 AS ts
       FROM events e JOIN ev USING (event_id) JOIN m ON m.v = e.user_id""",
)
def transform_chain(t: Tables):
    ds = events_dataset(t)
    out = T.transform_chain(ds, [
        T.DummyTables(), T.KeyMapping(),
        T.PerColumn([T.CanonicalizeNumeric(), T.CanonicalizeDatetime(),
                     T.FeaturizeDatetime(("DAY", "TIMESTAMP")), T.RemapCategory()]),
        T.DropConstantColumns(["text"]), T.FillTimestamp(),
    ])
    return out.tables["events"].select("event_id", "user_id", "value", "event_type", "DAY_ts", "ts")


@query(
    "column_group_fit",
    """WITH v AS (SELECT o_orderstatus AS x FROM orders UNION SELECT l_linestatus FROM lineitem UNION SELECT l_returnflag FROM lineitem),
       m AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code FROM v)
       SELECT 'orders.o_orderstatus' AS "column", code, count(*) AS n FROM orders JOIN m ON x = o_orderstatus GROUP BY ALL
       UNION ALL SELECT 'lineitem.l_linestatus', code, count(*) FROM lineitem JOIN m ON x = l_linestatus GROUP BY ALL
       UNION ALL SELECT 'lineitem.l_returnflag', code, count(*) FROM lineitem JOIN m ON x = l_returnflag GROUP BY ALL""",
)
def column_group_fit(t: Tables):
    ds = testdata_dataset(t.spark, t.sf_dir, ["orders", "lineitem"])
    ds.column_groups = [[("orders", "o_orderstatus"), ("lineitem", "l_linestatus"), ("lineitem", "l_returnflag")]]
    skip = [(tb, c.name) for tb, m in ds.meta.items() for c in m.columns
            if c.dtype == "category" and (tb, c.name) not in ds.column_groups[0]]
    out = T.PerColumn([T.RemapCategory()], skip)(ds)
    parts = [
        out.tables[tb].groupBy(F.col(c).alias("code")).agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(f"{tb}.{c}").alias("column"), "code", "n")
        for tb, c in ds.column_groups[0]
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "fit_task_rules",
    """WITH m AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS x FROM customer WHERE c_acctbal >= 0)),
       s AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS x FROM orders))
       SELECT o_orderkey, m.code AS c_mktsegment, s.code AS o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
       LEFT JOIN m ON m.x = c_mktsegment JOIN s ON s.x = o_orderpriority""",
)
def fit_task_rules(t: Tables):
    target = t.customer.filter("c_acctbal >= 0")
    meta = TableMeta("customer", (ColumnMeta("c_custkey", "primary_key"), ColumnMeta("c_mktsegment", "category")))
    task = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_mktsegment", "o_orderpriority")
    fit, reuse = T.fit_task_columns(["c_mktsegment", "o_orderpriority"], meta)
    for c in reuse:  # same name in the target table: its fit is reused
        codes = T.key_codes(target, c)
        task = T.apply_codes(task, c, codes, c, codes.count())
    for c in fit:
        codes = T.key_codes(task, c)
        task = T.apply_codes(task, c, codes, c, codes.count())
    return task


@query(
    "key_mapping",
    """WITH c AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'),
       k AS (SELECT c_custkey AS v FROM c UNION SELECT user_id FROM events),
       m AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM k)
       SELECT 'customer' AS table_name, code AS pk, c_mktsegment AS val, c_name AS txt, NULL AS fk FROM c JOIN m ON v = c_custkey
       UNION ALL SELECT 'customer', code, NULL, '', NULL FROM m WHERE v NOT IN (SELECT c_custkey FROM c)
       UNION ALL SELECT 'events', row_number() OVER (ORDER BY event_id) - 1, event_type, props, code FROM events JOIN m ON v = user_id""",
)
def key_mapping(t: Tables):
    ds = T.KeyMapping()(events_dataset(t))
    cust = ds.tables["customer"].select(
        F.lit("customer").alias("table_name"), F.col("c_custkey").alias("pk"), F.col("c_mktsegment").alias("val"),
        F.col("c_name").alias("txt"), F.lit(None).cast("long").alias("fk"))
    ev = ds.tables["events"].select(
        F.lit("events").alias("table_name"), F.col("event_id").alias("pk"), F.col("event_type").alias("val"),
        F.col("props").alias("txt"), F.col("user_id").alias("fk"))
    return cust.unionByName(ev)


@query(
    "remap_category",
    """WITH m AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code FROM (SELECT DISTINCT p_brand AS x FROM part WHERE p_size <= 25))
       SELECT p_partkey, coalesce(code, (SELECT count(*) FROM m)) AS code FROM part LEFT JOIN m ON x = CASE WHEN p_size = 50 THEN NULL ELSE p_brand END""",
)
def remap_category(t: Tables):
    fitted = T.RemapCategory().fit(t.part.filter("p_size <= 25").select(F.col("p_brand").alias("x")))
    part = t.part.select("p_partkey", F.when(F.col("p_size") != 50, F.col("p_brand")).alias("code"))
    return fitted.apply(part, "code")[0].select("p_partkey", "code")


@query(
    "featurize_datetime",
    """SELECT o_orderkey, year(o_orderdate)::INTEGER AS "YEAR_o_orderdate", month(o_orderdate)::INTEGER AS "MONTH_o_orderdate",
              day(o_orderdate)::INTEGER AS "DAY_o_orderdate", (isodow(o_orderdate) - 1)::INTEGER AS "DAYOFWEEK_o_orderdate",
              epoch_us(o_orderdate) * 1000 AS "TIMESTAMP_o_orderdate", o_orderdate FROM orders""",
)
def featurize_datetime(t: Tables):
    fitted = T.FeaturizeDatetime(retain=True).fit(t.orders.select(F.col("o_orderdate").alias("x")))
    return fitted.apply(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate")[0]


@query(
    "norm_numeric",
    """WITH b AS (SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE sin(value) END AS x FROM events),
       f AS (SELECT event_id, coalesce(x, (SELECT median(x) FROM b)) AS x FROM b)
       SELECT event_id, round(((x - (SELECT avg(x) FROM f)) / (SELECT stddev_pop(x) FROM f))::FLOAT::DOUBLE, 4) AS z FROM f""",
)
def norm_numeric(t: Tables):
    base = t.events.select("event_id", F.when(F.col("event_type") != "click", F.sin("value")).alias("z"))
    fitted = T.NormNumeric().fit(base.select(F.col("z").alias("x")))
    return rounded(fitted.apply(base, "z")[0].withColumn("z", F.col("z").cast("double")), ["z"], 4)


@query("fill_timestamp", "SELECT c_custkey, c_acctbal, 0::BIGINT AS __timestamp__ FROM customer")
def fill_timestamp(t: Tables):
    ds = T.FillTimestamp()(testdata_dataset(t.spark, t.sf_dir, ["customer", "orders"]))
    assert "__timestamp__" not in ds.tables["orders"].columns
    return ds.tables["customer"].select("c_custkey", "c_acctbal", "__timestamp__")


_TOK = "unnest(regexp_split_to_array(lower(text), '\\s+'))"


@query(
    "glove_embed",
    f"""WITH tok AS (SELECT doc_id, {_TOK} AS w FROM documents),
       voc AS (SELECT w, (min(doc_id) % (SELECT count(*) FROM embeddings)) AS vid FROM tok WHERE w <> '' GROUP BY 1 HAVING count(*) >= 3),
       hit AS (SELECT doc_id, embedding FROM tok JOIN voc USING (w) JOIN embeddings ON vec_id = vid),
       m AS (SELECT doc_id, {', '.join(f'avg(embedding[{i + 1}]::DOUBLE) AS a{i}' for i in range(64))} FROM hit GROUP BY 1)
       SELECT d.doc_id, {', '.join(f'round(coalesce(a{i}, 0), 7) AS e{i}' for i in range(64))} FROM documents d LEFT JOIN m USING (doc_id)""",
)
def glove_embed(t: Tables):
    words = t.documents.select("doc_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).filter("w <> ''")
    n = t.embeddings.count()
    vocab = words.groupBy("w").agg((F.min("doc_id") % n).alias("vid"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    table = vocab.join(t.embeddings, F.col("vid") == F.col("vec_id")).select("w", F.col("embedding").alias("v"))
    out = T.mean_token_embedding(t.documents.select("doc_id", "text"), "doc_id", "text", table, "w", "v", 64)
    return out.select("doc_id", *[F.round(F.col("embedding")[i], 7).alias(f"e{i}") for i in range(64)])


_TRAIN = "o_orderdate < TIMESTAMP '1999-01-01'"
_TRAIN_SPARK = "o_orderdate < timestamp_ntz '1999-01-01 00:00:00'"


@query(
    "flat_preprocess",
    f"""WITH b AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS x,
                     CASE WHEN o_totalprice > 400000 THEN NULL WHEN {_TRAIN} THEN o_orderpriority ELSE o_orderpriority || (o_custkey > 700)::VARCHAR END AS p
                   FROM orders),
       m AS (SELECT p AS v, row_number() OVER (ORDER BY p) - 1 AS code FROM (SELECT DISTINCT p FROM b WHERE {_TRAIN} AND p IS NOT NULL))
       SELECT o_orderkey, coalesce(x, (SELECT median(x) FROM b WHERE {_TRAIN})) AS x, coalesce(code, -1) AS p FROM b LEFT JOIN m ON v = p""",
)
def flat_preprocess(t: Tables):
    b = t.orders.select(
        "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("x"),
        F.when(F.col("o_totalprice") > 400000, None).when(F.expr(_TRAIN_SPARK), F.col("o_orderpriority")).otherwise(
            F.concat("o_orderpriority", (F.col("o_custkey") > 700).cast("string"))).alias("p"))
    return T.flat_preprocess(b, ["x"], ["p"], F.expr(_TRAIN_SPARK)).select("o_orderkey", "x", "p")


@query(
    "to_numerical",
    """WITH b AS (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events)
       SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type,
              round(coalesce(v, (SELECT avg(v) FROM b)), 8) AS v FROM b""",
)
def to_numerical(t: Tables):
    b = t.events.select("event_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return rounded(T.encode_ordinal(T.fill_numeric(b, ["v"], "mean"), ["event_type"]), ["v"], 8)


@query(
    "task_encode",
    f"""WITH b AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS x,
                     CASE WHEN {_TRAIN} THEN o_orderpriority ELSE o_orderpriority || (o_custkey > 700)::VARCHAR END AS p FROM orders),
       m AS (SELECT p AS v, row_number() OVER (ORDER BY p) - 1 AS code FROM (SELECT DISTINCT p FROM b WHERE {_TRAIN}))
       SELECT o_orderkey, round(coalesce(x, (SELECT avg(x) FROM b WHERE {_TRAIN})), 6) AS x,
              coalesce(code, (SELECT count(*) FROM m)) AS p FROM b LEFT JOIN m ON v = p""",
)
def task_encode(t: Tables):
    train = F.expr(_TRAIN_SPARK)
    b = t.orders.select(
        "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("x"),
        F.when(train, F.col("o_orderpriority")).otherwise(
            F.concat("o_orderpriority", (F.col("o_custkey") > 700).cast("string"))).alias("p"))
    out = T.encode_ordinal(T.fill_numeric(b, ["x"], "mean", train), ["p"], train=train, unseen_is_n=True)
    return rounded(out, ["x"]).select("o_orderkey", "x", "p")


@query(
    "binarize_labels",
    """WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_linestatus,
                   CASE WHEN l_linestatus = 'O' THEN 'late' ELSE 'early' END AS split FROM lineitem),
       h AS (SELECT *, ('0x' || substr(md5('0|' || l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber), 1, 15))::BIGINT AS h,
               (l_linestatus = (SELECT max(l_linestatus) FROM b))::INT AS y0 FROM b),
       s AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY h, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS rn,
               min(y0) OVER (PARTITION BY split) = max(y0) OVER (PARTITION BY split) AS one_sided FROM h)
       SELECT split, CASE WHEN one_sided AND rn = 1 THEN 1 - y0 ELSE y0 END AS y, count(*) AS n FROM s GROUP BY ALL""",
)
def binarize_labels(t: Tables):
    b = t.lineitem.withColumn("split", F.when(F.col("l_linestatus") == "O", "late").otherwise("early"))
    out = T.binarize_labels(b, "l_linestatus", "y", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    return out.groupBy("split", "y").agg(F.count(F.lit(1)).alias("n"))


_BOUNDS = """
    b AS (SELECT event_id, CASE WHEN value > 30 THEN value * value ELSE value END AS x FROM events),
    s1 AS (SELECT avg(x) AS m, stddev_samp(x) AS s FROM b),
    s2 AS (SELECT avg(x) AS m, stddev_samp(x) AS s FROM b, s1 WHERE x BETWEEN s1.m - 2 * s1.s AND s1.m + 2 * s1.s),
    lim AS (SELECT m - 2 * s AS lo, m + 2 * s AS hi FROM s2)
"""


def _spiky(t: Tables):
    v = F.col("value")
    return t.events.select("event_id", F.when(v > 30, v * v).otherwise(v).alias("x"))


@query(
    "outlier_clip",
    f"""WITH {_BOUNDS}, u AS (SELECT event_id, x, hi, lo, greatest(lo - ln(1 + abs(x)), x) AS up FROM b, lim)
        SELECT event_id, round(least(hi + ln(1 + abs(up)), up), 6) AS soft, round(least(hi, greatest(lo, x)), 6) AS hard FROM u""",
)
def outlier_clip(t: Tables):
    b = _spiky(t)
    bounds = T.outlier_bounds(b, ["x"], 2.0)["x"]
    out = T.clip_outliers(b.withColumns({"soft": F.col("x"), "hard": F.col("x")}), {"soft": bounds})
    return rounded(T.clip_outliers(out, {"hard": bounds}, soft=False).drop("x"), ["soft", "hard"])


@query(
    "standard_clip",
    """SELECT l_orderkey, l_linenumber, round(greatest(-1.5, least(1.5, (l_extendedprice - avg(l_extendedprice) OVER ())
              / (stddev_pop(l_extendedprice) OVER () + 1e-6))), 7) AS z FROM lineitem""",
)
def standard_clip(t: Tables):
    out = T.standard_clip(t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("z")), ["z"], 1.5)
    return rounded(out, ["z"], 7)


def ppf_sql(p: str) -> str:
    """The normal quantile approximation in SQL."""
    from relweave.functions.scalar import _PPF_A, _PPF_B, _PPF_C, _PPF_D, _PPF_LOW

    def poly(coef, x):
        out = repr(coef[0])
        for k in coef[1:]:
            out = f"({x} * {out} + {k!r})"
        return out

    t = f"sqrt(-2.0 * ln(least({p}, 1.0 - {p})))"
    tail = f"({poly(_PPF_C, t)} / ({poly(_PPF_D, t)} * {t} + 1.0))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    centre = f"({poly(_PPF_A, r)} * {q} / ({poly(_PPF_B, r)} * {r} + 1.0))"
    return f"CASE WHEN {p} < {_PPF_LOW} THEN {tail} WHEN {p} > {1 - _PPF_LOW} THEN -{tail} ELSE {centre} END"


# the event table has about 30 rows per reference point, so the point count is read from it
@query(
    "quantile_normal",
    f"""WITH n AS (SELECT greatest(least(count(*) // 30, 1000), 10) AS m, count(*) AS n FROM events),
        r AS (SELECT value AS x, row_number() OVER (ORDER BY value) - 1 AS i FROM events),
        k AS (SELECT k, k * (n - 1) / (m - 1)::DOUBLE AS pos FROM n, range(1001) g(k) WHERE k < m),
        g AS (SELECT k, lo.x + (hi.x - lo.x) * (pos - floor(pos)) AS q FROM k JOIN r lo ON lo.i = floor(pos) JOIN r hi ON hi.i = ceil(pos)),
        v AS (SELECT DISTINCT value AS x FROM events),
        e AS (SELECT v.x, max(k) FILTER (q <= v.x) AS a, max(q) FILTER (q <= v.x) AS qa, min(k) FILTER (q >= v.x) AS b, min(q) FILTER (q >= v.x) AS qb
              FROM v, g GROUP BY 1),
        u AS (SELECT x, CASE WHEN x <= (SELECT min(q) FROM g) THEN 0.0 WHEN x >= (SELECT max(q) FROM g) THEN 1.0
                     WHEN qa = x THEN (a + b) / 2.0 / (m - 1) ELSE (a + (x - qa) / (qb - qa)) / (m - 1) END AS p FROM e, n),
        c AS (SELECT x, greatest(1e-7, least(1 - 1e-7, p)) AS p FROM u)
        SELECT event_id, round({ppf_sql("p")}, 5) AS z FROM events JOIN c ON c.x = value""",
)
def quantile_normal(t: Tables):
    return rounded(T.quantile_normal(t.events.select("event_id", "value"), "value", "z"), ["z"], 5).drop("value")


@query(
    "robust_scale",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events)
       SELECT event_id, round((value - b) / ((c - a) / 1.3489795003921634), 7) AS value FROM events, q""",
)
def robust_scale(t: Tables):
    return rounded(T.robust_scale(t.events.select("event_id", "value"), ["value"]), ["value"], 7)


@query("flat_pipeline")
def flat_pipeline(t: Tables):
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    out = None
    for method in ("none", "robust", "power", "quantile", "quantile_rtdl"):
        part = T.flat_pipeline(li, ["l_extendedprice"], method)
        stats = part.agg(
            F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"),
            F.round(F.stddev_pop("l_extendedprice"), 4).alias("std")).withColumn("method", F.lit(method))
        out = stats if out is None else out.unionByName(stats)
    return out


_YJ = """CASE WHEN value >= 0 THEN CASE WHEN abs(lam) < 1e-12 THEN ln(1 + value) ELSE (pow(1 + value, lam) - 1) / lam END
              ELSE CASE WHEN abs(lam - 2) < 1e-12 THEN -ln(1 - value) ELSE -(pow(1 - value, 2 - lam) - 1) / (2 - lam) END END"""


def _grid_sql(name: str, grid: str) -> str:
    return f"""{name} AS (SELECT lam, -count(*) / 2.0 * ln(var_pop({_YJ})) + (lam - 1) * sum(sign(value) * ln(1 + abs(value))) AS l
                         FROM events, ({grid}) WHERE value IS NOT NULL GROUP BY lam)"""


@query(
    "power_transform",
    f"""WITH {_grid_sql("g", "SELECT i / 10.0 AS lam FROM range(-40, 41) r(i)")},
        {_grid_sql("h", "SELECT round((SELECT arg_max(lam, l) FROM g) + i / 100.0, 2) AS lam FROM range(-12, 13) r(i)")}
        SELECT (SELECT count(*) FROM events) AS n, arg_max(lam, l)::DOUBLE AS lambda, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS std, 1.0::DOUBLE AS k, true AS k_marked FROM h""",
)
def power_transform(t: Tables):
    ev = t.events.select("event_id", "value", F.lit(1.0).alias("k"))
    fit = T.fit_power(ev, ["value", "k"])
    return fit.apply(ev).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.lit(fit.lambdas["value"]), 2).alias("lambda"), F.round(F.abs(F.avg("value")), 6).alias("mean"),
        F.round(F.stddev_pop("value"), 6).alias("std"), F.min("k").alias("k"), F.lit("k" in fit.marked).alias("k_marked"))


@query(
    "encode_categorical",
    """SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority,
              (o_orderstatus = 'F')::INT AS "o_orderstatus_F", (o_orderstatus = 'O')::INT AS "o_orderstatus_O",
              (o_orderstatus = 'P')::INT AS "o_orderstatus_P" FROM orders""",
)
def encode_categorical(t: Tables):
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return T.encode_categorical(T.encode_categorical(o, ["o_orderpriority"]), ["o_orderstatus"], "onehot")


@query("rebalance_distribution")
def rebalance_distribution(t: Tables):
    li = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
    out = T.rebalance(li, {
        "l_quantity": "quantile_uniform_10", "l_extendedprice": "logNormal", "l_discount": "robust", "l_tax": "power",
    }, keep_originals=True, svd=True)
    made = [c for c in out.columns if c not in li.columns]
    return out.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in made])


@query(
    "bin_quantile",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM
                  (SELECT least(10000, greatest(-10000, l_extendedprice / 10)) AS l_extendedprice FROM lineitem))
       SELECT l_orderkey, l_linenumber, list_sum(list_transform(q, lambda t: (least(10000, greatest(-10000, l_extendedprice / 10)) > t)::INT))::INTEGER AS bin
       FROM lineitem, q""",
)
def bin_quantile(t: Tables):
    li = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 10).alias("x"))
    return T.bin_quantile(li, "x", 5, "bin").drop("x")


_U = "(('0x' || substr(md5('{seed}|' || i), 1, 15))::BIGINT / 1152921504606846976.0)"


@query(
    "bin_threshold",
    f"""WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
       th AS (SELECT lo + (hi - lo) * {_U.format(seed=11)} AS t FROM r, range(4) s(i))
       SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM th WHERE l_quantity > t)::INTEGER AS bin FROM lineitem""",
)
def bin_threshold(t: Tables):
    cuts = T.uniform_thresholds(t.lineitem, "l_quantity", 5, 11)
    return t.lineitem.select("l_orderkey", "l_linenumber", T.bin_by_thresholds(F.col("l_quantity"), cuts).alias("bin"))


@query(
    "bin_rank",
    """WITH th AS (SELECT value AS t FROM events ORDER BY ('0x' || substr(md5('5|' || event_id), 1, 15))::BIGINT, event_id LIMIT 3)
       SELECT event_id, (SELECT count(*) FROM th WHERE value > t)::INTEGER AS bin FROM events""",
)
def bin_rank(t: Tables):
    cuts = T.row_thresholds(t.events, "value", "event_id", 4, 5)
    return t.events.select("event_id", T.bin_by_thresholds(F.col("value"), cuts).alias("bin"))


@query(
    "bin_value",
    f"""WITH u AS (SELECT {_U.format(seed=3)} AS p FROM range(4) s(i)), th AS (SELECT {ppf_sql("p")} AS t FROM u),
        e AS (SELECT event_id, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM events)
        SELECT event_id, (SELECT count(*) FROM th WHERE greatest(-100, least(100, z)) > t)::INTEGER AS bin FROM e""",
)
def bin_value(t: Tables):
    z = T.standard_clip(t.events.select("event_id", "value"), ["value"], eps=0.0)
    cuts = T.normal_thresholds(t.spark, 5, 3)
    return z.select("event_id", T.bin_by_thresholds(F.col("value"), cuts).alias("bin"))


@query(
    "bin_balanced",
    """SELECT l_orderkey, l_linenumber, (l_quantity > (SELECT quantile_disc(l_quantity, 0.5) FROM lineitem))::INT AS bin FROM lineitem""",
)
def bin_balanced(t: Tables):
    return T.bin_balanced(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", "bin").drop("l_quantity")


@query(
    "permute_classes",
    """WITH m AS (SELECT x, row_number() OVER (ORDER BY ('0x' || substr(md5('9|' || x), 1, 15))::BIGINT, x) - 1 AS code
                  FROM (SELECT DISTINCT p_brand AS x FROM part))
       SELECT p_partkey, p_brand, code AS class FROM part JOIN m ON x = p_brand""",
)
def permute_classes(t: Tables):
    return T.permute_classes(t.part.select("p_partkey", "p_brand"), "p_brand", "class", 9)


