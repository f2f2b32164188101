"""Sources, sinks and schema inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.catalog.base import META, Tables, query, testdata_dataset
from relweave.model import RelationalDataset, TableMeta, TaskMeta
from relweave.session import shared_dir
from relweave.sources import inference as I, readers as R, writers as W


@query("scan_parquet", "SELECT * FROM orders")
def scan_parquet(t: Tables):
    return R.scan_parquet(t.spark, t.path("orders"))


@query("scan_npz", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_npz(t: Tables):
    folder = shared_dir(t.spark)
    W.write_npz(t.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), folder).count()
    return R.scan_npz(t.spark, folder, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")


@query(
    "scan_csv_flat",
    """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, c_nationkey, c_mktsegment AS label
       FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
)
def scan_csv_flat(t: Tables):
    flat = t.customer.select(
        "c_custkey", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("label"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), "c_nationkey",
    )
    path = W.write_csv(flat, shared_dir(t.spark) + ".csv")
    df, target = R.scan_csv_flat(t.spark, path, "c_custkey long, label string, c_acctbal double, c_nationkey int")
    return df.select("c_custkey", "c_acctbal", "c_nationkey", F.col(target).alias("label"))


@query(
    "scan_table_auto",
    """SELECT 'csv' AS fmt, p_partkey, p_name, p_retailprice FROM part
       UNION ALL SELECT 'parquet', p_partkey, p_name, p_retailprice FROM part""",
)
def scan_table_auto(t: Tables):
    part = t.part.select("p_partkey", "p_name", "p_retailprice")
    base = shared_dir(t.spark)
    paths = {"csv": W.write_csv(part, base + ".csv"), "parquet": W.write_parquet(part, base + ".parquet")}
    frames = [R.scan_table(t.spark, p, part.schema).withColumn("fmt", F.lit(f)) for f, p in paths.items()]
    return frames[0].unionByName(frames[1])


@query("sink_parquet", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def sink_parquet(t: Tables):
    path = W.write_parquet(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), shared_dir(t.spark))
    return R.scan_parquet(t.spark, path)


@query("sink_partitioned", "SELECT event_id, user_id, value, event_type FROM events")
def sink_partitioned(t: Tables):
    path = W.write_partitioned(t.events.select("event_id", "user_id", "value", "event_type"),
                               shared_dir(t.spark), 8, ["event_type"])
    return t.spark.read.parquet(path)


_SPLIT_SQL = """CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train'
                     WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'validation' ELSE 'test' END"""


def split_orders(t: Tables):
    """Orders with a temporal split column."""
    return t.orders.withColumn("split", F.expr(_SPLIT_SQL.replace("TIMESTAMP '", "timestamp_ntz '")))


@query("sink_task_splits", f"SELECT {_SPLIT_SQL} AS split, o_orderkey, o_orderstatus FROM orders")
def sink_task_splits(t: Tables):
    path = W.write_task_splits(split_orders(t).select("o_orderkey", "o_orderstatus", "split"), shared_dir(t.spark))
    return t.spark.read.parquet(path)


@query(
    "sink_csv_splits",
    """SELECT o_orderkey, o_totalprice, o_orderpriority AS target FROM orders WHERE o_orderstatus <> 'P'""",
)
def sink_csv_splits(t: Tables):
    rows = split_orders(t).select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("pr"), "o_totalprice", "split"
    )
    splits = {s: rows.filter(F.col("split") == s).drop("split") for s in W.SPLITS}
    flat = W.csv_table(W.task_table(splits), "pr", "target")
    path = W.write_csv(flat, shared_dir(t.spark) + ".csv")
    return R.scan_csv(t.spark, path, "o_orderkey long, o_totalprice double, target string")


@query(
    "dataset_save",
    f"""SELECT 'customer' AS table_name, count(*) AS n_rows, 4 AS n_cols, sum(c_custkey)::BIGINT AS keys, sum(('0x' || substr(md5(c_custkey || ':' || c_name), 1, 8))::BIGINT)::BIGINT AS content FROM customer
       UNION ALL SELECT 'orders', count(*), 6, sum(o_orderkey)::BIGINT, sum(('0x' || substr(md5(o_orderkey || ':' || o_orderpriority), 1, 8))::BIGINT)::BIGINT FROM orders
       UNION ALL SELECT 'task:status', count(*), 4, sum(o_orderkey)::BIGINT, sum(('0x' || substr(md5(o_orderkey || ':' || split), 1, 8))::BIGINT)::BIGINT FROM (SELECT o_orderkey, {_SPLIT_SQL} AS split FROM orders)""",
)
def dataset_save(t: Tables):
    ds = testdata_dataset(t.spark, t.sf_dir, ["customer", "orders"])
    task = split_orders(t).select("o_orderkey", "o_orderstatus", "o_orderdate", "split")
    ds.tasks["status"] = (TaskMeta("status", "orders", "o_orderstatus", ("o_orderkey",), "o_orderdate"), task)
    back = W.load_dataset(t.spark, W.save_dataset(ds, shared_dir(t.spark)))
    named = {**back.tables, **{f"task:{n}": df for n, (_, df) in back.tasks.items()}}
    out = None
    shown = {"customer": ("c_custkey", "c_name"), "orders": ("o_orderkey", "o_orderpriority"), "task:status": ("o_orderkey", "split")}
    for name, df in named.items():
        key, value = shown[name]
        cell = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), F.col(value))), 1, 8), 16, 10).cast("long")
        part = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(key).alias("keys"), F.sum(cell).alias("content")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"), "keys", "content")
        out = part if out is None else out.unionByName(part)
    return out


@query("dataset_discover", "SELECT lower(r_name) AS dataset FROM region WHERE r_regionkey > 0")
def dataset_discover(t: Tables):
    root = shared_dir(t.spark)
    for r in t.region.collect():  # five rows: one dataset folder each, the first without metadata
        name = r["r_name"].lower()
        nations = t.nation.filter(F.col("n_regionkey") == r["r_regionkey"])
        ds = RelationalDataset(name, {"nation": nations.drop("n_regionkey")},
                               {"nation": TableMeta("nation", META["nation"].columns[:2])})
        if r["r_regionkey"] > 0:
            W.save_dataset(ds, f"{root}/{name}")
        else:
            W.write_parquet(nations, f"{root}/{name}/nation.parquet")
    return R.discover(t.spark, [root]).select("dataset")


@query(
    "peek_table",
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5)
       SELECT 'l_orderkey' AS "column", 'bigint' AS type, count(*) AS rows, count(l_orderkey) AS present,
              (SELECT list(l_orderkey::VARCHAR ORDER BY l_orderkey, l_linenumber) FROM f) AS first FROM lineitem
       UNION ALL SELECT 'l_linenumber', 'int', count(*), count(l_linenumber), (SELECT list(l_linenumber::VARCHAR ORDER BY l_orderkey, l_linenumber) FROM f) FROM lineitem
       UNION ALL SELECT 'l_discount', 'double', count(*), count(CASE WHEN l_returnflag <> 'R' THEN 1 END),
              (SELECT list(CASE WHEN l_returnflag <> 'R' THEN 'some' END ORDER BY l_orderkey, l_linenumber) FROM f) FROM lineitem""",
)
def peek_table(t: Tables):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") != "R", F.col("l_discount")).alias("l_discount"))
    out = R.describe_columns(li, 5, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).filter(~F.col("column").isin("l_partkey", "l_suppkey"))
    # the text of a double differs between engines, so that column says only whether a value is there
    some = F.transform("first", lambda v: F.when(v.isNotNull(), "some"))
    return out.withColumn("first", F.when(F.col("column") == "l_discount", some).otherwise(F.col("first")))


@query(
    "infer_keys",
    """SELECT 'documents' AS table_name, 'doc_id' AS "column", 'primary_key' AS role, NULL AS parent FROM documents
         HAVING count(DISTINCT doc_id) = count(*)
       UNION ALL SELECT 'embeddings', 'vec_id', 'primary_key', NULL FROM embeddings HAVING count(DISTINCT vec_id) = count(*)
       UNION ALL SELECT 'quality', 'doc_id', 'foreign_key', 'documents.doc_id'
       UNION ALL SELECT 'events', 'event_id', 'primary_key', NULL
       UNION ALL SELECT 'events', 'date', 'time', NULL
       UNION ALL SELECT 'pages', 'page_id', 'primary_key', NULL FROM pages HAVING count(DISTINCT page_id) = count(*)
       UNION ALL SELECT 'messages', 'page_id', 'foreign_key', 'pages.page_id'""",
)
def infer_keys(t: Tables):
    quality = t.labels.unionByName(t.labels)  # repeated keys: not a primary key
    talks = t.conversations.select(F.col("conv_id").alias("page_id"), "turn", "text")
    return I.infer_keys({
        "documents": t.documents, "embeddings": t.embeddings, "quality": quality,
        "events": t.events.withColumnRenamed("ts", "date"), "pages": t.pages, "messages": talks,
    })


@query(
    "infer_dtypes",
    """WITH s AS (SELECT count(DISTINCT o_orderkey) AS a, count(DISTINCT o_custkey) AS b, count(DISTINCT o_orderstatus) AS c,
                   count(DISTINCT o_orderpriority) AS e, count(DISTINCT strftime(o_orderdate, '%Y-%m-%d')) AS g,
                   bool_or(regexp_matches(o_orderstatus, '\\s')) AS cw, bool_or(regexp_matches(o_orderpriority, '\\s')) AS ew
                 FROM orders)
       SELECT 'o_orderkey' AS "column", CASE WHEN a < 100 THEN 'category' ELSE 'float' END AS dtype FROM s
       UNION ALL SELECT 'o_custkey', CASE WHEN b < 100 THEN 'category' ELSE 'float' END FROM s
       UNION ALL SELECT 'o_orderstatus', CASE WHEN cw THEN 'text' WHEN c < 10000 THEN 'category' ELSE 'text' END FROM s
       UNION ALL SELECT 'o_orderpriority', CASE WHEN ew THEN 'text' WHEN e < 10000 THEN 'category' ELSE 'text' END FROM s
       UNION ALL SELECT 'day', 'datetime' FROM s UNION ALL SELECT 'o_orderdate', 'datetime'
       UNION ALL SELECT 'o_totalprice', 'float'""",
)
def infer_dtypes(t: Tables):
    return I.infer_dtypes(t.orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")))


def segment_rows(t: Tables):
    """Rows per (db, table), with customer segments acting as separate databases."""
    cust = t.customer.select("c_custkey", F.col("c_mktsegment").alias("db"))
    orders = t.orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    events = t.events.join(cust, F.col("user_id") == F.col("c_custkey"))
    out = None
    for name, df in (("customer", cust), ("orders", orders), ("events", events)):
        part = df.groupBy("db").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_SEGMENTS = """
    seg AS (SELECT c_mktsegment AS db, 'customer' AS table_name, count(*) AS n_rows FROM customer GROUP BY 1
            UNION ALL SELECT c_mktsegment, 'orders', count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
            UNION ALL SELECT c_mktsegment, 'events', count(*) FROM events JOIN customer ON user_id = c_custkey GROUP BY 1)
"""


@query(
    "table_archetype",
    f"""WITH {_SEGMENTS} SELECT db, table_name, CASE table_name WHEN 'customer' THEN 'source' ELSE 'ts_child' END AS archetype
        FROM seg""",
)
def table_archetype(t: Tables):
    roles = [("customer", "primary_key"), ("customer", "feature"), ("orders", "foreign_key"), ("orders", "time"),
             ("events", "foreign_key"), ("events", "time"), ("events", "feature")]
    meta = t.spark.createDataFrame(roles, "table_name string, role string")
    return I.table_archetype(segment_rows(t).join(F.broadcast(meta), "table_name"))


@query(
    "schema_topology",
    """WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS db, 'nation' AS child, 'region' AS parent FROM nation
                  UNION SELECT DISTINCT n_regionkey, 'customer', 'nation' FROM customer JOIN nation ON n_nationkey = c_nationkey
                  UNION SELECT DISTINCT n_regionkey, 'orders', 'customer' FROM orders JOIN customer ON o_custkey = c_custkey
                    JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority = '1-URGENT'),
       tb AS (SELECT db, child AS table_name FROM e UNION SELECT db, parent FROM e),
       w AS (SELECT db, child AS node, 1 AS depth FROM e
             UNION SELECT w.db, e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.node AND e.db = w.db)
       SELECT db, (SELECT count(*) FROM tb WHERE tb.db = d.db) AS n_tables, count(*) AS n_edges,
              (SELECT max(depth) FROM w WHERE w.db = d.db) AS depth
       FROM e d GROUP BY db""",
)
def schema_topology(t: Tables):
    nat = t.nation.select("n_nationkey", F.col("n_regionkey").alias("db"))
    cust = t.customer.join(nat, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "db")
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").join(cust, F.col("o_custkey") == F.col("c_custkey"))

    def edge(df, child, parent):
        return df.select("db").distinct().select("db", F.lit(child).alias("child"), F.lit(parent).alias("parent"))

    edges = edge(nat, "nation", "region").unionByName(edge(cust, "customer", "nation")).unionByName(
        edge(urgent, "orders", "customer"))
    tables = edges.select("db", F.col("child").alias("table_name")).unionByName(
        edges.select("db", F.col("parent").alias("table_name")))
    return I.schema_topology(tables, edges)


@query(
    "entity_task_narrow",
    """WITH m AS (SELECT c_custkey AS raw, row_number() OVER (ORDER BY c_name) - 1 AS code FROM customer)
       SELECT code AS entity, o_orderdate AS cutoff, o_orderstatus AS target FROM orders LEFT JOIN m ON raw = o_custkey""",
)
def entity_task_narrow(t: Tables):
    from relweave.operators.transforms import key_codes

    codes = key_codes(t.customer, "c_name").withColumnRenamed("value", "name")
    key_map = t.customer.join(codes, F.col("c_name") == F.col("name")).select("c_custkey", "code")
    task = t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("cutoff"),
                           F.col("o_orderstatus").alias("target"), "o_totalprice")
    return W.narrow_task(task, "entity", "target", "cutoff", key_map, "c_custkey", "code")


@query(
    "flat_to_rdb",
    """SELECT 'orders' AS table_name, NULL AS key, count(*) AS n_rows, 4 AS n_cols FROM orders
       UNION ALL SELECT DISTINCT 'o_custkey', o_custkey::VARCHAR, 1, 1 FROM orders WHERE o_custkey IS NOT NULL
       UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority, 1, 1 FROM orders WHERE o_orderpriority IS NOT NULL""",
)
def flat_to_rdb(t: Tables):
    ds = W.flat_to_dataset(t.orders, "orders", {
        "o_orderkey": None, "o_custkey": "ID", "o_orderpriority": "ID", "o_totalprice": "float",
        "o_orderdate": "datetime"}, "o_orderdate")
    out = None
    for name, df in ds.tables.items():
        key = F.lit(None) if name == "orders" else F.col("key")
        part = df.groupBy(key.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "key", "n_rows", F.lit(len(df.columns)).alias("n_cols"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "count_tasks",
    """WITH r AS (SELECT c_mktsegment AS db, o_orderstatus AS a, o_orderpriority AS b, o_custkey::VARCHAR AS c, year(o_orderdate)::VARCHAR AS d
                  FROM orders JOIN customer ON c_custkey = o_custkey),
       l AS (SELECT db, 'status' AS task, a AS label FROM r UNION ALL SELECT db, 'priority', b FROM r
             UNION ALL SELECT db, 'customer', c FROM r UNION ALL SELECT db, 'year', d FROM r),
       n AS (SELECT db, task, count(DISTINCT label) AS n FROM l GROUP BY 1, 2)
       SELECT db, count(*) AS n_tasks, count(*) FILTER (n <= 20) AS n_classification,
              count(*) FILTER (n > 20) AS n_regression FROM n GROUP BY 1""",
)
def count_tasks(t: Tables):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    long = rows.selectExpr(
        "c_mktsegment AS db",
        """stack(4, 'status', o_orderstatus, 'priority', o_orderpriority, 'customer', cast(o_custkey AS string),
           'year', cast(year(o_orderdate) AS string)) AS (task, label)""",
    )
    return I.count_tasks(long)


@query(
    "corpus_accounting",
    """WITH c AS (SELECT n_regionkey AS corpus, n_nationkey AS db, 'customer' AS tn, count(*) AS n_rows, 5 AS n_cols
                  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
                  UNION ALL SELECT n_regionkey, n_nationkey, 'supplier', count(*), 4
                  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
       full_db AS (SELECT corpus, db FROM c GROUP BY ALL HAVING count(*) = 2),
       cat AS (SELECT * FROM c SEMI JOIN full_db USING (corpus, db)),
       tk AS (SELECT DISTINCT n_regionkey AS corpus, n_nationkey AS db, o_orderpriority AS task FROM orders
              JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey SEMI JOIN full_db f
              ON f.corpus = n_regionkey AND f.db = n_nationkey)
       SELECT n_regionkey AS corpus, count(DISTINCT n_nationkey) AS requested,
         (SELECT count(DISTINCT db) FROM cat WHERE corpus = n_regionkey) AS completed,
         (SELECT count(DISTINCT db) FROM tk WHERE corpus = n_regionkey) AS with_tasks,
         (SELECT count(*) FROM cat WHERE corpus = n_regionkey) AS n_tables,
         (SELECT sum(n_rows)::BIGINT FROM cat WHERE corpus = n_regionkey) AS n_rows,
         (SELECT sum(n_rows * n_cols)::BIGINT FROM cat WHERE corpus = n_regionkey) AS n_cells,
         (SELECT count(*) FROM tk WHERE corpus = n_regionkey) AS n_tasks
       FROM nation GROUP BY 1""",
)
def corpus_accounting(t: Tables):
    nat = t.nation.select("n_nationkey", F.col("n_regionkey").alias("corpus"))

    def part(df, key, name):
        rows = df.join(nat, F.col(key) == F.col("n_nationkey"))
        return rows.groupBy("corpus", F.col("n_nationkey").alias("db")).agg(F.count(F.lit(1)).alias("n_rows")).select(
            "corpus", "db", F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"))

    tables = part(t.customer, "c_nationkey", "customer").unionByName(part(t.supplier, "s_nationkey", "supplier"))
    complete = tables.groupBy("corpus", "db").count().filter("count = 2")
    catalogue = tables.join(complete, ["corpus", "db"], "left_semi")
    tasks = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nat, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "corpus", F.col("n_nationkey").alias("db"), F.col("o_orderpriority").alias("task")).distinct()
    return I.corpus_accounting(catalogue, nat.select("corpus", F.col("n_nationkey").alias("db")), tasks)


@query(
    "evaluation_manifest",
    f"""SELECT c_mktsegment AS dataset, o_orderpriority AS task, 'auroc' AS metric,
               count(*) FILTER ({_SPLIT_SQL} = 'train') AS train_pool_rows,
               count(*) FILTER ({_SPLIT_SQL} = 'test') AS test_pool_rows, 3 AS n_features, 512 AS support_cap,
               50000 AS test_cap, '0,1,2,3,4,5,6,7,8,9' AS evaluation_seeds
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
)
def evaluation_manifest(t: Tables):
    rows = split_orders(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("task"), "split",
        F.col("o_orderstatus").alias("label"))
    return I.evaluation_manifest(rows, n_features=3, metric="auroc", expected=25)
