"""Registry, table access and the relational metadata of the given tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from relweave.model import (
    CATEGORY, DATETIME, FLOAT, FOREIGN_KEY, PRIMARY_KEY, TEXT, ColumnMeta, RelationalDataset, TableMeta,
)
from relweave.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one folder: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None):
    """Register a query under its inventory key, with its equivalent SQL if there is one."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(tune(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def _t(name: str, time: str | None, *cols: tuple) -> TableMeta:
    return TableMeta(name, tuple(ColumnMeta(*c) for c in cols), time)


META = {
    m.name: m
    for m in (
        _t("region", None, ("r_regionkey", PRIMARY_KEY), ("r_name", CATEGORY)),
        _t("nation", None, ("n_nationkey", PRIMARY_KEY), ("n_name", CATEGORY),
           ("n_regionkey", FOREIGN_KEY, "region.r_regionkey")),
        _t("customer", None, ("c_custkey", PRIMARY_KEY), ("c_name", TEXT),
           ("c_nationkey", FOREIGN_KEY, "nation.n_nationkey"), ("c_acctbal", FLOAT), ("c_mktsegment", CATEGORY)),
        _t("supplier", None, ("s_suppkey", PRIMARY_KEY), ("s_name", TEXT),
           ("s_nationkey", FOREIGN_KEY, "nation.n_nationkey"), ("s_acctbal", FLOAT)),
        _t("part", None, ("p_partkey", PRIMARY_KEY), ("p_name", TEXT), ("p_brand", CATEGORY),
           ("p_type", CATEGORY), ("p_size", FLOAT), ("p_retailprice", FLOAT)),
        _t("orders", "o_orderdate", ("o_orderkey", PRIMARY_KEY), ("o_custkey", FOREIGN_KEY, "customer.c_custkey"),
           ("o_orderstatus", CATEGORY), ("o_totalprice", FLOAT), ("o_orderdate", DATETIME),
           ("o_orderpriority", CATEGORY)),
        _t("lineitem", "l_shipdate", ("l_orderkey", FOREIGN_KEY, "orders.o_orderkey"),
           ("l_partkey", FOREIGN_KEY, "part.p_partkey"), ("l_suppkey", FOREIGN_KEY, "supplier.s_suppkey"),
           ("l_linenumber", CATEGORY), ("l_quantity", FLOAT), ("l_extendedprice", FLOAT), ("l_discount", FLOAT),
           ("l_tax", FLOAT), ("l_returnflag", CATEGORY), ("l_linestatus", CATEGORY), ("l_shipdate", DATETIME)),
        _t("events", "ts", ("event_id", PRIMARY_KEY), ("ts", DATETIME), ("user_id", FOREIGN_KEY, "customer.c_custkey"),
           ("event_type", CATEGORY), ("value", FLOAT), ("props", TEXT)),
        _t("documents", None, ("doc_id", PRIMARY_KEY), ("text", TEXT), ("lang", CATEGORY), ("source", CATEGORY),
           ("n_chars", FLOAT)),
        _t("labels", None, ("doc_id", FOREIGN_KEY, "documents.doc_id"), ("quality", CATEGORY), ("toxic", CATEGORY)),
        _t("embeddings", None, ("vec_id", PRIMARY_KEY), ("embedding", FLOAT, None, 64),
           ("label", FOREIGN_KEY, "classes.label")),
        _t("conversations", None, ("conv_id", FOREIGN_KEY, "threads.conv_id"), ("turn", FLOAT), ("role", CATEGORY),
           ("text", TEXT)),
    )
}


def testdata_dataset(spark: SparkSession, sf_dir: str, tables: Sequence[str]) -> RelationalDataset:
    """The given tables as a relational dataset; links to tables left out are dropped."""
    t = Tables(spark, sf_dir)
    meta = {}
    for n in tables:
        m = META[n]
        kept = [c for c in m.columns if not (c.dtype == FOREIGN_KEY and c.link_to.split(".")[0] not in tables)]
        meta[n] = TableMeta(n, tuple(kept), m.time_column)
    return RelationalDataset("testdata", {n: getattr(t, n) for n in tables}, meta)
