"""Every query against its SQL (sf0.001 here; ``python -m tests.oracle`` runs sf0.01)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"
# their fixed sizes (task counts, class names, sample sizes) need the larger tables
BIGGER = {"results_pivot", "evaluation_manifest", "stratified_exact", "tail_temporal"}
MORE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - BIGGER))
def test_matches_sql(spark, con, name):
    got = rows_of(queries()[name](spark, SF))
    assert compare(got, rows_of_sql(con, oracle_sql()[name])) == ""


@pytest.mark.parametrize("name", sorted(BIGGER))
def test_matches_sql_on_larger_tables(spark, name):
    got = rows_of(queries()[name](spark, MORE))
    assert compare(got, rows_of_sql(connect(MORE), oracle_sql()[name])) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_rows_only(spark, name):
    assert rows_of(queries()[name](spark, SF))[1]


def test_entry(spark):
    df = entry(spark)
    assert df.columns[0] == "c_custkey"
    assert df.count() == spark.read.parquet(f"{SF}/customer.parquet").count()


def test_golden_values(spark):
    rows = queries()["dfs"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1500
    assert sum(r["COUNT_orders"] == 0 for r in rows) == 20
    assert sum(r["MAX_orders_COUNT_lineitem"] is None for r in rows) == 42
    assert sum(r["COUNT_orders"] for r in rows) == 6800
