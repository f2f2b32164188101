"""The pipeline's contract, and every registered query over the small tables."""

import pytest

import corpus_pipeline
from relweave.llm import queries as Q
from tests.oracle import compare, connect, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries(spark, name):
    got = rows_of(Q.QUERIES[name](spark, SF))
    if name in Q.ORACLE:
        assert compare(got, rows_of_sql(connect(SF), Q.ORACLE[name])) == ""
    else:
        assert got[1]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    scratch = corpus_pipeline.Scratch(corpus_pipeline.tune(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, SF))
        n = docs.count()
        assert docs.columns == columns and n <= before and (n == before or name != "line_dedup")
        before = n
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.count() == before and mixed.agg({"taken": "sum"}).first()[0] > 0
