"""Queries whose job had been made smaller do all of it."""

from pyspark.sql import functions as F

from __spark_entry__ import queries


def test_asof_join_returns_every_earlier_row(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    pairs = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at")).distinct()
    earlier = pairs.join(orders, (F.col("k") == F.col("o_custkey")) & (F.col("o_orderdate") < F.col("at"))).count()
    out = queries()["asof_cutoff_join"](spark, sf)
    assert out.columns == ["o_custkey", "cutoff", "o_orderkey", "o_totalprice"]
    assert out.filter("o_orderkey is not null").count() == earlier > 0


def test_texts_are_joined_whole(spark, sf):
    talk = spark.read.parquet(f"{sf}/conversations.parquet")
    out = queries()["text_join"](spark, sf)
    assert out.count() == talk.select("conv_id", "role").distinct().count()
    assert out.agg(F.sum("n")).first()[0] == talk.count()


def test_a_group_without_text_keeps_its_row(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", None), (None, 0, "user", "a"), (None, 1, "user", "b")], "conv_id long, turn int, role string, text string"
                          ).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in queries()["text_join"](spark, str(tmp_path)).collect()}
    assert got == {(1, "user", None, 1), (None, "user", "a\nb", 2)}


def test_token_lists_are_flattened_whole(spark, sf):
    talk = spark.read.parquet(f"{sf}/conversations.parquet")
    out = queries()["array_flatten"](spark, sf)
    assert out.count() == talk.select("conv_id").distinct().count()
    assert out.agg(F.sum(F.size("tokens"))).first()[0] == 2 * talk.count()
