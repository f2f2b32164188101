"""Feature synthesis on hand-made tables: nulls, orphans, self loops, repeated keys, cutoffs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from relweave.model import ColumnMeta, RelationalDataset, TableMeta
from relweave.operators import aggregates as agg, joins as J
from relweave.plans.dfs import CustomAgg, feature_names, synthesize


def T(day):
    return dt.datetime(2024, 1, day)


@pytest.fixture(scope="module")
def shop(spark):
    users = spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0), (3, None, None)], "uid long, seg string, bal double")
    orders = spark.createDataFrame(
        [(1, 1, 5.0, T(1)), (2, 1, 7.0, T(3)), (3, 2, None, T(2)), (4, None, 9.0, T(2)), (5, 99, 9.0, T(2))],
        "oid long, uid long, price double, at timestamp_ntz")
    lines = spark.createDataFrame(
        [(1, 2.0, T(1)), (1, 4.0, T(5)), (2, 6.0, T(3)), (3, 1.0, T(9))], "oid long, qty double, at timestamp_ntz")
    meta = {
        "users": TableMeta("users", (ColumnMeta("uid", "primary_key"), ColumnMeta("seg", "category"), ColumnMeta("bal", "float"))),
        "orders": TableMeta("orders", (
            ColumnMeta("oid", "primary_key"), ColumnMeta("uid", "foreign_key", "users.uid"), ColumnMeta("price", "float"),
            ColumnMeta("at", "datetime")), "at"),
        "lines": TableMeta("lines", (
            ColumnMeta("oid", "foreign_key", "orders.oid"), ColumnMeta("qty", "float"), ColumnMeta("at", "datetime")), "at"),
    }
    return RelationalDataset("shop", {"users": users, "orders": orders, "lines": lines}, meta)


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_null_and_orphan_keys(spark, shop):
    out = by_key(synthesize(shop, shop.tables["users"].select("uid"), "users", ["uid"], 1, ("count", "mean", "max")), "uid")
    assert out[(1,)]["COUNT_orders"] == 2 and out[(1,)]["MEAN_orders_price"] == 6.0
    assert out[(2,)]["COUNT_orders"] == 1 and out[(2,)]["MEAN_orders_price"] is None
    assert out[(3,)]["COUNT_orders"] == 0 and out[(3,)]["MAX_orders_price"] is None


def test_cutoff_is_strict_at_every_hop(spark, shop):
    task = spark.createDataFrame([(1, T(3)), (2, T(3)), (1, T(4)), (3, None)], "uid long, cut timestamp_ntz")
    feats = ["users.COUNT(orders)", "users.MAX(orders.COUNT(lines))", "users.COUNT(lines)", "users.bal"]
    out = by_key(synthesize(shop, task, "users", ["uid"], 3, ("count", "max"), "cut", features=feats), "uid", "cut")
    assert out[(1, T(3))]["users_COUNT_orders"] == 1  # the order on day 3 is not before day 3
    assert out[(1, T(3))]["users_MAX_orders_COUNT_lines"] == 1  # the line of day 5 is not seen
    assert out[(1, T(4))]["users_COUNT_orders"] == 2 and out[(1, T(4))]["users_COUNT_lines"] == 2
    # a childless order stays null inside an outer aggregate, and counts 0 at the top
    assert out[(2, T(3))]["users_MAX_orders_COUNT_lines"] is None and out[(2, T(3))]["users_COUNT_lines"] == 0
    assert out[(3, None)]["users_COUNT_orders"] == 0


def test_uniform_and_per_row_cutoffs_agree(spark, shop):
    feats = ["COUNT(orders)", "MAX(orders.MAX(lines.qty))", "MEAN(lines.qty)"]
    for day in (1, 2, 3, 4, 6, 10):
        same = spark.createDataFrame([(u, T(day)) for u in (1, 2, 3)], "uid long, cut timestamp_ntz")
        mixed = spark.createDataFrame([(1, T(day)), (2, T(day)), (3, T(20))], "uid long, cut timestamp_ntz")
        a = by_key(synthesize(shop, same, "users", ["uid"], 2, ("count", "max", "mean"), "cut", features=feats), "uid")
        b = by_key(synthesize(shop, mixed, "users", ["uid"], 2, ("count", "max", "mean"), "cut", features=feats), "uid")
        for u in (1, 2):
            assert a[(u,)] == b[(u,)], day


def test_target_column_is_hidden_without_cutoff(spark, shop):
    task = spark.createDataFrame([(1,), (1,)], "uid long")
    out = synthesize(shop, task, "users", ["uid"], 1, ("count",), target_column="bal")
    assert "users_seg" in out.columns and "users_bal" not in out.columns
    assert out.count() == 2  # repeated task keys keep their rows


def test_no_key_features_and_unknown_feature(spark, shop):
    names = feature_names(shop, "users", ["uid"], 2)
    assert not any("uid" in n or "oid" in n for n in names)
    with pytest.raises(ValueError):
        synthesize(shop, shop.tables["users"].select("uid"), "users", ["uid"], 1, ("count",), features=["SUM(orders.price)"])


def test_array_aggregates_do_not_nest(spark):
    meta = {
        "a": TableMeta("a", (ColumnMeta("id", "primary_key"),)),
        "b": TableMeta("b", (ColumnMeta("id", "primary_key"), ColumnMeta("a", "foreign_key", "a.id"))),
        "c": TableMeta("c", (ColumnMeta("b", "foreign_key", "b.id"), ColumnMeta("v", "float", None, 2))),
    }
    ds = RelationalDataset("d", {
        "a": spark.createDataFrame([(1,)], "id long"), "b": spark.createDataFrame([(1, 1), (2, 1)], "id long, a long"),
        "c": spark.createDataFrame([(1, [1.0, -2.0]), (1, None), (2, None)], "b long, v array<double>")}, meta)
    names = feature_names(ds, "a", ["id"], 2, ("arraymax", "arraymean"))
    assert "ARRAYMAX(c.v)" in names and not any(n.count("ARRAY") > 1 for n in names)
    out = synthesize(ds, ds.tables["b"].select("id"), "b", ["id"], 1, ("arraymax", "arraymin", "arraymean"))
    rows = by_key(out, "id")
    assert rows[(1,)]["ARRAYMAX_c_v"] == [1.0, 0.0] and rows[(1,)]["ARRAYMIN_c_v"] == [0.0, -2.0]
    assert rows[(1,)]["ARRAYMEAN_c_v"] == [0.5, -1.0] and rows[(2,)]["ARRAYMAX_c_v"] is None


def test_selfloop_becomes_edge_table(spark):
    part = spark.createDataFrame([(1, None, 3.0), (2, 1, 4.0), (3, 1, 5.0)], "id long, up long, w double")
    ds = RelationalDataset("d", {"part": part}, {"part": TableMeta("part", (
        ColumnMeta("id", "primary_key"), ColumnMeta("up", "foreign_key", "part.id"), ColumnMeta("w", "float")))})
    out = synthesize(ds, part.select("id"), "part", ["id"], 1, ("count",))
    got = by_key(out, "id")
    assert got[(1,)]["COUNT_part_selfloop_up"] == 2 and got[(2,)]["COUNT_part_selfloop_up"] == 0


def test_custom_aggregate_stacks(spark, shop):
    spread = CustomAgg("spread", "float", lambda c: F.max(c) - F.min(c))
    out = synthesize(shop, shop.tables["users"].select("uid"), "users", ["uid"], 2, (spread, "max"),
                     features=["MAX(orders.SPREAD(lines.qty))"])
    assert by_key(out, "uid")[(1,)]["MAX_orders_SPREAD_lines_qty"] == 2.0


def test_text_chunks_join_to_the_whole(spark):
    df = spark.range(2500).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"), F.col("id").cast("string").alias("t"))
    whole = {r["g"]: r["t"] for r in agg.join_text(df, ["g"], "t", ["o"], chunk=100).collect()}
    assert whole[0] == "\n".join(str(i) for i in range(0, 2500, 2))
    parts = agg.join_text(df, ["g"], "t", ["o"], chunk=100, parts=True).filter("g = 1").orderBy("part").collect()
    assert len(parts) == 13 and "\n".join(r["t"] for r in parts) == whole[1]


def test_mode_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (2, None)], "g long, v string")
    assert {r["g"]: r["value"] for r in agg.mode_by(df, ["g"], "v").collect()} == {1: "a"}


def test_ensure_parent_errors_on_two_keys(spark, shop):
    ds = RelationalDataset("d", {"x": spark.range(1).select(F.col("id").alias("p"), F.col("id").alias("q"))}, {
        "x": TableMeta("x", (ColumnMeta("p", "foreign_key", "u.a"), ColumnMeta("q", "foreign_key", "u.b")))})
    with pytest.raises(ValueError):
        J.ensure_parents(ds)


def test_paired_join_rejects_duplicates(spark):
    a = spark.createDataFrame([("d", 1, 0.5), ("d", 1, 0.6)], "dataset string, seed int, v double")
    with pytest.raises(ValueError):
        J.paired_join(a, a, ["dataset", "seed"], "v")


def test_text_and_token_features(spark):
    meta = {
        "u": TableMeta("u", (ColumnMeta("id", "primary_key"),)),
        "m": TableMeta("m", (ColumnMeta("u", "foreign_key", "u.id"), ColumnMeta("at", "datetime"), ColumnMeta("t", "text"),
                             ColumnMeta("w", "tokens")), "at"),
    }
    msgs = spark.createDataFrame(
        [(1, T(2), "b", ["x", "y"]), (1, T(1), "a", None), (1, T(9), "late", ["z"]), (2, T(1), None, None)],
        "u long, at timestamp_ntz, t string, w array<string>")
    ds = RelationalDataset("d", {"u": spark.range(1, 4), "m": msgs}, meta)
    for task in (spark.createDataFrame([(1, T(5)), (2, T(5)), (3, T(5))], "id long, cut timestamp_ntz"),
                 spark.createDataFrame([(1, T(5)), (2, T(6)), (3, T(7))], "id long, cut timestamp_ntz")):
        out = by_key(synthesize(ds, task, "u", ["id"], 1, ("join", "concat", "count"), "cut"), "id")
        assert out[(1,)]["JOIN_m_t"] == "a\nb" and out[(1,)]["CONCAT_m_w"] == ["x", "y"] and out[(1,)]["COUNT_m"] == 2
        assert out[(2,)]["JOIN_m_t"] is None and out[(2,)]["CONCAT_m_w"] is None and out[(3,)]["COUNT_m"] == 0
