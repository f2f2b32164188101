"""Differing cutoffs against one synthesis per cutoff, and hot keys."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from relweave.model import ColumnMeta, RelationalDataset, TableMeta
from relweave.plans import dfs, ordering
from relweave.plans.dfs import CustomAgg, synthesize

START = dt.datetime(2024, 1, 1)


def at(rng):
    return START + dt.timedelta(hours=rng.randint(0, 30)) if rng.random() > 0.08 else None


@pytest.fixture(scope="module")
def shop(spark):
    """Four levels, an untimed parent and child, repeated and null keys, null values and times."""
    rng = random.Random(11)
    maybe = lambda v: None if rng.random() < 0.1 else v
    users = spark.createDataFrame([(i, rng.choice("ab"), i % 3) for i in range(6)], "uid long, seg string, rid long")
    regions = spark.createDataFrame([(0, 1.0), (1, 2.0)], "rid long, size double")
    notes = spark.createDataFrame([(rng.randint(0, 5), rng.random()) for _ in range(12)], "uid long, len double")
    orders = spark.createDataFrame(
        [(i, maybe(rng.randint(0, 5)), maybe(float(rng.randint(0, 9))), maybe(rng.choice("xyz")), [rng.random(), rng.random()] if rng.random() > 0.2 else None, at(rng))
         for i in range(40)], "oid long, uid long, price double, kind string, vec array<double>, at timestamp_ntz")
    lines = spark.createDataFrame(
        [(i, maybe(rng.randint(0, 42)), maybe(float(rng.randint(-5, 5))), at(rng)) for i in range(120)],
        "lid long, oid long, qty double, at timestamp_ntz")
    parcels = spark.createDataFrame([(maybe(rng.randint(0, 119)), maybe(rng.random()), at(rng)) for _ in range(150)], "lid long, kg double, at timestamp_ntz")
    key, fk, num, cat = "primary_key", "foreign_key", "float", "category"
    C = ColumnMeta
    meta = {
        "regions": TableMeta("regions", (C("rid", key), C("size", num))),
        "users": TableMeta("users", (C("uid", key), C("seg", cat), C("rid", fk, "regions.rid"))),
        "notes": TableMeta("notes", (C("uid", fk, "users.uid"), C("len", num))),
        "orders": TableMeta("orders", (C("oid", key), C("uid", fk, "users.uid"), C("price", num), C("kind", cat), C("vec", num, None, 2), C("at", "datetime")), "at"),
        "lines": TableMeta("lines", (C("lid", key), C("oid", fk, "orders.oid"), C("qty", num), C("at", "datetime")), "at"),
        "parcels": TableMeta("parcels", (C("lid", fk, "lines.lid"), C("kg", num), C("at", "datetime")), "at"),
    }
    tables = {"users": users, "regions": regions, "notes": notes, "orders": orders, "lines": lines, "parcels": parcels}
    return RelationalDataset("shop", tables, meta)


def table(rows):
    def value(v):
        if isinstance(v, float):
            return round(v, 9)
        return tuple(value(x) for x in v) if isinstance(v, list) else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


@pytest.fixture(autouse=True)
def every_key_is_crowded(monkeypatch):
    monkeypatch.setattr(dfs, "MANY_CUTOFFS", 0)


def check(spark, ds, prims, depth, features=None, inclusive=False):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 7), START + dt.timedelta(hours=rng.choice([0, 3, 9, 10, 17, 40]))) for i in range(40)]
    task = spark.createDataFrame(rows, "row_id long, uid long, cut timestamp_ntz")
    args = dict(depth=depth, primitives=prims, cutoff="cut", features=features, inclusive=inclusive, key_is_unique=False)
    got = synthesize(ds, task, "users", ["uid"], **args)
    want = []
    for cut in {r[2] for r in rows}:
        want += synthesize(ds, spark.createDataFrame([r for r in rows if r[2] == cut], task.schema), "users", ["uid"], **args).collect()
    assert got.columns == [*task.columns, *got.columns[3:]]
    assert table(got.collect()) == table(want)
    return got


def test_one_hop_with_every_primitive(spark, shop):
    prims = ("max", "min", "mean", "count", "mode", "arraymax", "arraymin", "arraymean")
    out = check(spark, shop, prims, 2)
    assert "users_MODE_orders_kind" in out.columns and "users_ARRAYMEAN_orders_vec" in out.columns


def test_inner_aggregates_that_change_with_the_cutoff(spark, shop):
    wanted = [f"users.{a}(orders.{b})" for a in ("MAX", "MIN", "MEAN") for b in
              ("COUNT(lines)", "MAX(lines.qty)", "MIN(lines.qty)", "MEAN(lines.qty)")]
    wanted += ["users.COUNT(lines)", "users.MEAN(lines.qty)", "users.COUNT(orders)", "users.MAX(notes.len)", "users.seg"]
    check(spark, shop, ("max", "min", "mean", "count"), 3, wanted)
    check(spark, shop, ("max", "min", "mean", "count"), 3, wanted[:5], inclusive=True)


def test_three_levels_of_change(spark, shop):
    wanted = ["users.MIN(orders.MEAN(lines.MAX(parcels.kg)))", "users.MEAN(orders.MAX(lines.COUNT(parcels)))",
              "users.MAX(lines.MIN(parcels.kg))", "users.COUNT(parcels)", "users.MIN(orders.COUNT(parcels))"]
    check(spark, shop, ("max", "min", "mean", "count"), 4, wanted)


def test_user_aggregates_keep_their_rows(spark, shop):
    spread = CustomAgg("spread", "float", lambda c: F.max(c) - F.min(c))
    check(spark, shop, (spread, "count", "max"), 2, ["users.SPREAD(orders.price)", "users.COUNT(orders)", "users.MAX(orders.price)"])


def test_few_and_many_cutoffs_side_by_side(spark, shop, monkeypatch):
    monkeypatch.setattr(dfs, "MANY_CUTOFFS", 3)  # of six
    check(spark, shop, ("max", "count", "mode", "min"), 3, ["users.MAX(orders.MIN(lines.qty))", "users.MODE(orders.kind)", "users.COUNT(lines)"])


def test_hot_groups_are_cut_into_buckets(spark, shop, monkeypatch):
    monkeypatch.setattr(ordering, "HOT_GROUP_ROWS", 5)
    wanted = ["users.MIN(orders.MEAN(lines.qty))", "users.MODE(orders.kind)", "users.COUNT(orders)", "users.MAX(lines.qty)"]
    check(spark, shop, ("max", "min", "mean", "count", "mode"), 3, wanted)


@pytest.mark.parametrize("kinds", [("long", "long"), ("double", "long"), ("long", "double"), ("date", "timestamp_ntz")])
def test_numbers_and_dates_as_time(spark, kinds):
    stamp = (lambda i: F.date_add(F.lit("2024-01-01").cast("date"), i.cast("int"))) if kinds[0] == "date" else (lambda i: i)
    users = spark.range(3).select(F.col("id").alias("uid"))
    rows = spark.range(30).select((F.col("id") % 3).alias("uid"), F.col("id").cast("double").alias("v"), stamp(F.col("id") % 7).cast(kinds[0]).alias("at"))
    C = ColumnMeta
    ds = RelationalDataset("n", {"users": users, "rows": rows}, {
        "users": TableMeta("users", (C("uid", "primary_key"),)),
        "rows": TableMeta("rows", (C("uid", "foreign_key", "users.uid"), C("v", "float"), C("at", "datetime")), "at")})
    task = spark.range(9).select((F.col("id") % 3).alias("uid"), stamp(F.col("id") % 4 + 1).cast(kinds[1]).alias("cut"))
    got = synthesize(ds, task, "users", ["uid"], 2, ("count", "max"), "cut", key_is_unique=False)
    for r in got.collect():
        n = [i for i in range(30) if i % 3 == r["uid"] and stamp_of(i % 7, kinds) < stamp_of(r["cut"], kinds)]
        assert r["users_COUNT_rows"] == len(n) and r["users_MAX_rows_v"] == (max(n) if n else None)


def stamp_of(v, kinds):
    if kinds[0] != "date":
        return v
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=v) if isinstance(v, int) else v


def test_hot_key_of_many_rows_and_cutoffs_ends_in_seconds(spark, monkeypatch):
    n = 200_000
    C = ColumnMeta
    users = spark.range(2).select(F.col("id").alias("uid"))
    seconds = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    orders = spark.range(n).select(F.col("id").alias("oid"), F.lit(0).cast("long").alias("uid"), F.col("id").cast("double").alias("price"), seconds(F.col("id") * 2).alias("at"))
    lines = spark.range(n).select(F.col("id").alias("oid"), seconds(F.col("id") * 2 + 3).alias("at"))
    ds = RelationalDataset("hot", {"users": users, "orders": orders, "lines": lines}, {
        "users": TableMeta("users", (C("uid", "primary_key"),)),
        "orders": TableMeta("orders", (C("oid", "primary_key"), C("uid", "foreign_key", "users.uid"), C("price", "float"), C("at", "datetime")), "at"),
        "lines": TableMeta("lines", (C("oid", "foreign_key", "orders.oid"), C("at", "datetime")), "at")})
    task = spark.range(n).select(F.lit(0).cast("long").alias("uid"), seconds(F.col("id") * 2 + 1).alias("cut"))
    monkeypatch.undo()
    started = time.time()
    out = synthesize(ds, task, "users", ["uid"], 3, ("count", "max", "mean"), "cut", key_is_unique=False,
                     features=["users.COUNT(orders)", "users.MAX(orders.price)", "users.MEAN(orders.COUNT(lines))"])
    got = out.agg(F.count("*"), F.sum("users_COUNT_orders"), F.max("users_MAX_orders_price"), F.max("users_MEAN_orders_COUNT_lines")).first()
    assert tuple(got) == (n, n * (n + 1) // 2, n - 1.0, 1.0)
    assert time.time() - started < 90
