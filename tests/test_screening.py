"""Screening, drift, resampling and selection against brute force."""

import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from relweave.operators import compare as C, graph as G, joins as J, quality as Q, transforms as T
from relweave.plans import ordering, steps
from relweave.plans.logistic import fit_logistic
from relweave.plans.packing import pack_sorted, unpack_sorted
from relweave.plans.pointintime import Spec
from relweave.sources import inference as I

# ---------------------------------------------------------------- visibility and point-in-time joins


def stay(a, b):
    return sorted(a, key=repr) == sorted(b, key=repr)


@pytest.mark.parametrize("inclusive", [False, True])
def test_visibility_equals_the_chain_of_joins(spark, monkeypatch, inclusive):
    rng = random.Random(2)
    none = lambda v, p=0.15: None if rng.random() < p else v
    pairs = spark.createDataFrame({(none(rng.randint(0, 4)), none(rng.randint(0, 9))) for _ in range(30)}, "k long, cut long").distinct()
    a = spark.createDataFrame([(none(rng.randint(0, 4)), i, none(rng.randint(0, 9))) for i in range(15)], "k long, a long, at long")
    b = spark.createDataFrame([(none(rng.randint(0, 14)), none(rng.randint(0, 5)), none(rng.randint(0, 9))) for i in range(25)], "a long, b long, at long")
    seen = J.follow(J.follow(J.start_visibility(pairs, "k", "cut", [a.schema["at"].dataType]), a, "k", "a", "at"), b, "a", "b", "at")
    got = J.expand_visibility(pairs, seen, "k", "cut", "b", inclusive).collect()
    d1 = J.propagate_cutoff(pairs, a, "k", "cut", "k", ["a"], "at", False, inclusive)
    want = J.propagate_cutoff(d1, b, "a", "cut", "a", ["b"], "at", True, inclusive).collect()
    assert stay([tuple(r) for r in got], [tuple(r) for r in want])
    for many in (0, 4, 32):  # by visibility, both ways, by joins
        monkeypatch.setattr(J, "MANY_CUTOFFS", many)
        both = J.reach(pairs, "k", "cut", [(a, "k", "a", "at"), (b, "a", "b", "at")], "b", inclusive).collect()
        assert stay([tuple(r) for r in both], [tuple(r) for r in want])


def test_visibility_keeps_one_row_per_key_and_node(spark):
    n = 2000
    pairs = spark.range(n).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("cut"))
    rows = spark.range(n).select(F.lit(1).cast("long").alias("k"), (F.col("id") % 7).alias("a"), F.col("id").alias("at"))
    seen = J.follow(J.start_visibility(pairs, "k", "cut", [rows.schema["at"].dataType]), rows, "k", "a", "at")
    assert seen.nodes.count() == 7


def test_shuffles_of_cutoffs_start_with_partitions_that_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SHUFFLE_ROWS", 10)
    pairs = spark.range(20).select((F.col("id") % 4).alias("k"), F.col("id").alias("cut"))
    rows = spark.range(1000).select((F.col("id") % 4).alias("k"), F.col("id").alias("a"), (F.col("id") % 20).alias("at"))
    own = spark.conf.get(ordering._INITIAL, None)
    try:
        spark.conf.unset(ordering._INITIAL)
        out = J.reach(pairs, "k", "cut", [(rows, "k", "a", "at")], "a")
        assert int(spark.conf.get(ordering._INITIAL)) == 100
        assert out.count() == len({(a, c) for a in range(1000) for c in range(20) if a % 4 == c % 4 and a % 20 < c} | {(None, c) for c in range(4)})
        assert ordering.widen(spark, [rows.limit(5)]) < 100 == int(spark.conf.get(ordering._INITIAL))  # never lowered
    finally:
        spark.conf.unset(ordering._INITIAL) if own is None else spark.conf.set(ordering._INITIAL, own)


def test_point_in_time_aggregates_of_odd_pairs(spark):
    pairs = spark.createDataFrame([(1, 5), (1, 0), (2, 5), (None, 5), (1, None)], "k long, cut long")
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 5, 4.0), (2, None, 1.0), (None, 1, 1.0), (1, 3, None)], "k long, at long, v double")
    out = J.asof_aggregate(pairs, rows, "k", "cut", "k", "at", [Spec("n", "count", "v"), Spec("m", "mean", "v"), Spec("o", "mode", "v")], counts=["n"])
    assert stay([tuple(r) for r in out.collect()], [(1, 5, 1, 2.0, 2.0), (1, 0, 0, None, None), (2, 5, 0, None, None), (None, 5, 0, None, None), (1, None, 0, None, None)])


# ---------------------------------------------------------------- sampling over time


def test_lists_over_time_go_on_across_batches(spark):
    rng = random.Random(9)
    edges = [("a", "s", rng.randint(0, 9), "d", rng.choice([0, 0, 0, 1, 2, 3]), i, rng.randint(0, 20)) for i in range(120)]
    df = spark.createDataFrame(edges, "etype string, src_type string, src long, dst_type string, dst long, eid long, ts long")
    hashed = G._hashed(df, 1).withColumnRenamed("ts", "__ts")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own, found = spark.conf.get(batch), []
    try:
        for n in (10_000, 1, 4):
            spark.conf.set(batch, n)
            found.append(sorted((r["dst"], r["eid"], r["__until"] is None, r["__until"] or 0) for r in G.lowest_over_time(hashed, 3).collect()))
    finally:
        spark.conf.set(batch, own)
    assert found[0] == found[1] == found[2] and {r[0] for r in found[0] if r[2]} == {0, 1, 2, 3}


@pytest.mark.parametrize("hot", [1_000_000, 20])
def test_lists_over_time_hold_every_sample(spark, monkeypatch, hot):
    monkeypatch.setattr(ordering, "HOT_GROUP_ROWS", hot)
    rng = random.Random(8)
    edges = [(rng.choice("ab"), "s", rng.randint(0, 40), "d", rng.randint(0, 2), i, rng.choice([None, *range(12)])) for i in range(160)]
    edges += [("a", "s", 5, "d", 1, 900, 3)] * 3
    df = spark.createDataFrame(edges, "etype string, src_type string, src long, dst_type string, dst long, eid long, ts long")
    hashed = G._hashed(df, 1).withColumn("__ts", F.coalesce("ts", F.lit(G._UNTIMED).cast("long")))
    listed = [r.asDict() for r in G.lowest_over_time(hashed, 3).collect()]
    everything = [r.asDict() for r in hashed.collect()]
    for etype in "ab":
        for dst in range(3):
            for now in (-1, 0, 4, 11, 30):
                mine = lambda r: r["etype"] == etype and r["dst"] == dst and r["__ts"] <= now
                key = lambda r: (r["__h"], r["src"], r["eid"])
                want = sorted(key(r) for r in everything if mine(r))[:3]
                assert sorted(key(r) for r in listed if mine(r) and (r["__until"] is None or now < r["__until"])) == want


def test_a_hub_of_many_times_and_seeds_ends_in_seconds(spark):
    import time

    n = 200_000
    edges = spark.range(n).select(
        F.lit("e").alias("etype"), F.lit("o").alias("src_type"), F.col("id").alias("src"), F.lit("c").alias("dst_type"), F.lit(0).cast("long").alias("dst"))
    times = spark.range(n).select(F.lit("o").alias("node_type"), F.col("id").alias("node"), F.col("id").alias("ts"))
    seeds = spark.range(n).select(F.lit("c").alias("node_type"), F.lit(0).cast("long").alias("node"), F.col("id").alias("seed_ts"))
    began = time.time()
    out = G.neighbor_sample_temporal(edges, times, seeds, [4])
    assert out.count() == 4 * n - 6  # the first three seeds see one, two and three edges
    assert time.time() - began < 60


# ---------------------------------------------------------------- selection


@pytest.mark.parametrize("cell", [1, 20_000])
def test_threshold_selection_equals_a_sort(spark, monkeypatch, cell):
    monkeypatch.setattr(ordering, "LAST_CELL_ROWS", cell)
    rows = [(i % 37, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long").withColumn("h", F.pmod(F.xxhash64("k"), F.lit(1 << 60)))
    whole = [tuple(r) for r in df.select("h", "i").collect()]
    for cap in (0, 1, 13, 14, 250, 499, 500, 900):
        got = [tuple(r) for r in ordering.lowest_hashes(df, "h", ["i"], cap).select("h", "i").collect()]
        assert sorted(got) == sorted(whole)[:cap]
    assert ordering.lowest_hashes(df.limit(0), "h", ["i"], 3).count() == 0


def test_types_near_their_bounds(spark):
    df = spark.range(30_000).select(
        *[(F.col("id") % n).alias(f"i{n}") for n in (95, 99, 100, 105, 20_000)],
        *[F.concat(F.lit("v"), (F.col("id") % n).cast("string")).alias(f"s{n}") for n in (50, 9_999, 10_000, 10_400, 25_000)],
        F.lit(None).cast("string").alias("none"), F.when(F.col("id") > 5, F.lit("2024-01-01")).alias("day"))
    got = {r["column"]: r["dtype"] for r in I.infer_dtypes(df).collect()}
    assert got == {"i95": "category", "i99": "category", "i100": "float", "i105": "float", "i20000": "float", "s50": "category",
                   "s9999": "category", "s10000": "text", "s10400": "text", "s25000": "text", "none": "category", "day": "datetime"}


def test_unique_columns_are_made_sure_of(spark):
    a = spark.range(5000).select(F.col("id"), F.when(F.col("id") == 7, 8).otherwise(F.col("id")).alias("almost_id"), F.lit(1).alias("same_id"),
                                 F.when(F.col("id") > 0, F.col("id")).alias("null_id"))
    assert I.unique_columns({"a": a, "b": a.limit(0), "c": spark.range(3).toDF("x")}) == [("a", "id")]


# ---------------------------------------------------------------- drift


def pairwise_energy(x, y):
    both = np.concatenate([x, y])
    scale = np.maximum(both.std(axis=0, ddof=1), 1e-8)
    x, y = (x - both.mean(axis=0)) / scale, (y - both.mean(axis=0)) / scale
    d = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).mean()
    return 2 * d(x, y) - d(x, x) - d(y, y)


@pytest.mark.parametrize("d,count,close", [(1, 1, 1e-9), (2, 64, 2e-4), (4, 256, 0.15)])
def test_energy_distance_over_all_rows(spark, d, count, close):
    rng = np.random.default_rng(d)
    x, y = rng.normal(size=(300, d)), rng.normal(size=(200, d)) * 1.4 + 0.5
    frame = lambda a: spark.createDataFrame(pd.DataFrame(a, columns=[f"c{i}" for i in range(d)]))
    r = Q.energy_distance(frame(x), frame(y), [f"c{i}" for i in range(d)], count=count).first()
    want = pairwise_energy(x, y)
    assert (r["n_left"], r["n_right"]) == (300, 200)
    assert r["energy"] == pytest.approx(want, rel=close)
    assert abs(r["energy"] - want) <= (5 * r["error"] if d > 2 else close)


def test_energy_distance_of_an_empty_side_and_with_a_cap(spark):
    x = spark.range(50).select(F.col("id"), F.col("id").cast("double").alias("c"))
    assert Q.energy_distance(x, x.limit(0), ["c"]).first()["energy"] is None
    assert Q.energy_distance(x, x, ["c"]).first()["energy"] == pytest.approx(0)
    assert Q.energy_distance(x, x, ["c"], ["id"], cap=9).first()["n_left"] == 9


# ---------------------------------------------------------------- fits


def test_grouped_logistic_equals_single_fits(spark):
    rng = np.random.default_rng(4)
    rows, data = [], {}
    for task in ("p", "q"):
        x = rng.normal(size=(240, 3)) * [1, 10, 0.1]
        y = (x[:, 0] + x[:, 1] / 10 * (task == "q") + rng.normal(size=240) > 0).astype(float)
        fold = np.arange(240) % 3
        data[task] = (x, y, fold)
        rows += [(task, int(f), float(t), v.tolist()) for v, t, f in zip(x, y, fold)]
    df = spark.createDataFrame(rows, "task string, fold int, y double, x array<double>")
    weights, _ = fit_logistic(df, 3, 3, [-1, 1])
    assert len(weights) == 12
    for m, w in weights.items():
        x, y, fold = data[m.task]
        z = np.hstack([np.ones((240, 1)), (x - x.mean(0)) / x.std(0)])
        keep = [j for j in range(4) if m.left_out < 0 or j != m.left_out + 1]
        z, t = z[fold != m.fold][:, keep], y[fold != m.fold]
        p = 1 / (1 + np.exp(-z @ w[keep]))
        slope = z.T @ (t - p) - np.where(np.array(keep) == 0, 0, 1) * w[keep]
        assert np.abs(slope).max() < 1e-8 and (m.left_out < 0 or w[m.left_out + 1] == 0)


def test_leaks_are_found_by_refitting(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 600)
    df = spark.createDataFrame(pd.DataFrame({"k": range(600), "y": y, "f": rng.normal(size=600), "id": y * 1000 + rng.integers(0, 999, 600), "noise": rng.permutation(600)}))
    rows = {r["column"]: r for r in Q.leakage_check(df, ["id", "noise"], F.col("y") == 1, ["f"], ["k"]).collect()}
    assert rows["id"]["leaks"] and rows["id"]["suspicious"] and rows["id"]["full_auc"] > 0.99 and rows["id"]["without_auc"] < 0.7
    assert not rows["noise"]["leaks"] and not rows["noise"]["suspicious"]
    # with a second column that says the same, the model loses nothing
    twin = df.withColumn("f", F.col("y") + F.col("f") / 100)
    rows = {r["column"]: r for r in Q.leakage_check(twin, ["id"], F.col("y") == 1, ["f"], ["k"]).collect()}
    assert rows["id"]["suspicious"] and not rows["id"]["leaks"]


@pytest.mark.parametrize("block, most", [(250_000, 16), (3, 16), (2, 2), (1, 1)])
def test_token_means_do_not_depend_on_blocks(spark, monkeypatch, block, most):
    # one vector per text and block of tokens is shuffled
    monkeypatch.setattr(T, "TOKEN_BLOCK", block)
    monkeypatch.setattr(T, "MAX_TOKEN_BLOCKS", most)
    df = spark.createDataFrame([(1, "a b  B c"), (2, "e"), (3, "d d a zz"), (4, None), (5, "c c c")], "k long, text string")
    table = spark.createDataFrame([(w, [float(i), 2.0 * i]) for i, w in enumerate("abcdf", 1)], "w string, v array<float>")
    out = T.mean_token_embedding(df, "k", "text", table, "w", "v", 2)
    got = {r["k"]: r["embedding"] for r in out.collect()}
    assert got == {1: [2.0, 4.0], 2: [0.0, 0.0], 3: [3.0, 6.0], 4: [0.0, 0.0], 5: [3.0, 6.0]}
    if block > 4:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and plan.count("hashpartitioning(__tok") == 0


def test_one_block_of_tokens_is_broadcast_at_a_time(spark, monkeypatch):
    # all blocks were broadcast by one query, and the driver held them together
    monkeypatch.setattr(T, "TOKEN_BLOCK", 2)
    plans, plain = [], T.materialize
    monkeypatch.setattr(T, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "b b"), (None, "a g"), (3, "none")], "k long, text string")
    table = spark.createDataFrame([(w, [float(i)]) for i, w in enumerate("aabcdefg")], "w string, v array<float>")  # a token of two vectors counts twice
    out = T.mean_token_embedding(df, "k", "text", table, "w", "v", 1)
    assert {r["k"]: r["embedding"] for r in out.collect()} == {1: [3.5], 2: [2.0], None: [0.0], 3: [0.0]}
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert len(plans) > 4 and max(p.count("strategy=broadcast") for p in plans) == 1


@pytest.mark.parametrize("group", [1_000_000, 40])
def test_steps_do_not_depend_on_buckets(spark, monkeypatch, group):
    # a row moves once per line, to a bucket of bounded size
    monkeypatch.setattr(steps, "GROUP_ROWS", group)
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 60, (700, 2)).astype(float), rng.normal(30, 9, (500, 2))
    b[:200] = 7.0
    left, right = (spark.createDataFrame(pd.DataFrame(x, columns=["p", "q"])) for x in (a, b))
    lines = [steps.Line(((1.0, 0.0, 1.0), (0.0, 0.0, 1.0)), ((1.0, 0.0, 1.0), (0.0, 0.0, 1.0))),
             steps.Line(((0.5, 1.0, 2.0), (2.0, 0.0, 1.0)), ((1.0, 0.0, 1.0), (1.0, 5.0, 3.0)))]
    rows = steps.union(left, right, ["p", "q"]).repartition(5)
    got = {r["line"]: r for r in steps.compare_steps(rows, 2, lines, 700, 500).collect()}
    for i, line in enumerate(lines):
        x, y = line.place(a, True), line.place(b, False)
        z = np.unique(np.concatenate([x, y]))
        gap = np.array([(x <= v).mean() - (y <= v).mean() for v in z])
        want = [(np.abs(gap[:-1]) * np.diff(z)).sum(), (gap[:-1] ** 2 * np.diff(z)).sum(), np.abs(gap).max()]
        assert [got[i]["area"], got[i]["square"], got[i]["gap"]] == pytest.approx(want, abs=1e-9)


def test_steps_take_a_few_lines_at_a_time(spark, monkeypatch):
    # the positions of all lines lay on disk together, eight bytes each
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 1, (900, 2)), rng.integers(-3, 4, (400, 2)).astype(float)
    left, right = (spark.createDataFrame(pd.DataFrame(x, columns=["p", "q"])) for x in (a, b))
    rows = steps.union(left, right, ["p", "q"])
    lines = [steps.Line(((w, 0.0, 1.0), (1.0 - w, 0.0, 1.0)), ((w, 0.0, 1.0), (1.0 - w, 0.0, 1.0))) for w in (1.0, 0.7, 0.4, 0.1, 0.0)]
    want = sorted(map(tuple, steps.compare_steps(rows, 2, lines, 900, 400).collect()))
    monkeypatch.setattr(steps, "FEW_ROWS", 0)
    monkeypatch.setattr(steps, "LINES_AT_ONCE", 2)
    freed = []
    plain = steps.shuffles_freed
    monkeypatch.setattr(steps, "shuffles_freed", lambda s: freed.append(s) or plain(s))
    got = sorted(map(tuple, steps.compare_steps(rows, 2, lines, 900, 400).collect()))
    assert len(freed) == 3 and np.allclose(got, want, rtol=0, atol=1e-12)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


@pytest.mark.parametrize("kind", ["<f8", "<i8", "<u4"])
def test_packed_values_come_back(kind):
    x = np.sort(np.random.default_rng(6).normal(0, 1e6, 5000)).astype(kind) if kind != "<u4" else np.sort(np.random.default_rng(6).integers(0, 1 << 28, 5000)).astype(kind)
    if kind == "<f8":
        x[2500:2502] = -0.0, 0.0
    assert unpack_sorted(pack_sorted(x), kind).tobytes() == x.tobytes()
    assert len(unpack_sorted(pack_sorted(x[:0]), kind)) == 0
    assert len(zlib.compress(pack_sorted(x), 1)) < 0.8 * len(zlib.compress(x.tobytes(), 1))


def test_leaks_of_a_large_table(spark, monkeypatch):
    # above the size of a hot group the key columns met the names of the group's own keys
    df = spark.range(400).select("id", (F.col("id") % 3).alias("a"), (F.col("id") % 7 < 3).alias("y"))
    want = sorted(map(tuple, Q.leakage_check(df, ["id", "a"], F.col("y"), [], ["id"]).collect()))
    monkeypatch.setattr(ordering, "HOT_GROUP_ROWS", 50)
    got = sorted(map(tuple, Q.leakage_check(df, ["id", "a"], F.col("y"), [], ["id"]).collect()))
    assert [g[0] for g in got] == ["a", "id"]
    for g, w in zip(got, want):
        assert g[1:4] == pytest.approx(w[1:4], abs=1e-9) and g[4:] == w[4:]


def weighted_auc(score, y, w):
    pos, neg = w * (y == 1), w * (y == 0)
    wins = sum(p * (neg[score < s].sum() + neg[score == s].sum() / 2) for s, p in zip(score, pos) if p)
    total = pos.sum() * neg.sum()
    return wins / total if total else 0.5


def test_bootstrap_auc_equals_each_draw(spark):
    rng = np.random.default_rng(9)
    n, draws = 60, 40
    y, score = rng.integers(0, 2, n), np.round(rng.normal(size=n), 1)
    df = spark.createDataFrame(pd.DataFrame({"task": "t", "k": range(n), "y": y.astype(float), "score": score}))
    got = Q.bootstrap_auc(df, ["k"], draws, 5).first()
    w = np.stack([C.poisson_weights(str(k), draws, 5) for k in range(n)])
    aucs = [weighted_auc(score, y, w[:, d]) for d in range(draws)]
    assert got["auc"] == pytest.approx(np.mean(aucs)) and got["ci_low"] == pytest.approx(np.percentile(aucs, 2.5))
    assert got["ci_high"] == pytest.approx(np.percentile(aucs, 97.5))


def test_bootstrap_auc_over_many_batches(spark):
    rng = np.random.default_rng(4)
    n, draws = 9000, 20
    pdf = pd.DataFrame({"task": rng.choice(["s", "t"], n), "k": range(n), "y": rng.integers(0, 2, n), "score": np.round(rng.normal(size=n), 2)})
    pdf.loc[:5000, "score"] = 0.25  # a score whose rows fill more than one batch
    got = {r["task"]: r for r in Q.bootstrap_auc(spark.createDataFrame(pdf), ["k"], draws, 5).collect()}
    for task, mine in pdf.groupby("task"):
        w = C.poisson_weights_of([str(k) for k in mine.k], draws, 5)
        assert (w[:50] == np.stack([C.poisson_weights(str(k), draws, 5) for k in mine.k[:50]])).all()
        aucs = [weighted_auc(mine.score.to_numpy(), mine.y.to_numpy(), w[:, d].astype(float)) for d in range(draws)]
        assert got[task]["auc"] == pytest.approx(np.mean(aucs)) and got[task]["ci_low"] == pytest.approx(np.percentile(aucs, 2.5))


def test_verdicts_fail_closed(spark):
    rules = spark.createDataFrame([("d", "a", "", True), ("d", "b", "a3_rows", False), ("d", "c", "", True), ("d", "e", "", True)],
                                  "db string, task string, failures string, a_pass boolean")
    learned = spark.createDataFrame([("d", "a", 0.9, None, None, True, False), ("d", "c", 0.5, None, None, False, False)],
                                    "db string, task string, auc double, ci_low double, ci_high double, b_pass boolean, leaks boolean")
    got = {r["task"]: (r["passed"], r["stage"], r["failures"]) for r in Q.screen(rules, learned, ["db", "task"]).collect()}
    assert got == {"a": (True, "PASS", ""), "b": (False, "A", "a3_rows"), "c": (False, "B", "b2_unlearnable"), "e": (False, "B", "audit_error")}


# ---------------------------------------------------------------- resampling and sign flips


def brute_median(d, w):
    rows = sorted((v, k) for v, k in zip(d, w) if k)
    flat = [v for v, k in rows for _ in range(int(k))]
    return (flat[(len(flat) - 1) // 2] + flat[len(flat) // 2]) / 2 if flat else None


def test_bootstrap_medians_equal_each_draw(spark):
    rng = np.random.default_rng(3)
    rows = [(f"u{i}", "ab"[i % 2] if i % 7 else None, 0.0, float(np.round(rng.normal(), 1))) for i in range(75)] + [("x", "only", 1.0, 3.5), ("y", "a", None, 1.0)]
    df = spark.createDataFrame(rows, "u string, m string, l double, r double")
    got = {r["m"]: r for r in C.bootstrap_median_interval(df, "u", "l", "r", 64, 1, ["m"]).collect()}
    for m in ("a", "b", None, "only"):
        mine = [(u, r - left) for u, g, left, r in rows if g == m and left is not None]
        w = np.stack([C.poisson_weights(u, 64, 1) for u, _ in mine])
        meds = [v for v in (brute_median([d for _, d in mine], w[:, i]) for i in range(64)) if v is not None]
        assert got[m]["draws"] == len(meds)
        assert got[m]["ci_low"] == pytest.approx(np.percentile(meds, 2.5)) and got[m]["ci_high"] == pytest.approx(np.percentile(meds, 97.5))


def test_poisson_weights_are_poisson():
    w = C.poisson_weights("some unit", 100_000, 1)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - math.exp(-1)) < 0.01


def listed_p(d):
    n = len(d)
    bits = np.arange(1 << n)
    sums = sum(np.where(bits >> i & 1, v, -v) for i, v in enumerate(d))
    return float((np.abs(sums) >= abs(sum(d)) - 1e-9).mean())


def test_sign_flips_equal_the_listing(spark):
    rng = np.random.default_rng(5)
    groups = {n: rng.normal(size=n) + 0.2 for n in (1, 2, 3, 7, 12, 17)} | {20: np.array([float(v) for v in rng.integers(-3, 4, 20)]), 5: np.zeros(5)}
    rows = [(n, float(v)) for n, d in groups.items() for v in d] + [(99, None)]
    got = {r["g"]: (r["n"], r["p_value"]) for r in C.sign_flip_p(spark.createDataFrame(rows, "g long, d double"), "d", ["g"]).collect()}
    assert got == {n: (len(d), pytest.approx(listed_p(d), abs=1e-12)) for n, d in groups.items()}


def test_sign_flips_of_forty_pairs(spark):
    d = [1.0] * 30 + [-1.0] * 10
    # the sum is 20 or more, or -20 or less: at least 30 of 40 fair coins agree
    want = 2 * sum(math.comb(40, k) for k in range(30, 41)) / 2**40
    assert C.sign_flip_p(spark.createDataFrame([(v,) for v in d], "d double"), "d").first()["p_value"] == pytest.approx(want, rel=1e-12)


# ---------------------------------------------------------------- power transform


def test_lambda_is_the_maximum_to_eight_digits(spark):
    rng = np.random.default_rng(7)
    cols = {"skew": rng.lognormal(size=1500), "left": -rng.lognormal(size=1500), "both": rng.normal(size=1500) ** 3 / 5, "log": np.expm1(rng.normal(3, 0.5, 1500)),
            "shift": rng.normal(size=1500) + 100, "flat": np.full(1500, 3.0)}
    lams = T.fit_yeo_johnson(spark.createDataFrame(pd.DataFrame(cols)), list(cols))
    assert lams.pop("flat") is None

    def likelihood(x, lam):
        up, down = np.log1p(np.maximum(x, 0)), np.log1p(np.maximum(-x, 0))
        part = lambda u, p: u if abs(p) < 1e-12 else np.expm1(p * u) / p
        y = np.where(x >= 0, part(up, lam), -part(down, 2 - lam))
        return -len(x) / 2 * math.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    for c, lam in lams.items():
        x, h = cols[c], 1e-4
        slope = (likelihood(x, lam + h) - likelihood(x, lam - h)) / (2 * h)
        bend = (likelihood(x, lam + h) - 2 * likelihood(x, lam) + likelihood(x, lam - h)) / h**2
        assert bend < 0 and abs(slope / bend) < 1e-6, c


# ---------------------------------------------------------------- class tables


def test_labels_of_many_classes(spark):
    n = 100_500  # more classes than a list of them should hold
    df = spark.range(2 * n).select(F.col("id").alias("k"), (F.col("id") % n).alias("y"), F.when(F.col("id") < n, "train").otherwise("test").alias("split"))
    out = T.binarize_labels(df, "y", "b", ["k"])
    assert tuple(out.agg(F.sum("b"), F.count("b")).first()) == (n // 2 * 2, 2 * n)
    assert out.groupBy("y").agg(F.count_distinct("b").alias("d")).filter("d > 1").isEmpty()
    few = spark.createDataFrame([(1, "no", "train"), (2, "yes", "train"), (3, None, "train"), (4, "yes", "test"), (5, "no", "test")], "k long, y string, split string")
    assert {r["k"]: r["b"] for r in T.binarize_labels(few, "y", "b", ["k"]).collect()} == {1: 0, 2: 1, 3: None, 4: 1, 5: 0}
    with pytest.raises(ValueError):
        T.binarize_labels(few.filter("y = 'no'"), "y", "b", ["k"])


def test_onehot_of_many_categories(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"v{i % 5}", "ab"[i % 2]) for i in range(10)] + [(10, None, None)], "k long, c string, d string")
    monkeypatch.setattr(T, "WIDEST_ONEHOT", 3)
    out = T.encode_categorical(df, ["c", "d"], "onehot")
    assert out.columns == ["k", "c_index", "d_b"]
    assert {r["k"]: (r["c_index"], r["d_b"]) for r in out.collect()} == {i: (i % 5, i % 2) for i in range(10)} | {10: (None, 0)}


def test_visibility_expands_in_tasks_that_follow_its_rows(spark, monkeypatch):
    # few keys with many cutoffs were expanded by as many tasks as keys
    monkeypatch.setattr(J, "EXPANDED_ROWS", 10)
    pairs = spark.createDataFrame([("k", c) for c in range(40)], "k string, cut long")
    rows = spark.createDataFrame([("k", i, i % 20) for i in range(100)], "k string, n long, at long")
    seen = J.follow(J.start_visibility(pairs, "k", "cut"), rows, "k", "n", "at")
    out = J.expand_visibility(pairs, seen, "k", "cut", "n")
    assert out.filter("n is not null").count() == sum(c > i % 20 for c in range(40) for i in range(100))
    assert "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString()
