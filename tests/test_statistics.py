"""Closed-form values and properties of the statistics, splits and transforms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from relweave.functions import scalar as S
from relweave.operators import compare as C, graph as G, metrics as M, quality as Q, splits as P, structure as A, transforms as T
from relweave.plans import ordering as O, quantiles as N


def test_effective_rank(spark):
    x = np.random.default_rng(0).normal(size=(20_000, 4))
    free = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")))
    assert A.effective_rank(free, list("abcd")).first()["effective_rank"] > 0.98
    same = free.select(*[F.col("a").alias(c) for c in "abcd"])
    assert A.effective_rank(same, list("abcd")).first()["effective_rank"] == pytest.approx(0.25, abs=1e-6)


def test_parent_coverage(spark):
    parents = spark.range(4).withColumnRenamed("id", "pk")
    even = spark.range(40).select((F.col("id") % 4).alias("fk"))
    assert A.effective_parent_coverage(even, "fk", parents, "pk").first()["coverage"] == pytest.approx(1.0)
    one = spark.range(40).select(F.lit(0).alias("fk"))
    assert A.effective_parent_coverage(one, "fk", parents, "pk").first()["coverage"] == pytest.approx(0.25)


def test_nmi(spark):
    df = spark.range(80).select((F.col("id") % 4).alias("x"), (F.col("id") % 4).alias("y"), F.lit(0).alias("k"))
    assert A.multi_parent_nmi(df, "x", "y").first()["nmi"] == pytest.approx(1.0)
    assert A.multi_parent_nmi(df, "x", "k").first()["nmi"] is None


def test_sign_flip_and_holm(spark):
    d = spark.createDataFrame([(1.0,)] * 4, "d double")
    assert C.sign_flip_p(d, "d").first()["p_value"] == pytest.approx(0.125)
    with pytest.raises(ValueError):
        C.sign_flip_p(spark.range(41).select(F.lit(1.0).alias("d")), "d")
    p = spark.createDataFrame([("a", 0.01), ("b", 0.03), ("c", 0.2), ("n", None)], "k string, p double")
    got = {r["k"]: r["holm_p"] for r in C.holm_adjust(p, "p", ["k"]).collect()}
    assert [got["a"], got["b"], got["c"]] == pytest.approx([0.03, 0.06, 0.2]) and got["n"] is None


def test_t_quantile_and_normal_quantile():
    assert C.t_quantile(0.975, 9) == pytest.approx(2.2621571628, abs=1e-8)
    assert C.t_quantile(0.975, 1) == pytest.approx(12.7062047364, abs=1e-6)
    assert S.normal_quantile(np.array([0.975, 0.5, 0.001])) == pytest.approx([1.959963985, 0.0, -3.090232306], abs=1e-7)


def test_stable_seed(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"a:b:1").digest()[:4], "big")
    assert spark.range(1).select(S.stable_seed(F.lit("a:b:1"))).first()[0] == want


def test_metrics_closed_form(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    assert M.auroc(df, F.col("y") == 1, "s").first()["auroc"] == pytest.approx(0.75)
    assert M.average_precision(df, F.col("y") == 1, "s").first()["ap"] == pytest.approx(0.8333333333)
    one = df.filter("y = 1")
    row = M.auroc(one, F.col("y") == 1, "s").first()
    assert row is None or row["auroc"] is None


def test_numbered_is_exact_under_skew(spark):
    # a third of the rows share the first order column
    df = spark.range(9000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 50).alias("a"), F.col("id").alias("b"))
    got = [(r["a"], r["b"]) for r in O.numbered(df, ["a", "b"]).orderBy("rn").collect()]
    assert got == sorted(got) and len(got) == 9000
    hot = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("g"), F.col("id").alias("b"))
    rows = O.numbered(hot, ["b"], ["g"], total="n").filter("g = 0").orderBy("rn").collect()
    assert [r["rn"] for r in rows] == list(range(1, 2001)) and rows[0]["n"] == 2000
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)


def test_numbered_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.col("id"), F.concat(F.lit("k"), (F.col("id") * 7919 % 1000).cast("string")).alias("s"))
    a = {r["id"]: r["rn"] for r in O.numbered(df.repartition(3), ["s"]).collect()}
    b = {r["id"]: r["rn"] for r in O.numbered(df.repartition(17), ["s"]).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 1001))


def test_quantiles_against_numpy(spark):
    for n in (1, 2, 7, 1000):
        x = np.random.default_rng(n).normal(size=n).round(2)
        df = spark.createDataFrame(pd.DataFrame({"x": x}))
        assert N.exact_quantile_values(df, "x", [0.0, 0.3, 0.5, 1.0]) == pytest.approx(list(np.quantile(x, [0.0, 0.3, 0.5, 1.0])))
        if n > 1:
            points = min(11, n)
            assert N.reference_grid(df, "x", 11) == pytest.approx(list(np.quantile(x, np.linspace(0, 1, points))))


def test_large_quantile_bracket(spark):
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("x"))
    assert N.exact_quantile_values(df, "x", [0.1, 0.5, 0.999]) == pytest.approx([4999.9, 24999.5, 49949.001])


@pytest.mark.parametrize("values", [
    1e9 + np.random.default_rng(3).random(700),
    np.random.default_rng(4).integers(-3, 4, 700).astype(float),
    np.array([0.0, 1e-300, -1e-300, 1e307, -1e307, 7.0]),
])
def test_quantiles_of_close_tied_and_extreme_values(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    probs = [0.0, 0.3, 0.5, 0.999]
    assert N.exact_quantile_values(df, "x", probs) == pytest.approx(list(np.quantile(values, probs)), rel=1e-12, abs=0)
    grid = np.interp(np.linspace(0, len(values) - 1, min(50, len(values))), np.arange(len(values)), np.sort(values))
    assert N.reference_grid(df, "x", 50) == pytest.approx(list(grid), rel=1e-12, abs=0)


def test_quantiles_per_group_do_not_depend_on_the_hot_size(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=603)
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 500 + ["b"] * 3 + [None] * 100, "x": x}))
    want = {"a": x[:500], "b": x[500:503], None: x[503:]}

    def found():
        return {r["g"]: r["m"] for r in N.exact_quantiles(df, "x", {"m": 0.37}, ["g"]).collect()}

    cold = found()
    monkeypatch.setattr(O, "HOT_GROUP_ROWS", 1)
    assert cold == found() == pytest.approx({g: np.quantile(v, 0.37) for g, v in want.items()}, rel=1e-12)


def test_grid_is_exact_on_many_rows(spark):
    df = spark.range(700_000).select((F.col("id") * 7919 % 700_000).cast("double").alias("x"))
    assert N.reference_grid(df, "x", 1000) == pytest.approx(list(np.linspace(0, 699_999, 1000)), rel=1e-12)


def test_exact_splits(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    for make in (lambda d: P.ratio_split(d, ["k"], 0.8, 0.1), lambda d: P.shuffled_split(d, ["k"], 0.8, 0.1, "s")):
        n = {r["split"]: r["count"] for r in make(df).groupBy("split").count().collect()}
        assert n == {"train": 802, "validation": 100, "test": 101}
    one = {r["k"]: r["split"] for r in P.shuffled_split(df.repartition(2), ["k"], seed="s").collect()}
    two = {r["k"]: r["split"] for r in P.shuffled_split(df.repartition(9), ["k"], seed="s").collect()}
    assert one == two


def test_temporal_split_needs_all_parts(spark):
    df = spark.sql("SELECT timestamp_ntz '2024-01-01 00:00:00' AS t")
    with pytest.raises(ValueError):
        P.temporal_split(df, "t")


def test_aligned_sample_keeps_rows_together(spark):
    df = spark.range(20).select(F.col("id").alias("x"), (F.col("id") + 100).alias("y"), (F.col("id") + 200).alias("fk"),
                                F.lit(None).cast("long").alias("side"))
    rows = P.capped_rows(df, 7, ["x"], 42).collect()
    assert len(rows) == 7 and all(r["y"] - r["x"] == 100 and r["fk"] - r["x"] == 200 and r["side"] is None for r in rows)
    plain = P.capped_rows(df.select("x"), 7, ["x"], 42).collect()
    assert {r["x"] for r in plain} == {r["x"] for r in rows}


def test_class_quotas_are_exact(spark):
    many = {f"s{i}": 1 for i in range(300)} | {"big": 1000, "mid": 200}
    for counts in ({"a": 5000, "b": 3, "c": 1}, {"a": 10, "b": 10}, {"a": 700, "b": 400, "c": 50}, many):
        size = min(1024, sum(counts.values()) - 1)
        rows = P.class_quotas(spark.createDataFrame(list(counts.items()), "__label string, n long"), size).collect()
        got = {r["__label"]: r["__quota"] for r in rows}
        assert sum(got.values()) == size and all(1 <= got[c] <= counts[c] for c in counts)


def test_stratified_sets(spark):
    df = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    sets = P.stratified_exact(df, "y", ["k"], 1024, 3).groupBy("set_id").count().collect()
    assert {r["set_id"] for r in sets} == {0, 1, 2} and all(r["count"] == 1024 for r in sets)


def test_entity_clusters_fill_up(spark):
    df = spark.range(30).select(F.col("id").alias("k"), F.floor(F.col("id") / 3).alias("e"))
    assert P.entity_cluster_sample(df, "e", ["k"], 9).groupBy("e").count().filter("count = 3").count() == 3
    more = P.entity_cluster_sample(df, "e", ["k"], 50)
    assert more.count() == 50 and more.filter("copy = 0").count() == 30


def test_permutation_keeps_the_multiset(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 3).alias("a"), (F.col("id") * 3 + 1).alias("b"))
    out = P.corrupt_features(df, ["a"], ["k"], 1, together=True, also=["b"]).collect()
    assert sorted(r["a"] for r in out) == [3 * i for i in range(500)] and all(r["b"] == r["a"] + 1 for r in out)
    assert any(r["a"] != 3 * r["k"] for r in out)
    alone = P.corrupt_features(df, ["a", "b"], ["k"], 1).collect()
    assert any(r["b"] != r["a"] + 1 for r in alone)


def test_negatives_are_never_positives(spark):
    rows = spark.range(200).select((F.col("id") % 20).alias("u"), F.floor(F.col("id") / 20).alias("i"))
    out = P.eval_negatives(rows, rows, "i", 5, 3).collect()
    pos = {(r["u"], r["i"]) for r in out if r["label"] == 1}
    neg = {(r["u"], r["i"]) for r in out if r["label"] == 0}
    assert len(pos) == 200 and not pos & neg
    assert all(r["query_idx"] == r["u"] for r in out)


def test_upsert_keeps_the_newest(spark):
    a = spark.createDataFrame([("m", 1, 0.1), ("m", 2, 0.2)], "model string, seed int, v double")
    b = spark.createDataFrame([("m", 2, 0.9, "x")], "model string, seed int, v double, note string")
    got = {r["seed"]: (r["v"], r["note"]) for r in P.upsert([a, b], ["model", "seed"]).collect()}
    assert got == {1: (0.1, None), 2: (0.9, "x")}


def test_quantile_transform_is_normal(spark):
    x = np.random.default_rng(1).exponential(size=3000)
    df = spark.createDataFrame(pd.DataFrame({"k": range(3000), "x": x}))
    z = np.array([r["z"] for r in T.quantile_normal(df, "x", "z").orderBy("x").collect()])
    assert (np.diff(z) >= 0).all() and abs(z.mean()) < 0.02 and abs(np.std(z[30:-30]) - 1) < 0.1
    noisy = T.quantile_normal(df, "x", "z", noise=1e-3, key=["k"])
    assert noisy.agg(F.corr("x", "z")).first()[0] > 0.7


def test_power_transform(spark):
    x = np.random.default_rng(2).lognormal(size=4000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "k": np.ones(4000)}))
    fit = T.fit_power(df, ["x", "k"])
    assert "k" in fit.marked and "x" not in fit.marked
    grid = np.linspace(-3, 1, 4001)

    def likelihood(lam):
        y = np.log1p(x) if abs(lam) < 1e-12 else ((x + 1) ** lam - 1) / lam
        return -len(x) / 2 * math.log(y.var()) + (lam - 1) * np.log1p(x).sum()

    best = grid[np.argmax([likelihood(v) for v in grid])]
    assert fit.lambdas["x"] == pytest.approx(best, abs=0.01)
    out = fit.apply(df).agg(F.avg("x"), F.stddev_pop("x"), F.min("k")).first()
    assert out[0] == pytest.approx(0, abs=1e-6) and out[1] == pytest.approx(1, abs=1e-6) and out[2] == 1.0


def test_skewed_column_goes_to_normal_scores(spark):
    x = np.random.default_rng(3).exponential(size=2000) ** 3
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    assert T.fit_norm_numeric(df, "x").quantile is not None
    flat = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    fit = T.fit_norm_numeric(flat, "x")
    assert fit.quantile is None and fit.mean == pytest.approx(499.5)


def test_onehot_and_rare_aware_codes(spark):
    df = spark.range(400).select(F.when(F.col("id") < 395, "a").otherwise("z").alias("rare"),
                                 F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("two"))
    hot = T.encode_categorical(df, ["two"], "onehot")
    assert "two_y" in hot.columns and "two_x" not in hot.columns
    out = T.encode_categorical(df, ["rare", "two"], "ordinal_strict_feature_shuffled")
    assert dict(out.dtypes)["rare"] == "string" and dict(out.dtypes)["two"] == "bigint"


def test_drift_of_a_shift_and_of_itself(spark):
    a = spark.range(1000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    assert all(r["w1"] == pytest.approx(0, abs=1e-9) for r in Q.drift_w1(a, a, ["x", "y"]).collect())
    b = a.withColumn("x", F.exp(F.col("x") / 200))
    got = {r["feature"]: r["w1"] for r in Q.drift_w1(a, b, ["x", "y"]).collect()}
    xa, xb = np.arange(1000.0), np.exp(np.arange(1000.0) / 200)
    want = np.abs(np.sort((xa - xa.mean()) / xa.std(ddof=1)) - np.sort((xb - xb.mean()) / xb.std(ddof=1))).mean()
    assert got["x"] == pytest.approx(want, abs=1e-9) and got["y"] == pytest.approx(0, abs=1e-9)


def test_stage_b_zones(spark):
    x = np.random.default_rng(5).normal(size=(600, 2))
    pdf = pd.DataFrame({"k": range(600), "a": x[:, 0], "b": x[:, 1]})
    good = pdf.assign(task="good", y=(pdf.a > 0).astype(int))
    bad = pdf.assign(task="bad", y=np.random.default_rng(6).integers(0, 2, 600))
    both = spark.createDataFrame(pd.concat([good, bad]))
    got = {r["task"]: r for r in Q.stage_b(both, "task", ["k"], "y", ["a", "b"], trees=8, depth=4, draws=20).collect()}
    assert got["good"]["b_pass"] and got["good"]["auc"] > 0.9
    assert got["bad"]["auc"] < 0.62


def test_forests_keep_the_nodes_of_rows(spark):
    model = Q.forest(8, 4)()
    assert model.getCacheNodeIds() and model.getNumTrees() == 8 and model.getMaxDepth() == 4


def test_bootstrap_interval_covers_the_median(spark):
    df = spark.range(400).select(F.col("id").alias("u"), F.lit(0.0).alias("l"), (F.col("id") / 400).alias("r"))
    row = C.bootstrap_median_interval(df, "u", "l", "r", 100).first()
    assert row["draws"] == 100 and row["ci_low"] < 0.5 < row["ci_high"] and row["ci_high"] - row["ci_low"] < 0.2


def test_graph_rules(spark):
    from relweave.model import ColumnMeta, RelationalDataset, TableMeta

    meta = {
        "u": TableMeta("u", (ColumnMeta("id", "primary_key"),)),
        "f": TableMeta("f", (ColumnMeta("a", "foreign_key", "u.id"), ColumnMeta("b", "foreign_key", "u.id"), ColumnMeta("w", "float"))),
    }
    ds = RelationalDataset("g", {
        "u": spark.range(3), "f": spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.7), (-1, 2, 0.1), (None, 0, 0.2)], "a long, b long, w double")}, meta)
    edges = G.build_edges(ds)
    assert {(r["etype"], r["src"], r["dst"]) for r in edges.collect()} == {
        ("u:f:u", 0, 1), ("u:f:u", 1, 0), ("u:f:u", 1, 2), ("u:f:u", 2, 1)}
    assert G.edge_features(ds, "f").filter("ts <> 0").count() == 0
    with pytest.raises(ValueError):
        _ = TableMeta("t", (ColumnMeta("a", "primary_key"), ColumnMeta("b", "primary_key"))).primary_key


def test_hub_sampling_respects_fanout_and_time(spark):
    edges = spark.range(900).select(
        F.lit("o:x:c").alias("etype"), F.lit("o").alias("src_type"), F.col("id").alias("src"), F.lit("c").alias("dst_type"),
        F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 10).cast("long").alias("dst"))
    times = spark.range(900).select(F.lit("o").alias("node_type"), F.col("id").alias("node"), F.col("id").alias("ts"))
    seeds = spark.createDataFrame([("c", 0, 100), ("c", 5, 700)], "node_type string, node long, seed_ts long")
    out = G.neighbor_sample_temporal(edges, times, seeds, [20]).collect()
    assert sum(r["dst"] == 0 for r in out) == 20 and all(r["src"] <= r["seed_ts"] for r in out)
    every = G.neighbor_sample_temporal(edges, times, seeds, [None])
    assert every.filter("dst = 0").count() == 101
    late = G.neighbor_sample(edges, times, seeds.select("node_type", "node"), [None], threshold=650)
    assert late.agg(F.max("src")).first()[0] == 650


def test_hot_group_paths_agree(spark, monkeypatch):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 11).cast("string"))).alias("g"),
        (F.col("id") * 7919 % 4001).alias("v"), F.lit(1).alias("n"))
    calls = {
        "numbered": lambda: O.numbered(df, ["v"], ["g"], total="t"),
        "hashed": lambda: O.numbered_by_hash(df.withColumn("h", S.stable_hash(1, "v")), "h", ["v"], ["g"], total="t"),
        "prefix": lambda: O.prefix_sums(df, "v", {"b": "n"}, ["g"], {"t": "n"}, previous="p"),
        "global": lambda: O.prefix_sums(df, "v", {"b": "n"}, (), {"t": "n"}, previous="p"),
    }
    for name, make in calls.items():
        monkeypatch.setattr(O, "HOT_GROUP_ROWS", 1_000_000)
        plain = sorted(tuple(r) for r in make().fillna(-1).collect())
        monkeypatch.setattr(O, "HOT_GROUP_ROWS", 500)
        hot = sorted(tuple(r) for r in make().fillna(-1).collect())
        assert plain == hot, name
    monkeypatch.setattr(O, "MAX_BROADCAST_GROUPS", 0)
    assert sorted(tuple(r) for r in O.numbered(df, ["v"], ["g"]).collect()) == sorted(
        tuple(r) for r in O.numbered(df.repartition(5), ["v"], ["g"]).collect())


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(O, "MIN_BUCKETS", 512)
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("v"), F.col("id").cast("string").alias("s"))
    got = O.numbered(df, ["v"]).filter("rn <> v + 1").count()
    assert got == 0
    texts = [r["s"] for r in O.numbered(df, ["s"]).orderBy("rn").collect()]
    assert texts == sorted(texts)
    pairs = O.numbered(df.select((F.col("v") % 3).alias("a"), "s"), ["a", "s"]).orderBy("rn").collect()
    assert [(r["a"], r["s"]) for r in pairs] == sorted((r["a"], r["s"]) for r in pairs)


def test_constant_sides_give_null(spark):
    from relweave.operators import metrics as M, structure as A

    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.5), (3.0, 5.0, 6.0)], "a double, b double, c double")
    r = {(x["a"], x["b"]): x["r"] for x in A.pairwise_corr(df, ["a", "b", "c"]).collect()}
    assert r[("a", "b")] is None and r[("b", "c")] is None and 0.9 < r[("a", "c")] <= 1
    assert [x["feature"] for x in A.feature_label_corr(df, ["a", "b"], "c").collect()] == ["a"]
    row = M.regression_metrics(df, "b", "a").first()
    assert row["pearson"] is None and row["r2"] is None and row["mae"] == 3
    row = M.regression_metrics(df.withColumn("a", -F.col("a")), "c", "a").first()
    assert row["msle"] is None


def test_average_precision_without_positives(spark):
    from relweave.operators import metrics as M

    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, s double")
    assert M.average_precision(df, F.col("y") == 1, "s").first()["ap"] is None


@pytest.mark.parametrize("hot", [1_000_000, 100])
def test_nulls_come_first_in_an_order(spark, monkeypatch, hot):
    from relweave.plans import ordering

    monkeypatch.setattr(ordering, "HOT_GROUP_ROWS", hot)
    df = spark.range(900).select(F.col("id").cast("double").alias("x"), F.lit(1).alias("g")).unionByName(
        spark.createDataFrame([(None, 1), (float("nan"), 1)], "x double, g int"))
    got = {r["x"]: r["rn"] for r in ordering.numbered(df, ["x"], ["g"]).collect() if r["x"] is None or r["x"] == r["x"]}
    assert got[None] == 1 and got[0.0] == 2 and got[899.0] == 901


@pytest.mark.parametrize("hot", [1_000_000, 20])
def test_fingerprints_do_not_depend_on_the_group_size(spark, monkeypatch, hot):
    from relweave.operators import features as X
    from relweave.plans import ordering

    monkeypatch.setattr(ordering, "HOT_GROUP_ROWS", hot)
    df = spark.range(200).select("id", F.lit("same").alias("v"))
    got = sorted((r["id"], r["fingerprint"]) for r in X.row_fingerprint(df, ["v"], "id").collect())
    assert len({f for _, f in got}) == 200
    expected = getattr(test_fingerprints_do_not_depend_on_the_group_size, "seen", got)
    test_fingerprints_do_not_depend_on_the_group_size.seen = got
    assert got == expected


def test_key_chains_of_any_length_and_cycles(spark):
    from relweave.sources import inference as I

    chain = [("d", f"t{i}", f"t{i + 1}") for i in range(5)]
    tables = spark.createDataFrame([("d", f"t{i}") for i in range(6)], "db string, table_name string")
    assert I.schema_topology(tables, spark.createDataFrame(chain, "db string, child string, parent string")).first()["depth"] == 5
    with pytest.raises(ValueError):
        I.schema_topology(tables, spark.createDataFrame(chain + [("d", "t5", "t0")], "db string, child string, parent string"))


def test_columns_of_nulls_keep_a_row(spark):
    from relweave.sources import inference as I

    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert {r["column"] for r in I.infer_dtypes(df).collect()} == {"a", "b"}


def test_pivot_names_must_be_complete(spark):
    from relweave.operators import compare as C

    rows = spark.createDataFrame([("m", "d", f"t{i}", 0, 0.5) for i in range(3)], "model string, dataset string, task string, seed int, metric_value double")
    assert len(C.results_pivot(rows).columns) == 5
    with pytest.raises(ValueError):
        C.results_pivot(rows, names=["d/t0"])
