"""Whitening, packing and the filter audit against brute force, with odd rows."""

import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from relweave.llm import audit, packing, whitening

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("x", "m", "c", "y", "i", "width", "deviation", "n", "label"):  # names used inside
        df = df.withColumn(c, F.lit("other"))
    return df


# ---------------------------------------------------------------- whitening


def brute_whiten(rows, most, weights="count"):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, tuple(math.floor(64 * c) + 1000000 for c in v)) for i, v in good]
    fit = [v for _, v in x] if weights == "count" else sorted({v for _, v in x})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array([[v - t / n for v, t in zip(row, s)] for row in fit])
    values, axes = np.linalg.eigh(a.T @ a / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, v in x:
        y = (np.array([c - t / n for c, t in zip(v, s)]) @ axes)[:most] / np.sqrt(values[:most])
        out.setdefault(i, []).append((n, sum((n * c - t) ** 2 for c, t in zip(v, s)), y))
    return out, values / values.sum()


@pytest.mark.parametrize("weights", ["count", "one"])
def test_whitening_matches_numpy(spark, weights):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(90, 6)) * [3, 2, 1.5, 1, 0.7, 0.4]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(200 + i, base[3].tolist()) for i in range(60)] + [(7, base[9].tolist()), (None, base[1].tolist())]
    rows += [(300, None), (301, []), (302, [1.0] * 5 + [None]), (303, [math.nan] * 6), (304, [math.inf] + [0.0] * 5), (305, [0.0] * 6)]
    got = whitening.whiten(vectors(spark, rows), 4, weights).collect()
    want, shares = brute_whiten(rows, 4, weights)
    assert len(got) == 4 * sum(map(len, want.values()))
    signs = {}
    for r in got:
        options = want[r["vec_id"]]
        value = r["whitened"]
        close = [o for o in options if o[1] == int(r["deviation"])]
        assert close and r["n"] == close[0][0]
        expected = close[0][2][r["component"] - 1]
        signs.setdefault(r["component"], set()).add(round(value / expected) if abs(expected) > 1e-6 else None)
        assert abs(abs(value) - abs(expected)) < 1e-8
        assert r["explained"] == pytest.approx(shares[r["component"] - 1], rel=1e-9)
        assert r["identity_error"] < 1e-9
    assert all(len(s - {None}) == 1 for s in signs.values())


def test_whitening_without_variance_lengths_and_rows(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    one = whitening.whiten(vectors(spark, [(1, [0.5, 2.0])])).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in one] == [
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    # a constant dimension has no component; vectors of the rarer length take no part
    got = whitening.whiten(vectors(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [0.5, 1.0]), (4, [1.0])])).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3}
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True)}
    assert got[0]["identity_error"] < 1e-12


def test_whitening_digits_survive_a_large_shift(spark):
    rows = [(i, [1e9 + i / 64, 2e9 - (i % 3) / 64]) for i in range(40)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    want, _ = brute_whiten(rows, 2)
    assert all(int(r["deviation"]) == want[r["vec_id"]][0][1] for r in got)
    assert got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("n", [7, 10**6, 10**12])
def test_deviation_is_exact_at_every_size(n):
    x = np.array([[1000000 + i * j for j in range(5)] for i in range(9)], dtype=np.int64)
    sums = [1000003 * n + j for j in range(5)]
    want = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    assert whitening._deviation(x, n, sums) == want


# ---------------------------------------------------------------- packing


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tok():
    return packing.ByteTokenizer(VOCABULARY)


ODD = [" ", "  ", "\n", "\t ", "a", "It's", "'s", "12", "é", "汉字", ".", "\u00a0", "\u3000", "\x1c", "\x85", "Word", "<|endoftext|>", "🙂", "½", "Ⅷ", "\u0301", "\u200b"]


@settings(max_examples=500, deadline=None)
@given(parts=st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=3)), max_size=25))
def test_ranks_give_the_ids_of_the_library(tok, whole, parts):
    text = "".join(parts)
    assert tok.ids(text).tolist() == whole(text)


def test_every_character_is_split_alike(tok, whole):
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 5000):
        text = "".join(f"a{c}1 {c}{c} .{c}\n" for c in chars[i:i + 5000])
        assert tok.ids(text).tolist() == whole(text)


def test_rounds_keep_every_id(monkeypatch, tok, whole):
    monkeypatch.setattr(packing, "ROUND_CHARS", 40)
    rng = random.Random(2)
    text = "".join(rng.choice(["abc", " ", " ", "\n", "  ", "Zeit", "ß", "don't", "x" * 60]) for _ in range(900))
    assert "".join(tok.rounds(text)) == text and len(list(tok.rounds(text))) > 5
    assert tok.ids(text).tolist() == whole(text)
    assert tok.ids("y" * 200).tolist() == whole("y" * 200)


@pytest.mark.parametrize("batch", [1, 100, 1 << 19])
def test_packing_matches_the_plain_cut(spark, whole, batch, monkeypatch):
    monkeypatch.setattr(packing, "BATCH_TOKENS", batch)  # where the tasks get it from is the pickled function
    rng = random.Random(1)
    words = ["the", "cat", "sat", "Zürich", "naïve", "12,5", "don't", "\n", "", "汉字"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 5, 60, 300, 2500)]
    rows = [*enumerate(texts), (6, None), (7, ""), (None, "no id"), (2, "a repeated id"), (2, "a repeated id"), (8, "<|endoftext|> as text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("ids", "start", "length", "bucket", "offset", "sequence_id"):
        df = df.withColumn(c, F.lit("other"))
    out = packing.pack_documents(df, VOCABULARY, 64).collect()
    assert len({r["sequence_id"] for r in out}) == len(out) and {r["offset"] for r in out} == {0}
    got = {}
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["length"] == len(r["ids"]) == r["bucket"] and r["length"] in {1, 2, 4, 8, 16, 32, 64}
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    want = {}
    for i, t in rows:
        ids = [*whole(t or ""), 1]
        want.setdefault((i, len(ids)), []).append(ids)
    assert set(got) == set(want)
    for key, texts_ in want.items():
        for copy in range(len(texts_)):  # equal rows have equal pieces
            pieces = got[key][copy::len(texts_)]
            assert [x for p in pieces for x in p["ids"]] == texts_[0]
            assert [p["start"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces]])[:-1].tolist()
            assert len(pieces) == key[1] // 64 + bin(key[1] % 64).count("1")
    assert packing.pack_documents(df.limit(0), VOCABULARY).collect() == []
    with pytest.raises(ValueError):
        packing.pack_documents(df, VOCABULARY, 100)


def test_bucket_folders_hold_one_length(spark):
    df = spark.createDataFrame([(i, "word " * i) for i in range(50)], "doc_id long, text string")
    out = packing.pack_documents(df, VOCABULARY, 16)
    files = out.select(F.input_file_name().alias("f"), "length").distinct().collect()
    assert all(f"bucket={r['length']}/" in r["f"] for r in files)


# ---------------------------------------------------------------- filter audit


def brute_audit(docs, labels):
    least = {}
    for d, _, t in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    rows = []
    for d, s, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and least[t] < d}
        mine = [x for x in labels if d is not None and x[0] == d]
        rows.append((s or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_at = {}
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                removed_at[order, step] = (len(left), len(gone), sum(r[1][f] for r in mine) - len(gone),
                                           sum(r[1][f] and sum(r[1].values()) == 1 for r in mine),
                                           sum(r[2] for r in gone), sum(r[3] for r in gone))
        for (order, step), v in removed_at.items():
            shapley = sum(x[1] for (o, s), x in removed_at.items() if o[s] == order[step])
            out.append((part, "".join(order), step + 1, *v, shapley))
    return sorted(out)


def audit_tables(spark, docs, labels):
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    lf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for c in ("part", "mask", "key", "good", "toxic", "least", "c"):
        df = df.withColumn(c, F.lit("other"))
    for c in ("part", "mask", "good", "text"):
        lf = lf.withColumn(c, F.lit("other"))
    return df, lf


def test_audit_matches_brute_force(spark):
    rng = random.Random(4)

    def text():
        n = rng.choice([3, 40, 60, 120])
        pool = [f"w{i}" for i in range(rng.choice([20, 500]))]
        words = [rng.choice(pool) for _ in range(n)]
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        if rng.random() < 0.3:
            words[0] = "#"
        return rng.choice([" ", "\n", "\t "]).join(words)

    pool = [text() for _ in range(60)]
    docs = [(i, rng.choice(["a", "b", None, ""]), rng.choice(pool)) for i in range(200)]
    docs += [(500, "a", None), (501, "b", ""), (502, "a", None), (None, "a", pool[0]), (None, "b", pool[0]), (3, "b", pool[1]), (3, "b", pool[1])]
    labels = [(i, rng.choice([0, 1, None, 2]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    got = audit.audit_filters(*audit_tables(spark, docs, labels))
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    df, lf = audit_tables(spark, [], [])
    assert audit.audit_filters(df, lf).collect() == []
    df, lf = audit_tables(spark, [(1, None, None)], [])
    out = audit.audit_filters(df, lf).collect()
    assert len(out) == 600 and {r["part"] for r in out} == {""}
    assert {(r["filter_order"][r["step"] - 1], r["unique_fails"]) for r in out} == {("A", 1), ("B", 0), ("C", 0), ("D", 0), ("E", 0)}


def test_counters_do_not_overflow():
    fields, wide = audit.step_counters()
    assert len(fields) == 600
    most = 2**63 - 1
    assert audit.unpack(most * wide[0]["kept"], 600) == [most] * 600
