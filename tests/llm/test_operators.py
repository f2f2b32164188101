"""Small fixtures against brute force: nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import time
import timeit
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relweave.llm import decontaminate, licenses, lines, mixing, nearcopies, neighbours, pages, substrings, toxicity, warc

WORDS = [f"w{i:03d}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # names that operators use inside
        for c in ("score", "digest", "g", "v", "n", "key", "comp", "row", "y", "source", "kept"):
            df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# ---------------------------------------------------------------- repeated strings


def brute_repeats(rows):
    where = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                where[b[i:i + 50]] = min(where.get(b[i:i + 50], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if d is not None and where[b[i:i + 50]] < d:
                gone[i:i + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
        out.append((d, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=repr)


def test_repeated_strings_match_brute_force(spark):
    rng = random.Random(3)
    shared, tail = prose(rng, 30), "é" * 60
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(30)]
    rows += [(40 + i, prose(rng, 20) + shared[i:] + prose(rng, 5)) for i in range(12)]
    rows += [(60, shared[:49]), (61, shared[:50]), (62, shared), (62, shared), (63, "a" * 3000), (64, "b" + "a" * 200), (65, tail), (66, "x" + tail)]
    rows += [(70, None), (71, ""), (None, shared), (None, None), (7, "other text of a repeated id " + shared)]
    got = substrings.remove_repeats(docs_frame(spark, rows, True)).collect()
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got), key=repr) == brute_repeats(rows)
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_repeated_strings_are_compared_in_shares(spark, monkeypatch):
    # the runs of all buckets and the texts of all documents were shuffled at once
    monkeypatch.setattr(substrings, "SHARE_ROWS", 1)
    monkeypatch.setattr(substrings, "_HELD", 500)
    shares, moved, plain, joined = [], [], substrings.Scratch.save_shares, substrings.map_batches
    monkeypatch.setattr(substrings.Scratch, "save_shares", lambda self, df, key, n: shares.append(n) or plain(self, df, key, n))
    monkeypatch.setattr(substrings, "map_batches", lambda df, fn, schema: moved.append(joined(df, fn, schema)) or moved[-1])
    rng = random.Random(11)
    shared = prose(rng, 30)
    rows = [(i, prose(rng, 60)) for i in range(20)] + [(30 + i, prose(rng, 20) + shared[i:] + prose(rng, 5)) for i in range(8)] + [(None, shared), (50, None)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got), key=repr) == brute_repeats(rows)
    assert shares[0] == 8
    texts = [df for df in moved if df.columns == ["doc_id", "v", "size", "data"]]
    assert len(texts) == 1 and 7 <= texts[0].count() <= 8


def test_texts_of_runs_compared_string_by_string_are_not_moved(spark, monkeypatch):
    read, plain = [], substrings.map_batches
    monkeypatch.setattr(substrings, "map_batches", lambda df, fn, schema: read.append(df) or plain(df, fn, schema))
    rng = random.Random(5)
    shared = prose(rng, 30)
    docs = spark.createDataFrame([(i, prose(rng, 20) + shared[i:] + prose(rng, 5)) for i in range(12)], "doc_id long, text string")
    assert substrings.repeated_spans(docs).count() == 11
    texts = [df for df in read if "text" in df.columns]
    assert texts and all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in texts)


# ---------------------------------------------------------------- lines


def brute_lines(rows, least=40, documents=5):
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            k = lines.line_key(x)
            if len(k) >= least and d is not None:
                held.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        keep = []
        for x in parts:
            own = held.get(lines.line_key(x), set())
            if d is None or len(own) < documents or d == max(own):
                keep.append(x)
        out.append((d, len(parts), len(parts) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def test_lines_match_brute_force(spark):
    long = "This Line of More than Forty Characters comes again É"
    rows = [(i, f"own {i}\n \t{long.upper() if i % 2 else long}\r\n{long}" + ("\n" + "z" * 45 if i < 4 else "")) for i in range(9)]
    rows += [(20, None), (21, ""), (None, long), (3, long), (30, "y" * 39 + "\n" + "q " * 40000), (31, "short")]
    df = docs_frame(spark, rows, True)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in lines.dedup_lines(df).collect()), key=repr)
    assert got == brute_lines(rows)
    kept = lines.drop_repeated_lines(df.withColumn("n_chars", F.length("text").cast("long")))
    assert kept.columns == [*df.columns, "n_chars"] and kept.count() == len(rows)
    assert sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=repr) == sorted(((d, x) for d, _, _, x in brute_lines(rows)), key=repr)
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_keys_of_lines_beyond_ascii_cost_about_as_much_as_others():
    def seconds(text):
        return min(timeit.repeat(lambda: lines._digests(text, 40), number=1, repeat=7, timer=time.process_time))

    plain = "\n".join(["An Ordinary line of Words " * 12] * 3000)
    other = "\n".join(["\u00c4n Ordin\u00e4ry \u0130 line \u212a " * 12] * 3000)
    assert seconds(other) < 8 * seconds(plain)
    keys = [lines.line_key(x).encode() for x in (plain + "\n" + other).split("\n")]
    want = [(hashlib.blake2b(k, digest_size=16).digest(), i) for i, k in enumerate(keys)]
    assert lines._digests(plain + "\n" + other, 40) == want


# ---------------------------------------------------------------- near copies


def brute_classes(rows, weights):
    vec = {}
    for d, t in rows:
        _, h, w = nearcopies.weighted_shingles([t], weights)
        vec.setdefault(d, []).append(dict(zip(h.tolist(), w.tolist())))
    comp = {d: d for d in vec}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(vec)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            for x in vec[a]:
                for y in vec[b]:
                    both = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
                    total = sum(x.values()) + sum(y.values()) - both
                    if total and both / total >= 0.8:
                        p, q = sorted((find(a), find(b)))
                        comp[q] = p
    return {d: find(d) for d in ids}


def test_near_copies_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 80)) for i in range(20)]
    for j in range(20):  # a group of copies with a few words changed each
        w = rows[0][1].split()
        for _ in range(j % 3):
            w[rng.randrange(len(w))] = "changed"
        rows.append((100 + j, " ".join(w)))
    passage = prose(rng, 60)  # a passage that many texts share, without being copies
    rows += [(200 + i, passage + " " + prose(rng, 60)) for i in range(30)]
    rows += [(300, rows[5][1].upper() + "!"), (301, "one two"), (302, "One, two"), (303, ""), (304, ""), (305, None), (5, rows[5][1])]
    df = docs_frame(spark, rows, True)
    weights = nearcopies.shingle_weights(df)
    got = {r["doc_id"]: r["class_id"] for r in nearcopies.near_copies(df).collect()}
    assert got == brute_classes(rows, weights)
    assert got[301] == got[302] and got[303] == 303 and got[304] == 304
    with_null = nearcopies.near_copies(docs_frame(spark, [(None, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert sorted((r[0], r[1]) for r in with_null if r[0]) == [(1, 1)] and len(with_null) == 2
    assert nearcopies.near_copies(empty(spark)).count() == 0
    one = nearcopies.keep_one(df)
    assert one.columns == df.columns and {r["doc_id"] for r in one.select("doc_id").collect()} == {d for d, c in got.items() if c == d}


def test_near_copies_in_buckets_of_a_shared_passage(spark):
    """A pair that meets in no bucket but those which a passage of 80 other texts fills. No draw of a
    centre by ``xxhash64(node, turn)`` picks its ids early."""
    rng = random.Random(377)
    passage = prose(rng, 79)
    rows = [(i, passage + " " + prose(rng, 24)) for i in range(80)]
    common = prose(rng, 16)
    rows += [(i, f"{passage} {common} {prose(rng, 6)}") for i in (2547, 4054)]
    df = docs_frame(spark, rows)
    got = {r["doc_id"]: r["class_id"] for r in nearcopies.near_copies(df).collect()}
    assert got == brute_classes(rows, nearcopies.shingle_weights(df)) and got[4054] == 2547


def test_rows_made_grow_in_line_with_a_group(spark, monkeypatch):
    """A group of texts alike but no copies: what leaves the blocks is members, never pairs."""
    seen = []
    plain = nearcopies._forest

    def forest(candidates, texts, tools):
        out = plain(candidates, texts, tools)
        seen.append((candidates.count(), out.count()))
        return out

    monkeypatch.setattr(nearcopies, "_forest", forest)
    rng = random.Random(21)
    passage = prose(rng, 90)
    for n in (60, 240):
        rows = [(i, passage + " " + prose(rng, 13)) for i in range(n)]
        assert nearcopies.near_copies(docs_frame(spark, rows)).select("class_id").distinct().count() == n
    assert all(rows <= n * nearcopies.BANDS and links == 0 for n, (rows, links) in zip((60, 240), seen)) and seen[0][0] > 60


def test_blocks_of_a_bucket_meet_all_others(spark, monkeypatch):
    rng = random.Random(9)
    first = prose(rng, 80)
    rows = [(i, first + " " + prose(rng, 3)) for i in range(40)]
    rows += [(100 + i, first + " " + prose(rng, 30)) for i in range(60)]
    df = docs_frame(spark, rows)
    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", 7)
    got = {r["doc_id"]: r["class_id"] for r in nearcopies.near_copies(df).collect()}
    assert got == brute_classes(rows, nearcopies.shingle_weights(df))


def test_samples_agree_as_often_as_texts_are_similar():
    rng = random.Random(1)
    weights = np.linspace(1, 2, nearcopies.COUNTERS).astype(np.float32)
    tables = nearcopies.draw_tables()
    gap = []
    for _ in range(40):
        a = prose(rng, 120).split()
        b = a[:90] + prose(rng, 30).split()
        d, h, w = nearcopies.weighted_shingles([" ".join(a), " ".join(b)], weights)
        s = nearcopies.signatures(2, d, h, w, tables)
        gap.append((s[0] == s[1]).mean() - nearcopies.jaccard(h[d == 0], w[d == 0], h[d == 1], w[d == 1]))
    assert abs(np.mean(gap)) < 0.04


# ---------------------------------------------------------------- decontamination


def brute_leaks(docs, items):
    out = set()
    for i, t in items:
        if i is None or not t:
            continue
        w = decontaminate.words([t])
        n = len(w.hash)
        if not n:
            continue
        k = min(5, n)
        s = decontaminate.shingles(w, k)
        for d, x in docs:
            v = decontaminate.words([x])
            if len(v.hash) < n:
                continue
            r = decontaminate.shingles(v, k)
            m = n - k + 1
            if max(decontaminate.weighted_jaccard(r.hash[p:p + m], r.size[p:p + m], s.hash, s.size) for p in range(len(v.hash) - n + 1)) >= 0.8:
                out.add((d, i))
    return out


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randint(6, 40))) for i in range(12)] + [(20, "tiny item"), (21, None), (22, ""), (None, "no id at all here"), (23, prose(rng, 5))]
    docs = [(i, prose(rng, 120)) for i in range(20)]
    for j in range(12):
        w = items[j][1].split()
        if j % 2 and len(w) > 30:
            w[len(w) // 2] = "changed"
        docs.append((50 + j, prose(rng, 40) + ". " + " ".join(w).upper() + "\n" + prose(rng, 10)))
    docs += [(80, "a tiny, item here"), (81, None), (82, ""), (83, items[-1][1]), (50, docs[20][1]), (84, prose(rng, 30000) + " " + items[3][1])]
    df = docs_frame(spark, docs, True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(df, bench).collect()}
    want = brute_leaks(docs, items)
    assert got == want and len(want) >= 12
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.find_contamination(empty(spark), bench).count() == 0
    assert decontaminate.find_contamination(df, bench.limit(0)).count() == 0


def test_decontamination_of_shortened_items(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, n)) for i, n in enumerate((40, 40, 25, 12, 6, 5))]
    docs = [(100 * i + cut, " ".join(t.split()[cut // 2:len(t.split()) - cut + cut // 2])) for i, t in items for cut in (0, 1, 2, 4, 7, 10) if cut < len(t.split())]
    want = set()
    for d, x in docs:
        for i, t in items:
            v, w = decontaminate.words([x]), decontaminate.words([t])
            if len(v.hash) >= 5:
                r, s = decontaminate.shingles(v, 5), decontaminate.shingles(w, 5)
                m = min(len(r.hash), len(s.hash))
                if max(decontaminate.weighted_jaccard(r.hash[p:p + m], r.size[p:p + m], s.hash, s.size) for p in range(len(r.hash) - m + 1)) >= 0.8:
                    want.add((d, i, min(len(v.hash), len(w.hash))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_frame(spark, docs)
    got = {(r["doc_id"], r["item_id"], r["n_words"]) for r in decontaminate.find_contamination(df, bench).collect()}
    assert got == want and {(1, 0, 39), (4, 0, 36), (101, 1, 39)} <= want and (10, 0, 30) not in want
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _, _ in want}


# ---------------------------------------------------------------- nearest products


def test_neighbours_reach_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16)).round(3)
    x[100:130] = x[99]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("x", F.lit("a"))
    got = {}
    for r in neighbours.nearest_products(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        best = [int(i) for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        own = [v for _, v, _ in sorted(got[q])]
        assert len(own) == 20 and [r for r, _, _ in sorted(got[q])] == list(range(1, 21))
        hit += len(set(own) & set(best))
        total += 20
        assert all(abs(sc - float(s[v])) < 1e-9 for _, v, sc in got[q])
    assert set(got) == set(range(0, 1500, 20)) and hit / total >= 0.95
    assert neighbours.nearest_products(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = df.filter("vec_id < 3")
    assert neighbours.nearest_products(few, F.col("vec_id") == 0).count() == 2


# ---------------------------------------------------------------- pages


ARTICLE = "<article><h1>A &amp; B</h1><p>one\n  two &lt;x&gt;<p><b>three</b> four<div class='ad'>buy</div><p>five</article>"


def test_page_text():
    assert pages.main_text(f"<html><head><title>t</title><script>'<p>no'</script></head><body><nav><li><a href=x>Menu</a></nav>{ARTICLE}<aside>side</aside><div id='comments'><p>great post, thanks for writing all of this</div><footer>&copy; me</footer>") == "A & B\none two <x>\nthree four\nfive"
    body = "word " * 40
    page = f"<div class=menu><a>a</a></div><div class='cookie-notice'>We use cookies</div><h2>Title</h2><p>{body}</p><p>short.</p><form>mail <input></form><div><a>x</a> <a>y</a></div>"
    assert pages.main_text(page) == f"Title\n{body.strip()}\nshort."
    assert pages.main_text(None) == "" and pages.main_text("") == "" and pages.main_text("<p") == ""
    assert pages.main_text("a" * 300_000) == "a" * 300_000


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", ARTICLE), (1, "u", ARTICLE), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = pages.extract_pages(df).collect()
    assert len(rows) == 3 and sum(r["n_chars"] == 0 for r in rows) == 1
    assert pages.extract_pages(df.limit(0)).count() == 0


# ---------------------------------------------------------------- archives


def test_archives_round_trip(spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.1\r\nbody</p>" * 20
    rows = [(5, "http://a\r\nX: 1", big), (3, None, big), (9, "u", big), (3, "again", big), (1, "u", "x"), (2, "u", "x"), (4, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "z" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))
    path = f"file://{tmp_path}/archive"
    warc.write_archives(warc.mark_revisits(df), path)
    got = warc.resolve_revisits(warc.read_archives(spark, path)).collect()
    out = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got), key=repr)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        later = h == big and i is not None and i > 3
        want.append((i, "revisit" if later else "response", 3 if later else None, len(b), hashlib.sha256(b).hexdigest()))
    assert out == sorted(want, key=repr)


# ---------------------------------------------------------------- mixing


def test_mixing_hits_its_targets(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.choice(["b", "a", "a", "a", None, "Z"]), prose(rng, rng.randint(0, 30))) for i in range(600)]
    rows += [(700, "a", None), (None, "b", "x y"), (1, "a", "again"), (1, "a", "again")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit(0))

    def run():
        return [r.asDict() for r in mixing.mix_sources(df).collect()]

    got = run()
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    again = run()
    key = lambda r: repr(sorted(r.items()))
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)  # targets joined, not broadcast
    joined = run()
    assert sorted(got, key=key) == sorted(again, key=key) == sorted(joined, key=key) and len(got) == len(rows)
    total = sum(r["size"] for r in got)
    sources = {r["source"]: (r["source_size"], r["target"]) for r in got}
    assert abs(sum(t for _, t in sources.values()) - 1.5 * total) < 1e-6
    for s, (size, target) in sources.items():
        assert target <= 2 * size + 1e-9
        assert sum(r["taken"] for r in got if r["source"] == s) == int(target + 1e-9)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix_sources(df.limit(0)).count() == 0


# ---------------------------------------------------------------- licences


def test_size_bounds_are_tight():
    for n in range(1, 60):
        lo, hi = licenses.size_bounds(n, 0.85)
        assert all((2 * min(n, m) / (n + m) >= 0.85) == (lo <= m <= hi) for m in range(1, 200))


def test_witnesses_are_in_every_match():
    rng = random.Random(5)
    grams = [licenses.template_bigrams(t) for _, t in licenses.TEMPLATES]
    words = licenses.witnesses(grams, licenses.THRESHOLD)
    assert words and all(len(w) >= 4 for w in words)
    for g in grams:
        for _ in range(300):
            # any subset that could still reach the threshold, however the missing ones are chosen
            need = min(m for m in range(1, len(g) + 1) if 2 * m >= licenses.THRESHOLD * (m + len(g)))
            kept = rng.sample(g, need) if rng.random() < 0.5 else sorted(g, key=lambda b: (any(w in b for w in words), rng.random()))[:need]
            assert any(w in b for b in kept for w in words)
    assert licenses.witnesses([["a b"]], 0.85) in (["a"], ["b"])
    assert licenses.witnesses([], 0.85) == []


def test_licence_scan(spark):
    mit = licenses.TEMPLATES[5][1]
    rows = [(1, "prose\nReleased under the MIT license!\nmore"), (2, mit.replace(", ", ",\n")), (3, None), (4, ""), (5, "nothing of the kind"), (None, "Licensed under CC BY-NC 4.0."), (6, "intro\n\n" + mit.replace(" to ", " to\n") + "\n\nend")]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs_frame(spark, rows, True)).collect()}
    assert (1, "MIT") in got and (6, "MIT") in got and (None, "CC-BY-NC-4.0") in got and {d for d, _ in got} == {1, 2, 6, None}
    assert licenses.scan_licenses(empty(spark)).count() == 0
    plan = licenses.scan_licenses(docs_frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# ---------------------------------------------------------------- toxicity


def brute_segments(score):
    """Maximal segments by their definition: best segment, then left and right of it."""
    def best(lo, hi):
        found = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += score[j]
                if total > 0 and (found is None or total > found[0] + 1e-9):
                    found = (total, i, j + 1)
        return [] if found is None else best(lo, found[1]) + [found] + best(found[2], hi)

    return best(0, len(score))


def test_segments_match_their_definition():
    rng = np.random.default_rng(6)
    for _ in range(200):
        score = rng.normal(-0.3, 1, rng.integers(0, 25))
        got = toxicity.maximal_segments(score)
        assert sorted((a, b) for _, a, b in got) == sorted((a, b) for _, a, b in brute_segments(score))


def test_toxicity_learns_and_keeps_clean_rows(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, prose(rng, 60) + (" vile awful scum " if bad else " ") + prose(rng, 20)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (None, "vile awful scum"), (3, rows[3][1]), (902, prose(rng, 50_000))]
    df, lab = docs_frame(spark, rows, True), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    out = {r["doc_id"]: r for r in toxicity.score_documents(df, model).collect()}
    for i, y in labels:
        if zlib.crc32(str(i).encode()) % 3 == 1:
            assert (out[i]["score"] >= 0.7) == bool(y)
    assert out[900]["score"] < 0.5 and out[901]["n_words"] == 0 and out[902]["score"] < 0.7
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and {900, 901, 902, 3} <= {r["doc_id"] for r in kept.select("doc_id").collect()}
    odd = lab.unionByName(spark.createDataFrame([(10_000 + i, v) for i, v in enumerate((2, -1, 7))] + [(i, 2) for i in range(0, 30)], "doc_id long, toxic int"))
    assert toxicity.fit(df, odd).score.tolist() == model.score.tolist()  # other labels say nothing
    nothing = toxicity.fit(df, lab.limit(0))
    assert all(r["score"] == pytest.approx(0.0, abs=1e-9) for r in toxicity.score_documents(df.limit(5), nothing).collect())
    assert toxicity.score_documents(empty(spark), model).count() == 0


def test_buckets_of_blocks_are_those_of_the_whole():
    from relweave.llm import substrings

    b = np.random.default_rng(1).integers(0, 3, 2 * substrings._BLOCK + substrings.FIRST + 5).astype(np.uint8)
    _, first = substrings.bucket_ids(b)
    at = np.array([0, substrings._BLOCK - 1, substrings._BLOCK, 2 * substrings._BLOCK, len(first) - 1])
    assert len(first) == len(b) - substrings.FIRST + 1
    assert [substrings.bucket_ids(b[i:i + substrings.FIRST])[1][0] for i in at] == first[at].tolist()


def test_texts_that_no_bucket_wants_are_not_moved(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    got = {r["doc_id"]: r["text"] for r in nearcopies._likely(docs, spark.range(0, 2000, 10).withColumnRenamed("id", "node")).collect()}
    assert set(range(0, 2000, 10)) <= set(got) and len(got) < 250 and got[10] == "t10"
