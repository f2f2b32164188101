"""Benchmark passages in documents: SimHash windows, multi-index Hamming blocks, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relweave.llm.kernel import Words, mix, shingles, slices, words
from relweave.llm.scratch import arrow, clean

SHINGLE = 5
SIMILARITY = 0.8
#: fingerprint bits, and the radius searched: at similarity 0.8 about 38 bits differ, with a
#: standard deviation below 6
BITS, RADIUS = 256, 63
#: blocks of 8 bits: a fingerprint within the radius has a block with one differing bit at most
BLOCKS = BITS // 8
#: characters of benchmark items indexed at a time, which bounds what is broadcast; a larger
#: benchmark is searched in several passes
INDEX_CHARS = 8 << 20
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_WITHIN_ONE = _POP[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= 1
_WINDOWS = 2048


def _signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each fingerprint bit of each shingle."""
    lanes = [mix(h ^ np.uint64(0xA5A5A5A5 * (i + 1))) for i in range(BITS // 64)]
    raw = np.ascontiguousarray(np.stack(lanes, axis=1)).view(np.uint8)
    return np.unpackbits(raw, axis=1).astype(np.int32) * 2 - 1


def fingerprints(h: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """Packed SimHash of every run of ``m`` shingles, a row per run."""
    votes = np.cumsum(_signs(h) * weight[:, None].astype(np.int32), axis=0, dtype=np.int64)
    total = votes[m - 1:].copy()
    total[1:] -= votes[:-m] if m < len(h) else votes[:0]
    return np.packbits(total > 0, axis=1)


def weighted_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Similarity of two multisets of shingles, each occurrence with its weight."""
    keys, at = np.unique(np.concatenate([h1, h2]), return_inverse=True)
    a = np.bincount(at[:len(h1)], weights=w1, minlength=len(keys))
    b = np.bincount(at[len(h1):], weights=w2, minlength=len(keys))
    most = np.maximum(a, b).sum()
    return float(np.minimum(a, b).sum() / most) if most else 0.0


def build_index(items: list[tuple[int, str | None]]) -> dict:
    """Index of a block of items: by number of words, and all shingles by shingle length.

    Items of one number of words share fingerprints and block tables; ``near[b, v]`` is the bit
    set of the items whose block ``b`` differs from the byte ``v`` in one bit at most.
    """
    groups: dict[int, list] = {}
    w = words([t for _, t in items])
    for i, n in enumerate(w.counts().tolist()):
        if n:
            a, z = int(w.first[i]), int(w.first[i + 1])
            s = shingles(Words(1, w.hash[a:z], w.length[a:z], np.zeros(n, np.int64), np.array([0, n])), min(SHINGLE, n))
            groups.setdefault(n, []).append((items[i][0], s.hash, s.size))
    classes = {}
    for n, rows in groups.items():
        c = classes[n] = SimpleNamespace(n_words=n, k=min(SHINGLE, n))
        c.m = n - c.k + 1
        c.ids, c.hash, c.weight = ([r[j] for r in rows] for j in range(3))
        c.prints = np.concatenate([fingerprints(h, x, c.m) for h, x in zip(c.hash, c.weight)])
        c.near = np.stack([np.packbits(_WITHIN_ONE[:, c.prints[:, b]], axis=1) for b in range(BLOCKS)])
        h = np.concatenate(c.hash)
        order = np.argsort(h, kind="stable")
        c.keys, first = np.unique(h[order], return_index=True)
        c.first, c.item = np.append(first, len(h)), np.repeat(np.arange(len(rows)), c.m)[order]
        c.least = min(int(x.sum()) for x in c.weight)
    by_k = {k: np.unique(np.concatenate([c.keys for c in classes.values() if c.k == k])) for k in {c.k for c in classes.values()}}
    return {"classes": classes, "by_k": by_k}


def search_index(index: dict, texts: list[str | None]) -> Iterator[tuple[int, int, float, int, int]]:
    """``(text, item id, similarity, first word, words)`` of each text and item that match.

    Only windows that share a shingle with an item can match, so fingerprints are made around
    shared shingles; every window there is tried. A text shorter than the item is one window,
    unless its whole weight is too small for the similarity.
    """
    w = words(texts)
    counts = w.counts()
    for k, keys in index["by_k"].items():
        s = shingles(w, k)
        at = np.searchsorted(keys, s.hash)
        hit = (keys[np.minimum(at, len(keys) - 1)] == s.hash) & (counts[s.doc] >= k)
        bounds = np.searchsorted(s.doc, np.arange(len(texts) + 1))
        for d in np.unique(s.doc[hit]):
            a, z = bounds[d], bounds[d + 1]
            for c in index["classes"].values():
                if c.k == k and (z - a >= c.m or s.size[a:z].sum() >= SIMILARITY * c.least):
                    yield from _search_text(int(d), c, s.hash[a:z], s.size[a:z], hit[a:z])


def _search_text(d: int, c: SimpleNamespace, h: np.ndarray, weight: np.ndarray, hit: np.ndarray):
    found = np.flatnonzero(hit)
    at = np.searchsorted(c.keys, h[found])
    own = c.keys[np.minimum(at, len(c.keys) - 1)] == h[found]
    found, at = found[own], at[own]
    if not len(found):
        return
    sharing = np.zeros(len(c.ids), dtype=bool)
    for j in np.unique(at):
        sharing[c.item[c.first[j]:c.first[j + 1]]] = True
    sharing = np.packbits(sharing)
    m = min(c.m, len(h))
    n = len(h) - m + 1
    mark = np.zeros(n + 1, dtype=np.int64)
    np.add.at(mark, np.clip(found - m + 1, 0, n), 1)
    np.add.at(mark, np.minimum(found + 1, n), -1)
    starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    best: dict[int, tuple[float, int]] = {}
    cuts = np.flatnonzero(np.diff(starts) > 1) + 1
    for run in np.split(starts, cuts):
        for lo in range(0, len(run), _WINDOWS):
            part = run[lo:lo + _WINDOWS]
            a, z = int(part[0]), int(part[-1]) + m
            prints = fingerprints(h[a:z], weight[a:z], m)
            near = c.near[np.arange(BLOCKS)[None, :], prints]  # windows x blocks x bits of items
            maybe = np.unpackbits(np.bitwise_or.reduce(near, axis=1) & sharing, axis=1, count=len(c.ids))
            for win, item in zip(*np.nonzero(maybe)):
                if _POP[prints[win] ^ c.prints[item]].sum() > RADIUS:
                    continue
                p = a + int(win)
                sim = weighted_jaccard(h[p:p + m], weight[p:p + m], c.hash[item], c.weight[item])
                if sim >= SIMILARITY and sim > best.get(item, (0.0, 0))[0]:
                    best[item] = (sim, p)
    for item, (sim, p) in best.items():
        yield d, c.ids[item], sim, p, m + c.k - 1


def index_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[dict]:
    """Indexes over blocks of the benchmark, each over about ``INDEX_CHARS`` characters."""
    items = clean(benchmark, **{item_id: "long", text: "string"}).filter(F.col(item_id).isNotNull() & F.col(text).isNotNull())
    total = items.select(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n")).first()["n"]
    blocks = 1 + total // INDEX_CHARS
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64(item_id, text), F.lit(blocks)) == b) if blocks > 1 else items
        rows = sorted((r[0], r[1]) for r in part.distinct().collect())
        if rows:
            yield build_index(rows)


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, n_words)`` of each document and item that match.

    A document matches an item if a window of as many words as the item has a weighted-shingle
    similarity of at least 0.8 with it (the whole document, if it has fewer words): runs of five words (all words of a shorter item),
    weighted by the bytes of their words, counted with repeats. The best window is returned, the
    first of equal ones. Whole texts are searched; documents are never shuffled.

    Null or empty texts and items, and items without id, match nothing; a null doc_id is
    carried along; repeated document rows match each, repeated items once per id.
    """
    docs = clean(docs, doc_id="long", text="string")
    schema = "doc_id long, item_id long, similarity double, first_word int, n_words int"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in index_blocks(benchmark):
        known = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches, known=known):
            for b in batches:
                texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
                for lo, hi in slices(texts):
                    rows = list(search_index(known.value, texts[lo:hi]))
                    if rows:
                        d, item, sim, at, n = zip(*rows)
                        yield arrow(schema, doc_id=[ids[lo + i] for i in d], item_id=item, similarity=sim, first_word=at, n_words=n)

        out = out.unionByName(docs.mapInArrow(search, schema))
    # an item id on several rows: its best window
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("back"), "n_words"))
    if benchmark.select("item_id").distinct().count() < benchmark.count():
        out = out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.similarity", (-F.col("b.back")).alias("first_word"), "b.n_words")
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item."""
    for index in index_blocks(benchmark):
        known = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches, known=known):
            for b in batches:
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                good = np.ones(len(texts), dtype=bool)
                for lo, hi in slices(texts):
                    good[[lo + r[0] for r in search_index(known.value, texts[lo:hi])]] = False
                yield b.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
