"""Near copies by consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relweave.llm.bloom import bits_for, key_filter, key_positions, test_bits
from relweave.llm.graph import components
from relweave.llm.kernel import distinct_per_doc, mix, sequence_hash, shingles, slices, words
from relweave.llm.scratch import Scratch, add_blocks, arrow, clean, map_batches, rows_per_task, share_of

SHINGLE = 5
SIMILARITY = 0.8
#: bits of a shingle's identifier
SHINGLE_BITS = 48
#: samples per document, in bands that must agree as a whole: a pair at similarity 0.8 misses
#: all bands with a probability of 2e-4
BANDS, BAND_ROWS = 16, 4
SAMPLES = BANDS * BAND_ROWS
#: counters of the document-share table (16 MB while counting, 8 MB as weights), whatever the
#: corpus. Shares below RARE all weigh the same, which is above the table's own noise.
COUNTERS = 1 << 21
RARE = 1e-3
_BLOCK = 1 << 16
_DRAWS = 1 << 12
_PIECE = 1 << 13
#: samples that must agree before texts are compared: at similarity 0.8 about 51 of 64 do, with
#: a standard deviation of 3.2
AGREE = 40
#: rounds of comparing the members of a bucket with one of them, before all that are left meet
ROUNDS = 2
#: members of a bucket in one block, and characters of their texts; two blocks meet in a task
BLOCK_ROWS = 1024
BLOCK_CHARS = 1 << 24
#: bits of the filter of nodes whose texts are compared (128 MB at most); fuller, it only lets more texts through
MOST_BITS = 1 << 30
#: pairs that share a centre and a task
CENTRE_ROWS = 512


def shingle_weights(docs: DataFrame) -> np.ndarray:
    """Weight of each shingle counter: 1 for a shingle in every document up to 2 for a rare one.

    Counts the documents that hold each shingle over the whole corpus, copies included. The
    weight is ``1 + min(1, ln(1 / share) / ln(1 / RARE))``.
    """

    def count(batches):
        held = np.zeros(COUNTERS, np.uint64)
        n = 0
        for b in batches:
            texts = b.column("text").to_pylist()
            n += len(texts)
            for lo, hi in slices(texts):
                s = shingles(words(texts[lo:hi]), SHINGLE)
                _, h, _ = distinct_per_doc(s.doc, s.hash & np.uint64(COUNTERS - 1), COUNTERS.bit_length() - 1)
                held += np.bincount(h.astype(np.int64), minlength=COUNTERS).astype(np.uint64)
        for i in range(0, COUNTERS, _BLOCK):
            part = held[i:i + _BLOCK]
            if part.any():
                yield arrow("block int, data binary", block=[i // _BLOCK], data=[zlib.compress(part.tobytes(), 1)])

    n = max(1, rows_per_task(docs) // (COUNTERS // _BLOCK))
    partial = docs.select("text").mapInArrow(count, "block int, data binary").withColumn("share", share_of(n))
    total = max(docs.count(), 1)
    out = np.zeros(COUNTERS, np.float64)
    for r in add_blocks(partial, _BLOCK, "uint64").collect():
        out[r["block"] * _BLOCK:(r["block"] + 1) * _BLOCK] = np.frombuffer(zlib.decompress(r["data"]), np.uint64)
    rare = np.log(total / np.maximum(out, 1.0)) / math.log(1 / RARE)
    return (1 + np.clip(rare, 0, 1)).astype(np.float32)


def weighted_shingles(texts: list[str | None], weights: np.ndarray):
    """``(document, shingle, weight)`` of each distinct shingle: repeats times rarity."""
    s = shingles(words(texts), SHINGLE)
    d, h, n = distinct_per_doc(s.doc, s.hash & np.uint64((1 << SHINGLE_BITS) - 1), SHINGLE_BITS)
    return d, h, n * weights[(h & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.float64)


def draw_tables(seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random variables of the sampling, per shingle class and sample: ln c, r and beta."""
    rng = np.random.default_rng(seed)
    shape = (_DRAWS, SAMPLES)
    return (np.log(rng.gamma(2, 1, shape)).astype(np.float32), rng.gamma(2, 1, shape).astype(np.float32), rng.random(shape).astype(np.float32))


def signatures(n_docs: int, doc: np.ndarray, h: np.ndarray, weight: np.ndarray, tables) -> np.ndarray:
    """Improved consistent weighted samples, a row per document (infinite without shingles).

    For weight S: t = floor(ln S / r + beta), ln y = r (t - beta), ln a = ln c - ln y - r; the
    sample is the shingle with the smallest a, together with its t. The smallest value itself
    stands for that pair, as it is a function of both. Two documents agree in a sample with a
    probability equal to their weighted Jaccard similarity.
    """
    c, r, beta = tables
    out = np.full((n_docs, SAMPLES), np.inf, dtype=np.float32)
    log_w = np.log(weight).astype(np.float32)
    for lo in range(0, len(h), _PIECE):
        part = h[lo:lo + _PIECE]
        i = ((part >> np.uint64(24)) & np.uint64(_DRAWS - 1)).astype(np.int64)
        j = ((part >> np.uint64(36)) & np.uint64(_DRAWS - 1)).astype(np.int64)
        rj, bj = r[j], beta[j]
        t = np.floor(log_w[lo:lo + _PIECE, None] / rj + bj)
        a = c[i] - rj * (t - bj + 1)
        d = doc[lo:lo + _PIECE]
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        low = np.minimum.reduceat(a, first, axis=0)
        out[d[first]] = np.minimum(out[d[first]], low)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: the band's number and all its samples."""
    raw = sig.view(np.uint32).astype(np.uint64).reshape(len(sig), BANDS, BAND_ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), raw.shape[:2]).copy()
    for i in range(BAND_ROWS):
        key = mix(key + raw[:, :, i] * np.uint64(0x9E3779B97F4A7C15))
    return key


def jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted sets of distinct shingles."""
    at = np.searchsorted(h2, h1)
    same = h2[np.minimum(at, len(h2) - 1)] == h1 if len(h2) else np.zeros(len(h1), bool)
    both = np.minimum(w1[same], w2[at[same]]).sum()
    total = w1.sum() + w2.sum() - both
    return float(both / total) if total else 0.0


_SIGNED = "doc_id long, one long, two long, chars long, bands array<long>, sig array<int>"


def _sign(docs: DataFrame, tools) -> DataFrame:
    def sign(batches):
        for b in batches:
            weights, tables = tools.value
            texts = b.column("text").to_pylist()
            for lo, hi in slices(texts):
                part = texts[lo:hi]
                w = words(part)
                one, two = sequence_hash(w)
                d, h, x = weighted_shingles(part, weights)
                sig = signatures(hi - lo, d, h, x, tables)
                keys = band_keys(sig).view(np.int64)
                full = w.counts() > 0
                yield arrow(_SIGNED, doc_id=b.column("doc_id")[lo:hi], one=one.view(np.int64), two=two.view(np.int64),
                            chars=[len(t or "") for t in part], bands=[k if f else None for k, f in zip(list(keys), full)], sig=list(sig.view(np.int32)))

    return docs.select("doc_id", "text").mapInArrow(sign, _SIGNED)


def _verify(pairs: DataFrame, texts: DataFrame, tools, scratch: Scratch) -> DataFrame:
    """The pairs ``(a, b)`` whose texts reach the similarity. Pairs of one ``b`` share tasks in
    bounded parts, where its shingles are made once; a text moves once to each ``b`` that asks."""
    size = scratch.save(pairs.groupBy("b").agg(F.ceil(F.count("*") / CENTRE_ROWS).alias("parts")))
    part = F.pmod(F.xxhash64("a"), F.col("parts")).alias("part")
    left = pairs.join(size, "b").select(F.col("a").alias("node"), "b", part, F.lit(1).alias("role"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    right = size.select(F.col("b").alias("node"), "b", every, F.lit(0).alias("role"))
    asks = scratch.save(left.unionByName(right))
    schema = "a long, b long"

    def check(batches):
        weights = tools.value[0]
        now, centres = None, []
        for batch in batches:
            node, b, part, role = (batch.column(c).to_pylist() for c in ("node", "b", "part", "role"))
            held = batch.column("text").to_pylist()
            keep = []
            for lo, hi in slices(held):
                d, h, w = weighted_shingles(held[lo:hi], weights)
                bounds = np.searchsorted(d, np.arange(hi - lo + 1))
                for i in range(lo, hi):
                    mine = slice(bounds[i - lo], bounds[i - lo + 1])
                    if now != (b[i], part[i]):
                        now, centres = (b[i], part[i]), []
                    if not role[i]:  # the centre's texts come before all others
                        centres.append((h[mine], w[mine]))
                    elif any(jaccard(h[mine], w[mine], *c) >= SIMILARITY for c in centres):
                        keep.append(i)
            if keep:
                yield arrow(schema, a=[node[i] for i in keep], b=[b[i] for i in keep])

    rows = asks.join(texts, "node").select("node", "b", "part", "role", "text")
    return rows.repartition("b", "part").sortWithinPartitions("b", "part", "role").mapInArrow(check, schema)


def near_copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, class_id)`` of every row: the smallest id among the near copies it is linked to.

    Texts with the same words are one node. Two nodes are linked if the weighted Jaccard
    similarity of their five-word shingles (repeats times a rarity weight counted over the
    whole corpus) is at least 0.8. Nodes that share a band of samples are candidates. In a
    bucket every member is first compared with one centre, twice; in buckets whose members are
    not all in one class after that, every two members of different classes are, by samples and
    then by text, inside bounded blocks that give away no more than a link per member. A class is
    a connected component.

    A text without words is a class of its own, as is any text like no other. A null id takes no
    part and gets a null class. Rows that repeat an id are one document: its class joins the near
    copies of each of its texts. Whole texts of any length are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = clean(docs, doc_id="long", text="string")
    known = docs.filter("doc_id is not null")
    tools = spark.sparkContext.broadcast((shingle_weights(docs), draw_tables()))
    signed = scratch.save(_sign(known, tools))
    worded = signed.filter("bands is not null")
    nodes = scratch.save(worded.groupBy("one", "two").agg(F.min("doc_id").alias("node"), F.max("chars").alias("chars"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    same = worded.join(nodes.select("one", "two", "node"), ["one", "two"]).filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    links = [scratch.save(same)]
    scratch.drop(signed)
    members = nodes.select("node", "chars", F.explode("bands").alias("key"))
    # totals are written before they are joined to their rows, so that a hot key can be split
    full = scratch.save(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    members = scratch.save(members.join(full, "key").distinct())
    wanted = scratch.save(members.select("node").distinct())
    likely = _likely(known, wanted)
    texts = likely.join(wanted, likely.doc_id == wanted.node, "left_semi").select(F.col("doc_id").alias("node"), "text")
    texts = scratch.save(texts.dropDuplicates())
    prints = scratch.save(nodes.join(wanted, "node").select("node", "sig"))
    scratch.drop(nodes, full)
    comps = None
    tested = None
    for turn in range(ROUNDS):
        pairs = scratch.save(_pairs(_open(members, comps, scratch), turn, tested, prints, scratch))
        tested = pairs if tested is None else tested.unionByName(pairs)
        links.append(scratch.save(_verify(pairs, texts, tools, scratch)))
        comps = components(_union(links), scratch)
    left = scratch.save(_candidates(_open(members, comps, scratch), prints, scratch))
    links.append(scratch.save(_forest(left, texts, tools)))
    comps = components(_union(links), scratch)
    scratch.drop(left)
    scratch.drop(members, texts, prints)
    return docs.select("doc_id").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.coalesce("comp", "doc_id").alias("class_id"))


def _likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id may be a node of ``wanted``: a filter of the nodes spares most other texts the shuffle."""
    bits = bits_for(wanted.count(), 10, MOST_BITS)
    hashed = wanted.select(F.xxhash64("node").alias("h"))
    held = docs.sparkSession.sparkContext.broadcast(key_filter(hashed, "h", bits))
    schema = "doc_id long, text string"

    def own(b):
        h = b.column("h").to_numpy().view(np.uint64)
        keep = b.filter(pa.array(test_bits(held.value, key_positions(h, bits))))
        yield arrow(schema, doc_id=keep.column("doc_id"), text=keep.column("text"))

    return map_batches(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")), own, schema)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _pairs(members: DataFrame, turn: int, tested: DataFrame | None, prints: DataFrame, scratch: Scratch) -> DataFrame:
    """``(a, b)``: each member of a bucket with the bucket's centre of this turn, if they are in
    different classes, were not compared before and agree in enough samples."""
    order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
    centre = scratch.save(members.groupBy("key").agg(F.min_by(F.struct("node", "comp"), order).alias("c")))
    pairs = members.join(centre, "key").filter("comp <> c.comp").select(F.col("node").alias("a"), F.col("c.node").alias("b")).distinct()
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    sig = lambda side: prints.select(F.col("node").alias(side), F.col("sig").alias(f"{side}_sig"))
    same = F.size(F.filter(F.zip_with("a_sig", "b_sig", lambda x, y: x == y), lambda x: x))
    return pairs.join(sig("a"), "a").join(sig("b"), "b").filter(same >= AGREE).select("a", "b").distinct()


_MEMBER = "key long, i int, j int, part int, node long, comp long"


def _groups(batches, fn):
    """``fn`` of the rows of each ``(key, i, j)``, which arrive together."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not len(t):
            continue
        cols = [t[c].to_numpy() for c in ("key", "i", "j")]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        for lo, hi in zip([0, *cuts.tolist()], cuts.tolist()):
            yield from fn(t.slice(lo, hi - lo))
        rest = t.slice(int(cuts[-1]) if len(cuts) else 0)
    if rest is not None and len(rest):
        yield from fn(rest)


class _Block:
    """Members of two blocks of a bucket, and who is a candidate of whom."""

    def __init__(self, t: pa.Table, sig: Callable[[], np.ndarray]):
        self.key, self.i, self.j = t["key"][0].as_py(), t["i"][0].as_py(), t["j"][0].as_py()
        self.node, self.comp, self.of = (t[c].to_numpy() for c in ("node", "comp", "part"))
        self.several = len(t) > 1 and self.comp.min() != self.comp.max()
        if self.several:
            self.sig = np.ascontiguousarray(sig())
            self.bands = band_keys(self.sig).view(np.int64)
            self.left, self.right = np.flatnonzero(self.of == self.i), np.flatnonzero(self.of == self.j)

    def partners(self, row: int, label: np.ndarray) -> np.ndarray:
        """Members of the other block (behind ``row``, if it is the same) with another label that
        agree with ``row`` in enough samples and have this bucket as the first in common."""
        near = self.right[self.right > row] if self.i == self.j else self.right
        near = near[label[near] != label[row]]
        near = near[(self.sig[near] == self.sig[row]).sum(axis=1) >= AGREE]
        return near[self.bands[row][(self.bands[near] == self.bands[row]).argmax(axis=1)] == self.key]


def _candidates(members: DataFrame, prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of a bucket, by pair of blocks, that have a candidate of another class there.

    A bucket is dealt into blocks by node, and every two blocks meet in a group of their own, so
    no task holds more than two blocks at a time, however many members a bucket has. Samples
    decide here, so that only texts with a candidate have to be moved. A group gives away its own
    members at most, never its pairs.
    """
    rows, chars = F.count("*") / BLOCK_ROWS, F.sum("chars") / BLOCK_CHARS
    size = scratch.save(members.groupBy("key").agg(F.ceil(F.greatest(rows, chars)).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = members.join(prints, "node").join(size, "key").withColumn("part", part)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "comp", "sig")

    def group(t):
        block = _Block(t, lambda: t["sig"].combine_chunks().flatten().to_numpy().reshape(-1, SAMPLES))
        if not block.several:
            return
        keep = np.zeros(len(t), bool)
        for row in block.left:
            near = block.partners(row, block.comp)
            keep[near] = True
            keep[row] |= len(near) > 0
        if keep.any():
            yield from t.drop_columns(["sig"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lambda batches: _groups(batches, group), _MEMBER)


def _forest(candidates: DataFrame, texts: DataFrame, tools) -> DataFrame:
    """Links ``(a, b)`` that connect what is similar in each pair of blocks: every two members of
    different classes are compared by text unless links already connect them, so a group gives
    away fewer links than it has members, and nothing about the pairs that aren't similar."""
    schema = "a long, b long"
    rows = candidates.join(texts, "node").select("key", "i", "j", "part", "node", "comp", "text")

    def group(t):
        weights, tables = tools.value
        held = t["text"].to_pylist()
        parts = []
        for lo, hi in slices(held):
            d, h, w = weighted_shingles(held[lo:hi], weights)
            parts.append((d + lo, h, w))
        d, h, w = (np.concatenate(x) for x in zip(*parts))
        block = _Block(t, lambda: signatures(len(t), d, h, w, tables).view(np.int32))
        if not block.several:
            return
        at = np.searchsorted(d, np.arange(len(t) + 1))
        count, total = np.diff(at), np.add.reduceat(w, at[:-1])
        known, place = np.unique(h, return_inverse=True)
        own = np.zeros(len(known))
        label = block.comp.copy()
        a, b = [], []
        for row in block.left:
            near = block.partners(row, label)
            if not len(near):
                continue
            mine = slice(at[row], at[row + 1])
            own[place[mine]] = w[mine]
            n = count[near]
            begin = np.cumsum(n) - n
            e = np.repeat(at[near] - begin, n) + np.arange(n.sum())
            both = np.add.reduceat(np.minimum(w[e], own[place[e]]), begin)
            own[place[mine]] = 0
            for x in near[both / (total[row] + total[near] - both) >= SIMILARITY]:
                if label[x] != label[row]:
                    a.append(block.node[row])
                    b.append(block.node[x])
                    label[label == label[x]] = label[row]
        if a:
            yield arrow(schema, a=a, b=b)

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lambda batches: _groups(batches, group), schema)


def _open(members: DataFrame, comps: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Members of buckets that span several classes, with their class; without classes yet,
    each node is one."""
    if comps is None:
        return members.withColumn("comp", F.col("node"))
    rows = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = scratch.save(rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key"))
    return scratch.save(rows.join(split, "key"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose id is the smallest of its near copies.

    Rows without id stay; of rows that repeat an id and a text, all stay or go together.
    """
    gone = near_copies(docs).filter("class_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")
