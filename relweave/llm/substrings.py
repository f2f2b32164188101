"""Repeated byte strings across documents by refining q-gram buckets on later buckets."""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relweave.llm.bloom import bits_for, fold_bits, key_filter, key_positions, see, test_bits, twice_blocks
from relweave.llm.kernel import mix, slices
from relweave.llm.scratch import Scratch, arrow, clean, map_batches, rows_per_task
from relweave.plans.packing import pack_sorted, unpack_sorted
from relweave.session import shuffles_freed

LENGTH = 50
#: length of the strings that make the buckets whose holders are compared
FIRST = 24
WINDOW = LENGTH - FIRST + 1
#: window starts that one run holds at most, so that its first and last window cover it
RUN = WINDOW
#: positions whose buckets are refined at once
_BLOCK = 1 << 14
#: bits of the filter of shared buckets (128 MB at most); fuller, it only lets more rows through
MOST_BITS = 1 << 30
#: bits of a bucket's key when shared buckets are looked for, and those of them that deal the keys out
_KEY_BITS, _DEAL_BITS = 40, 12
_SLICE_BYTES = 1 << 18
#: keys that a task holds before it packs them
_HELD = 1 << 20
#: runs and strings are compared in so many shares at most, of about so many buckets or strings at least
SHARES, SHARE_ROWS = 8, 1 << 18
_A, _B, _C, _D = (int(x) for x in mix(np.arange(11, 15, dtype=np.uint64)) | np.uint64(1))


def _refine(x: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Bucket identifiers refined by the bucket identifiers of a later offset."""
    z = x * np.uint64(_A)
    z ^= z >> np.uint64(32)
    z += later
    z *= np.uint64(_B)
    z ^= z >> np.uint64(29)
    z *= np.uint64(_C)
    z ^= z >> np.uint64(32)
    return z


def bucket_ids(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of the 8 bytes and of the 24 bytes from each position.

    The 8 bytes are their own identifier. A bucket is refined by the identifier of the bytes
    that follow: 8 and 8 more, then 8 more. An identifier is a 64-bit function of the bytes, so
    all tasks agree on it without numbering the buckets.
    """
    if len(buf) < FIRST:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    raw = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=np.ascontiguousarray(buf), strides=(1,)).copy()
    first = np.empty(len(raw) - 16, np.uint64)
    for lo in range(0, len(first), _BLOCK):  # a block's intermediate arrays stay in the processor's cache
        part = raw[lo:lo + _BLOCK + 16]
        first[lo:lo + _BLOCK] = _refine(_refine(part[:-8], part[8:])[:-8], part[16:])
    return raw, first


def string_ids(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Identifiers of the 50 bytes from the given positions: the bucket there, refined by the
    buckets 24 and 26 bytes later, which end where the string ends."""
    return _refine(_refine(first[at], first[at + FIRST]), first[at + LENGTH - FIRST])


def _sliding_min(v: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    rest = n - size
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def _encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Bytes of all texts in a row, the offset of each, and each one's bytes."""
    raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
    return np.frombuffer(b"".join(raw), np.uint8), at, raw


def text_runs(texts: list[str | None]):
    """``(text, bucket, identity, first start, starts)`` of the runs of window starts, each text's
    bytes, the 24-byte buckets of all texts in a row and each text's offset there.

    Every 50-byte string belongs to the least 24-byte bucket inside it, whatever surrounds it;
    consecutive starts with the same least bucket make a run. Equal identities of a bucket are
    equal bytes from the run's first start to the end of its last window.
    """
    buf, at, raw = _encode(texts)
    z = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return z, z.astype(np.uint64), z.astype(np.uint64), z, z, raw, z.astype(np.uint64), at
    _, first = bucket_ids(buf)
    least = _sliding_min(first, WINDOW)
    begins = np.empty(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=begins[1:])
    begins[at[:-1][at[:-1] < len(least)]] = True
    head = np.flatnonzero(begins)
    doc = np.searchsorted(at[1:], head, side="right")
    limit = at[1:][doc] - LENGTH + 1  # first start whose window would leave the text
    stop = np.minimum(np.append(head[1:], len(least)), limit)
    good = stop > head
    head, stop, doc = head[good], stop[good], doc[good]
    parts = -(-(stop - head) // RUN)
    if len(parts) and parts.max() > 1:  # periodic text: a long run in pieces
        place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        head, stop, doc = np.repeat(head, parts) + place * RUN, np.repeat(stop, parts), np.repeat(doc, parts)
        stop = np.minimum(stop, head + RUN)
    n = stop - head
    identity = _refine(_refine(string_ids(first, head), string_ids(first, stop - 1)), n.astype(np.uint64))
    return doc, least[head], identity, head - at[doc], n, raw, first, at


_RUNS = "g long, t long, doc long, run long"


def _key(g: np.ndarray) -> np.ndarray:
    """A bucket's key: so many bits that a strange bucket hardly ever has the same."""
    return g >> np.uint64(64 - _KEY_BITS)


def _pack(version: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Version, first start and number of starts of a run in one long."""
    return (version.astype(np.int64) << 46) | (start.astype(np.int64) << 6) | n


def _versions(raw: list[bytes]) -> np.ndarray:
    """16 bits of each text's checksum, which tell the rows of one id apart."""
    return np.fromiter((zlib.crc32(r) & 0xFFFF for r in raw), np.int64, len(raw))


def _place_keys(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Keys of documents and first starts, for the filter of runs that are compared string by string."""
    return _refine(mix(doc.view(np.uint64)), start.view(np.uint64))


def _unpack(run):
    return F.shiftrightunsigned(run, 46).alias("v"), F.shiftrightunsigned(run, 6).bitwiseAND(F.lit((1 << 40) - 1)).alias("s"), run.bitwiseAND(F.lit(63)).alias("n")


def _shared(docs: DataFrame) -> DataFrame:
    """``(n, keys)``: keys of the buckets that two texts hold, packed; of a text that comes twice, all.

    A task gives away each key once, or twice if it met the key in two documents. What comes
    twice in all is shared. A key is dealt by its high bits and travels as the step from the one before.
    """
    low = _KEY_BITS - _DEAL_BITS

    def pack(held):
        k, doc = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(k, kind="stable")
        k, doc = k[order], doc[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        k = np.repeat(k[start], 1 + (np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)))
        share, cut = np.unique(k >> np.uint64(low), return_index=True)
        k = (k & np.uint64((1 << low) - 1)).astype(np.uint32)
        return arrow("share int, keys binary", share=share.astype(np.int32), keys=[pack_sorted(x) for x in np.split(k, cut[1:])])

    def emit(batches):
        held, n = [], 0
        for b in batches:
            for texts, ids in _slices(b):
                d, g, *_ = text_runs(texts)
                if len(d):
                    held.append((_key(g), ids[d]))
                    n += len(d)
                if n >= _HELD:
                    yield pack(held)
                    held, n = [], 0
        if n:
            yield pack(held)

    def twice(share, held):
        k = np.sort(np.concatenate(held))
        k = np.unique(k[1:][k[1:] == k[:-1]])
        full = (np.uint64(share) << np.uint64(low)) | k.astype(np.uint64)
        return arrow("n long, keys binary", n=[len(k)], keys=[pack_sorted(full)])

    def count(batches):
        here, held = None, []
        for b in batches:
            for share, keys in zip(b.column("share").to_pylist(), b.column("keys").to_pylist()):
                if share != here and held:
                    yield twice(here, held)
                    held = []
                here = share
                held.append(unpack_sorted(keys, np.uint32))
        if held:
            yield twice(here, held)

    dealt = docs.mapInArrow(emit, "share int, keys binary").repartition(rows_per_task(docs), "share")
    return dealt.sortWithinPartitions("share").mapInArrow(count, "n long, keys binary")


def _runs(docs: DataFrame, known) -> DataFrame:
    """All runs of the buckets in a filter."""

    def emit(batches):
        for b in batches:
            for texts, ids in _slices(b):
                d, g, t, s, n, raw, _, _ = text_runs(texts)
                if not len(d):
                    continue
                own = test_bits(known.value, key_positions(_key(g), len(known.value) << 3))
                d, g, t, s, n = d[own], g[own], t[own], s[own], n[own]
                run = _pack(_versions(raw)[d], s, n)
                yield arrow(_RUNS, g=pa.array(g.view(np.int64)), t=pa.array(t.view(np.int64)), doc=pa.array(ids[d]), run=pa.array(run))

    return docs.mapInArrow(emit, _RUNS)


def _slices(batch: pa.RecordBatch):
    """Texts and ids of a batch, about a quarter of a megabyte at a time."""
    for at in range(0, batch.num_rows, 1000):
        texts, ids = batch.column("text").slice(at, 1000).to_pylist(), batch.column("doc_id").slice(at, 1000).to_numpy(zero_copy_only=False)
        for lo, hi in slices(texts, _SLICE_BYTES):
            yield texts[lo:hi], ids[lo:hi]


def _shares(n: int) -> int:
    return max(1, min(SHARES, n // SHARE_ROWS))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc, v, spans)``: starts and ends of repeated strings of each document, unmerged.

    1. Buckets of 24 bytes that two documents share; all others end here.
    2. Runs of the shared buckets (a filter of them goes to the texts; a run it lets through by
       chance is alone in its bucket and ends in 3), each with the identity of its bytes. A run whose
       bytes a smaller document has is repeated as a whole.
    3. What is left differs somewhere from every smaller document with the bucket: only the
       smallest holder of each identity matters, and its 50-byte strings are compared one by one
       if two filters, of strings seen and seen again, can't rule them out. A filter of these runs
       goes to the texts, so no text is shuffled for it; a run it lets through by chance only
       adds strings that are there.

    Runs and strings are compared a share of their keys at a time, and a share's shuffles go before the next.
    """
    spark = docs.sparkSession
    with shuffles_freed(spark):
        return _spans(docs, Scratch(spark))


def _spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    shared = scratch.save(_shared(docs))
    many = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def unpack(b):
        for keys in b.column("keys").to_pylist():
            yield arrow("k long", k=pa.array(unpack_sorted(keys, np.int64)))

    bits = bits_for(many, 10, MOST_BITS)
    known = spark.sparkContext.broadcast(key_filter(map_batches(shared.select("keys"), unpack, "k long"), "k", bits))
    runs = scratch.save_shares(_runs(docs, known), "g", _shares(many))
    scratch.drop(shared)
    states = []
    for part in runs:
        holders = scratch.save(part.groupBy("g", "t").agg(F.min("doc").alias("holder")))
        mixed = holders.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1").select("g", F.lit(True).alias("mixed"))
        states.append(scratch.save(part.join(holders.join(mixed, "g", "left"), ["g", "t"]).filter("holder < doc or mixed").select(
            "doc", *_unpack(F.col("run")), (F.col("holder") < F.col("doc")).alias("whole"))))
        scratch.delete(holders)
    scratch.drop(runs[0])
    state = reduce(DataFrame.unionByName, states)
    edges = state.filter("not whole")
    many, strings_of = edges.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    place_bits, bits = bits_for(many, 16, MOST_BITS), bits_for(strings_of, 4, MOST_BITS >> 1)

    def place(b):
        doc, start = (b.column(c).to_numpy() for c in ("doc", "s"))
        yield arrow("k long", k=pa.array(_place_keys(doc, start).view(np.int64)))

    asked = spark.sparkContext.broadcast(key_filter(map_batches(edges.select("doc", "s"), place, "k long"), "k", place_bits))

    def strings(b):
        """Identifier, document, version and start of every string of the asked runs in a batch, slice by slice."""
        for texts, ids in _slices(b):
            d, _, _, s, n, raw, first, at = text_runs(texts)
            own = test_bits(asked.value, key_positions(_place_keys(ids[d], s), place_bits))
            d, s, n = d[own], s[own], n[own]
            row, begin = np.repeat(d, n), np.repeat(s, n)
            begin = begin + np.arange(len(begin)) - np.repeat(np.cumsum(n) - n, n)
            yield string_ids(first, begin + at[row]), ids[row], _versions(raw)[row], begin

    def twice_seen(batches):
        once, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)
        for b in batches:
            for w, _, _, _ in strings(b):
                w, count = np.unique(w, return_counts=True)
                see(once, twice, key_positions(w, bits), count > 1)
        yield from twice_blocks(once, twice)

    maybe = spark.sparkContext.broadcast(fold_bits(docs.mapInArrow(twice_seen, "block int, data binary"), bits, "twice"))
    scratch.drop()
    schema = "w long, doc long, at long"

    def windows(b):
        for w, doc, version, begin in strings(b):
            own = test_bits(maybe.value, key_positions(w, bits))
            yield arrow(schema, w=pa.array(w[own].view(np.int64)), doc=pa.array(doc[own]), at=pa.array((version[own] << 40) | begin[own]))

    single = scratch.save_shares(map_batches(docs, windows, schema), "w", _shares(strings_of >> 3))
    hits = []
    for part in single:
        least = part.groupBy("w").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("w", "a")
        hits.append(scratch.save(part.join(least, "w").filter("a < doc").select(
            "doc", F.shiftrightunsigned("at", 40).alias("v"), F.col("at").bitwiseAND(F.lit((1 << 40) - 1)).alias("s"), F.lit(1).cast("long").alias("n"))))
    scratch.drop(single[0])
    spans = reduce(DataFrame.unionByName, [state.filter("whole").select("doc", "v", "s", "n"), *hits])
    spans = scratch.save(spans.groupBy("doc", "v").agg(F.collect_list(F.struct("s", (F.col("s") + F.col("n") + LENGTH - 1).alias("e"))).alias("spans")))
    scratch.drop(*states, *hits)
    return spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``: a row per row, ``kept`` as bytes.

    Removes each byte covered by a 50-byte string (of UTF-8) that also starts in a document with
    a smaller id. Strings are judged on the input. A null or empty text has no bytes; a null id
    is neither smaller nor larger than any, so such a row loses nothing and takes nothing away.
    Rows that repeat an id are the same document: they don't take from each other.
    """
    docs = clean(docs, doc_id="long", text="string")
    spans = repeated_spans(docs.filter("doc_id is not null and text is not null"))
    bits = bits_for(spans.count(), 10, MOST_BITS)
    with shuffles_freed(docs.sparkSession):
        cut_of = docs.sparkSession.sparkContext.broadcast(key_filter(spans, "doc", bits))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def asked(batch):
        """Ids and texts of a batch, as bytes, and the places of those that may lose some, a thousand rows at a time."""
        for at in range(0, batch.num_rows, 1000):
            ids, texts = (batch.column(c).slice(at, 1000) for c in ("doc_id", "text"))
            raw = [(t or "").encode("utf-8", "replace") for t in texts.to_pylist()]
            known = ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield ids, raw, test_bits(cut_of.value, key_positions(known, bits)) & ids.is_valid().to_numpy(zero_copy_only=False)

    def whole(b):
        for ids, raw, some in asked(b):
            at = np.flatnonzero(~some)
            n = [len(raw[i]) for i in at]
            yield arrow(schema, doc_id=ids.take(pa.array(at)), n_bytes=n, n_removed=[0] * len(n), n_spans=[0] * len(n), kept=[raw[i] for i in at])

    moved = "doc_id long, v long, size long, data binary"

    def move(b):
        for ids, raw, some in asked(b):
            at = np.flatnonzero(some)
            raw = [raw[i] for i in at]
            yield arrow(moved, doc_id=ids.take(pa.array(at)), v=pa.array(_versions(raw)), size=[len(r) for r in raw],
                        data=[pa.compress(r, "zstd", asbytes=True) for r in raw])

    def cut(b):
        n, removed, count, kept = b.column("size").to_pylist(), [], [], []
        for size, data, own in zip(n, b.column("data").to_pylist(), b.column("spans")):
            raw = pa.decompress(data, size, "zstd", asbytes=True) if size else b""
            if not own.is_valid or not len(own.values):
                removed.append(0)
                count.append(0)
                kept.append(raw)
                continue
            s, e = (own.values.field(c).to_numpy() for c in ("s", "e"))
            mark = np.zeros(len(raw) + 1, np.int64)
            np.add.at(mark, s, 1)
            np.add.at(mark, e, -1)
            gone = np.cumsum(mark[:-1]) > 0
            removed.append(int(gone.sum()))
            count.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        yield arrow(schema, doc_id=b.column("doc_id"), n_bytes=n, n_removed=removed, n_spans=count, kept=kept)

    # only texts that lose something are shuffled, each compressed
    joined = map_batches(docs, move, moved).join(spans.withColumnRenamed("doc", "doc_id"), ["doc_id", "v"], "left")
    return map_batches(docs, whole, schema).unionByName(map_batches(joined.select("doc_id", "size", "data", "spans"), cut, schema))
