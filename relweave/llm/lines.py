"""Line deduplication with two Bloom filters and an exact confirmation of the suspects."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relweave.llm.bloom import bits_for, fold_bits, positions, see, test_bits, twice_blocks
from relweave.llm.scratch import Scratch, arrow, clean, map_batches

STRIP = " \t\n\x0b\f\r"
_LOWER = {c: c + 32 for c in range(65, 91)}
#: bits of each Bloom filter: 32 MB at most on a worker. A fuller filter only sends more
#: lines to the exact step; the result never depends on it.
MOST_BITS = 1 << 28
BITS_A_LINE = 12


def line_key(line: str) -> str:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return line.strip(STRIP).translate(_LOWER)


def _digests(text: str | None, least: int) -> list[tuple[bytes, int]]:
    """(128-bit digest of the key or empty, line number) of each line of a text."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        if len(line) >= least:
            key = line.strip(STRIP)
            if len(key) >= least:
                # bytes.lower changes A-Z only, as line_key does, but not a character at a time
                key = key.encode("utf-8", "replace").lower()
                out.append((hashlib.blake2b(key, digest_size=16).digest(), i))
    return out


def _probes(digests: list[bytes], bits: int) -> np.ndarray:
    x = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return positions(x[:, 0], x[:, 1], bits)


def repeated_filter(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """Bits of the keys that may be in two documents or more; never misses one.

    Every task keeps the two filters of its own documents; blocks of them are folded pairwise:
    a key is seen twice if either part saw it twice or both saw it once. A document adds a
    key once, however often it holds the line.
    """
    def build(batches):
        once, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)
        for b in batches:
            held: list[bytes] = []
            for t in b.column("text"):
                held.extend({d for d, _ in _digests(t.as_py(), least)})
            if held:
                _, index, count = np.unique(np.frombuffer(b"".join(held), dtype="V16"), return_index=True, return_counts=True)
                see(once, twice, _probes(held, bits)[index], count > 1)
        yield from twice_blocks(once, twice)

    return fold_bits(docs.select("text").mapInArrow(build, "block int, data binary"), bits, "twice")


def dropped_lines(docs: DataFrame, least: int = 40, documents: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, digests)``: the keys whose lines a document loses.

    Keys of at least ``least`` code points in at least ``documents`` documents are lost by every
    document but the largest id. Suspects of the Bloom filters are counted exactly by 128-bit
    digest; all other lines never leave their task.
    """
    spark = docs.sparkSession
    docs = clean(docs, doc_id="long", text="string").filter("doc_id is not null")
    total = docs.select(F.coalesce(F.sum(F.floor(F.octet_length("text") / F.lit(least))), F.lit(0)).alias("n")).first()["n"]
    bits = bits_for(total, BITS_A_LINE // 2, MOST_BITS)
    known = spark.sparkContext.broadcast(repeated_filter(docs, least, bits))
    schema = "doc_id long, digest binary"

    def suspects(b):
        ids, keys = [], []
        for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
            own = {x for x, _ in _digests(t.as_py(), least)}
            keys.extend(own)
            ids.extend([d] * len(own))
        hit = np.flatnonzero(test_bits(known.value, _probes(keys, bits))).tolist()
        if hit:
            yield arrow(schema, doc_id=[ids[i] for i in hit], digest=[keys[i] for i in hit])

    found = map_batches(docs, suspects, schema)
    scratch = scratch or Scratch(spark)
    found = scratch.save(found)
    # repeated rows of one document count once
    per = found.groupBy("digest").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keep")).filter(F.col("n") >= documents)
    # written first, so that the join can split the documents of a hot line
    lost = found.join(scratch.save(per.select("digest", "keep")), "digest").filter("doc_id < keep")
    return lost.groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))


def dedup_lines(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """Documents without repeated lines: ``(doc_id, text, n_lines, n_dropped, kept)``, a row per row.

    ``text`` is the input, ``kept`` the lines that stay, joined by one line end. A null or empty
    text is one empty line. A row without id is left as it is and counts as no document. Rows
    that repeat an id are one document for the count and lose the same lines. Every line of a
    text of any length is read; an empty table gives no rows.
    """
    docs = clean(docs, doc_id="long", text="string")
    lost = dropped_lines(docs, least, documents)
    schema = "doc_id long, text string, n_lines long, n_dropped long, kept string"

    def apply(b):
        n, k, out = [], [], []
        for t, gone in zip(b.column("text"), b.column("digests")):
            text = t.as_py() or ""
            lines = text.split("\n")
            gone = set(gone.as_py() or ())
            drop = {i for d, i in _digests(text, least) if d in gone} if gone else ()
            n.append(len(lines))
            k.append(len(drop))
            out.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
        yield arrow(schema, doc_id=b.column("doc_id"), text=b.column("text"), n_lines=n, n_dropped=k, kept=out)

    return map_batches(docs.join(lost, "doc_id", "left"), apply, schema)


def drop_repeated_lines(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """``docs`` with all columns and rows, its texts without repeated lines.

    A null text stays null. ``n_chars``, where there is one, follows the text.
    """
    lost = dropped_lines(docs, least, documents).select(F.col("doc_id").alias("_of"), F.col("digests").alias("_lost"))
    joined = docs.join(lost, docs["doc_id"].cast("long") == lost["_of"], "left").drop("_of")
    names, place = docs.columns, docs.columns.index("text")

    def apply(batches):
        for b in batches:
            texts = []
            for t, gone in zip(b.column(place), b.column(b.num_columns - 1)):
                text, gone = t.as_py(), set(gone.as_py() or ())
                drop = {i for d, i in _digests(text, least) if d in gone} if gone else ()
                texts.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop) if drop else text)
            arrays = b.columns[:-1]
            arrays[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    out = joined.mapInArrow(apply, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
