"""Token packing: documents cut into pieces of power-of-two length, bucketed by length."""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relweave.llm.scratch import clean
from relweave.session import shared_dir

#: characters of text tokenized at once; longer texts go on in further rounds
ROUND_CHARS = 1 << 20
#: tokens that leave a task together
BATCH_TOKENS = 1 << 19
#: how a byte-level vocabulary splits a text before merging (fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PIECES = "doc_id long, start long, length int, doc_tokens long, ids array<int>, ids_crc32 long"


def piece_lengths(tokens: int, most: int) -> list[int]:
    """Lengths of a document's pieces: whole ones of ``most``, then the binary digits of the rest, falling."""
    rest = tokens % most
    return [most] * (tokens // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable characters of Latin-1 stand for themselves, the other bytes in order for the
    characters from 256 on.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """Ids of texts of any length by a byte-level vocabulary file of the tokenizers library.

    Where the file's ids grow in the order of its merges, its tokens are ranks, and the rank
    encoder gives the same ids in a third of the time; the tests hold one against the other.
    Other files go through the tokenizers library itself. Special tokens' strings are ordinary text.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, merges = file["model"]["vocab"], file["model"]["merges"]
        special = {t["content"] for t in file.get("added_tokens", [])}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        made = [vocabulary[a + b] for a, b in pairs]
        start = file.get("pre_tokenizer") or {}
        plain = start.get("type") == "ByteLevel" and not start.get("add_prefix_space") and start.get("use_regex", True)
        if plain and not file.get("normalizer") and made == sorted(made):
            import tiktoken

            byte = _byte_of()
            ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}
            self._ids = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            self._ids = lambda text: whole.encode(text, add_special_tokens=False).ids

    @staticmethod
    def rounds(text: str):
        """Parts of the text that are tokenized independently; together they are the text.

        A text is split before anything is merged, and a single space between two characters
        that aren't white space always starts a new part, so cutting there changes no id.
        """
        at = 0
        while len(text) - at > ROUND_CHARS:
            end = at + ROUND_CHARS
            while (end := text.find(" ", end)) >= 0 and (
                    end + 1 >= len(text) or text[end - 1].isspace() or text[end + 1].isspace()):
                end += 1
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:]

    def ids(self, text: str) -> np.ndarray:
        return np.concatenate([np.array(self._ids(part), np.uint32) for part in self.rounds(text)])


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ByteTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return ByteTokenizer(path)


def pack_documents(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents: ``(doc_id, start, length, doc_tokens, ids, ids_crc32, sequence_id, offset)``.

    A document's ids and a closing ``end_id`` are cut into as many pieces of ``most`` tokens as
    fit and then into pieces of the lengths of the rest's binary digits. Every piece is a
    sequence of its own, so no sequence holds two documents and none needs padding; sequences
    are bucketed by length: the written table has a folder for each of the at most
    ``log2(most) + 1`` lengths, so a batch is drawn from one bucket. A document is cut inside
    its own task, nothing is shuffled, and ``sequence_id`` (unique, given by the writing
    task) is frozen with the written table, so lost executors change nothing.

    ``tokenizer`` is the path of a byte-level vocabulary file on every machine. The strings of
    special tokens are ordinary text. Null and empty texts are the closing id alone: one piece
    of length 1. Repeated rows and null ids are packed row by row, an empty table gives no
    rows, extra columns are ignored.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")

    def record(held: list[tuple]) -> pa.RecordBatch:
        """One batch of the pieces of some documents: (doc, number of its ids, all of them, bounds of the pieces)."""
        bounds = [h[3] for h in held]
        lengths = np.concatenate([np.diff(b) for b in bounds])
        counts = [len(b) - 1 for b in bounds]
        ids = np.concatenate([ids[b[0]:b[-1]] for (_, _, ids, b) in held])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        raw = memoryview(ids.tobytes())
        return pa.RecordBatch.from_arrays([
            pa.array([d for (d, _, _, _), c in zip(held, counts) for _ in range(c)], pa.int64()),
            pa.array(np.concatenate([b[:-1] for b in bounds]), pa.int64()), pa.array(lengths, pa.int32()),
            pa.array(np.repeat([n for _, n, _, _ in held], counts), pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32))),
            pa.array([zlib.crc32(raw[4 * u:4 * v]) for u, v in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.int64()),
        ], names=[f.split(" ")[0] for f in _PIECES.split(", ")])

    def cut(batches):
        tok = _tokenizer(tokenizer)
        held, tokens = [], 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = np.append(tok.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
                bounds = np.concatenate([[0], np.cumsum(piece_lengths(len(ids), most))])
                step = max(1, BATCH_TOKENS // most)  # pieces of a very long document leave in parts
                for i in range(0, len(bounds) - 1, step):
                    part = bounds[i:i + step + 1]
                    held.append((doc, len(ids), ids, part))
                    tokens += part[-1] - part[0]
                    if tokens >= BATCH_TOKENS:
                        yield record(held)
                        held, tokens = [], 0
        if held:
            yield record(held)

    spark = docs.sparkSession
    pieces = clean(docs, doc_id="long", text="string").mapInArrow(cut, _PIECES)
    pieces = pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    path = shared_dir(spark)
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
    schema = pieces.withColumn("bucket", F.col("length")).schema
    return spark.read.schema(schema).parquet(path)
