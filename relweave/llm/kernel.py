"""Vectorised word, shingle and byte-window hashing over a batch of texts.

Every function is a pure function of the bytes, so tasks on different executors agree
without exchanging anything: a 64-bit identifier of a word, of a word shingle or of a byte
string is the same wherever it is computed. Work goes in slices of a bounded number of
bytes; only a single text longer than a slice makes a larger one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

SLICE_BYTES = 1 << 20
SLICE_ROWS = 1 << 15
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

#: letters and digits of ASCII and every byte of a longer UTF-8 sequence belong to words
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit generator: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x *= _MIX1
    x ^= x >> _U(27)
    x *= _MIX2
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _BASE, dtype=_U)
    p[0] = 1
    return np.multiply.accumulate(p)


def slices(texts: Sequence[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and (size + n > limit or i - at >= SLICE_ROWS):
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


@dataclass
class Words:
    """Words of a slice: ``hash``, byte length and document index of each, in order."""

    n_docs: int
    hash: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # index of each document's first word, with the total at the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: Sequence[str | None]) -> Words:
    """Lower-cased words of each text; a null has none."""
    raw = [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw)))
    inside = _IS_WORD[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        z = np.zeros(0, dtype=np.int64)
        return Words(len(raw), np.zeros(0, dtype=_U), z, z, np.zeros(len(raw) + 1, dtype=np.int64))
    length = stop - start
    at = np.cumsum(length) - length
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(at, length)
    value = (buf[inside].astype(_U) + _U(1)) * _powers(int(length.max()))[place]
    doc = np.searchsorted(ends, start, side="right")
    first = np.searchsorted(doc, np.arange(len(raw) + 1))
    return Words(len(raw), mix(np.add.reduceat(value, at)), length, doc, first)


@dataclass
class Shingles:
    """Shingles of a slice: ``hash``, weight in word bytes, document index and first word."""

    hash: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    word: np.ndarray


def shingles(w: Words, k: int = 5) -> Shingles:
    """Runs of ``k`` words of one document; a shorter document with words is one run."""
    n = len(w.hash)
    mult = mix(np.arange(1, k + 1, dtype=_U) * _BASE) | _U(1)
    full = max(n - k + 1, 0)
    h = np.zeros(full, dtype=_U)
    size = np.zeros(full, dtype=np.int64)
    for j in range(k):
        h += w.hash[j:j + full] * mult[j]
        size += w.length[j:j + full]
    at = np.flatnonzero(w.doc[:full] == w.doc[k - 1:k - 1 + full]) if full else np.zeros(0, dtype=np.int64)
    h, size, doc = mix(h[at]), size[at], w.doc[at]
    counts = w.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        sh, sl = [], []
        for d in short:
            a, b = w.first[d], w.first[d + 1]
            sh.append(int((w.hash[a:b] * mult[:b - a]).sum(dtype=_U)))
            sl.append(int(w.length[a:b].sum()))
        h = np.concatenate([h, mix(np.array(sh, dtype=_U))])
        size = np.concatenate([size, np.array(sl, dtype=np.int64)])
        doc = np.concatenate([doc, short])
        at = np.concatenate([at, w.first[short]])
        order = np.argsort(doc, kind="stable")
        h, size, doc, at = h[order], size[order], doc[order], at[order]
    return Shingles(h, size, doc, at)


def distinct_per_doc(doc: np.ndarray, key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, count) of each distinct key below ``2**bits`` of a document, in order.

    Both fit one integer, as a slice has fewer than ``SLICE_ROWS`` documents.
    """
    both = np.sort((doc.astype(_U) << _U(bits)) | key.astype(_U))
    if not len(both):
        return np.zeros(0, np.int64), both, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    kept = both[at]
    return (kept >> _U(bits)).astype(np.int64), kept & _U((1 << bits) - 1), np.diff(np.append(at, len(both)))


def sequence_hash(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit identifiers of each document's word sequence (0 without words)."""
    n = w.counts()
    out = []
    for seed in (_U(0x51ED270B7F4A7C15), _U(0xD6E8FEB86659FD93)):
        total = np.zeros(w.n_docs, dtype=_U)
        if len(w.hash):
            place = (np.arange(len(w.hash), dtype=np.int64) - w.first[w.doc]).astype(_U)
            value = mix(w.hash * seed + mix(place * _BASE + seed))
            has = np.flatnonzero(n > 0)
            total[has] = mix(np.add.reduceat(value, w.first[has]) + n[has].astype(_U))
        out.append(total)
    return out[0], out[1]
