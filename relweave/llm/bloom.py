"""Bloom filters built by tasks and folded on the way to the driver."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame

from relweave.llm.kernel import mix
from relweave.llm.scratch import add_blocks, arrow, rows_per_task, share_of

BLOCK_BITS = 1 << 19
PROBES = 3


def positions(one: np.ndarray, two: np.ndarray, bits: int, probes: int = PROBES) -> np.ndarray:
    """Bit positions of each key, a row per key: one half plus odd steps of the other."""
    step = two | np.uint64(1)
    return np.stack([(one + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(probes)], axis=1).astype(np.int64)


def test_bits(filt: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filt[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def set_bits(filt: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(filt, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))


def see(once: np.ndarray, twice: np.ndarray, at: np.ndarray, again: np.ndarray) -> None:
    """Enter distinct keys; ``again`` marks those that this batch alone holds twice."""
    set_bits(twice, at[test_bits(once, at) | again])
    set_bits(once, at)


def twice_blocks(once: np.ndarray, twice: np.ndarray):
    """Partial blocks of a pair of filters, for ``fold_bits`` with ``twice``."""
    step = min(len(once) << 3, BLOCK_BITS) >> 3
    for i in range(0, len(once), step):
        if once[i:i + step].any():
            data = once[i:i + step].tobytes() + twice[i:i + step].tobytes()
            yield arrow("block int, data binary", block=[i // step], data=[zlib.compress(data, 1)])


def bits_for(keys: int, per_key: int, most: int, least: int = 1 << 20) -> int:
    bits = least
    while bits < min(most, keys * per_key):
        bits <<= 1
    return bits


def fold_bits(partial: DataFrame, bits: int, how: str) -> np.ndarray:
    """The filter from partial blocks ``(block, data)``; ``twice`` keeps the second half of each pair."""
    block = min(bits, BLOCK_BITS)
    n = max(1, rows_per_task(partial) // max(1, bits // block))
    out = np.zeros(bits >> 3, np.uint8)
    step = block >> 3
    for r in add_blocks(partial.withColumn("share", share_of(n)), block, "uint8", how).collect():
        out[r["block"] * step:(r["block"] + 1) * step] = np.frombuffer(zlib.decompress(r["data"]), np.uint8)[-step:]
    return out


def key_positions(h: np.ndarray, bits: int) -> np.ndarray:
    return positions(h, mix(h ^ np.uint64(0x2545F4914F6CDD1D)), bits)


def key_filter(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Filter of all 64-bit keys of a column; a task holds one array of ``bits``."""
    step = min(bits, BLOCK_BITS) >> 3

    def build(batches):
        held, used = np.zeros(bits >> 3, np.uint8), False
        for b in batches:
            used = True
            set_bits(held, key_positions(b.column(0).to_numpy().view(np.uint64), bits))
        for i in range(0, bits >> 3 if used else 0, step):
            if held[i:i + step].any():
                yield arrow("block int, data binary", block=[i // step], data=[zlib.compress(held[i:i + step].tobytes(), 1)])

    return fold_bits(keys.select(column).mapInArrow(build, "block int, data binary"), bits, "or")
