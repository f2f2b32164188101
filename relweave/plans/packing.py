"""Sorted 32- or 64-bit values as bytes that Spark's compression of shuffles shortens."""

from __future__ import annotations

import numpy as np


def pack_sorted(x: np.ndarray) -> bytes:
    """Steps between neighbouring values, the first bytes of all before the second ones and so on.

    Neighbours in a long sorted array share their high bytes, which leaves long runs of one byte.
    Values are taken by their bits, so any order gives them back; a sorted one is only shorter.
    """
    bits = np.ascontiguousarray(x).view(f"<u{x.itemsize}")
    step = np.diff(bits, prepend=bits.dtype.type(0))
    return step.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unpack_sorted(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    step = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(dtype.itemsize, -1).T).view(f"<u{dtype.itemsize}")
    return np.cumsum(step.ravel(), dtype=step.dtype).view(dtype)
