"""Arrow text columns as numpy bytes, and vectorised 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (nulls empty) and the n + 1 offsets of texts in them, without a copy."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits (the finalizer of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    out = np.ones(n, dtype=U64)
    have, step = 1, base & 0xFFFFFFFFFFFFFFFF
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * U64(step)
        have += more
        step = step * step & 0xFFFFFFFFFFFFFFFF
    return out
