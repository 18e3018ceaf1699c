"""Array arithmetic over the bytes of many texts at once.

Texts of a chunk lie end to end in one byte array; offsets mark where each
begins. Strings that a result depends on are told apart by their bytes or by
cryptographic digests; windows of one length have hashes made by mixing halves.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and ``n + 1`` offsets; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def binary_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings ``data[starts[i]:ends[i]]`` as an Arrow array."""
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes)])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[ragged(starts, sizes)]))])


def digests(strings: Iterable[bytes]) -> np.ndarray:
    """A 64-bit BLAKE2b digest of every byte string."""
    return np.frombuffer(b"".join(blake2b(x, digest_size=8).digest() for x in strings), np.uint64)


def window_hashes(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash of every window of ``length`` bytes.

    Hashes of two neighbouring windows are mixed into that of the window of twice the length, so no
    sum of powers, whose collisions can be built, is behind it.
    """
    return run_hashes(mix((np.arange(1, 257, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(BASE))[data], length)


def run_hashes(level: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` neighbouring values."""
    out, done, size = None, 0, 1
    n = len(level) - length + 1
    while True:
        if length & size:
            part = level[done:done + n]
            out = part if out is None else mix(out * np.uint64(BASE) + mix(part + np.uint64(size)))
            done += size
        if done == length:
            return out
        level = mix(level[:-size] * np.uint64(BASE) + mix(level[size:] + np.uint64(size)))
        size *= 2


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` for every i, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    ends = np.cumsum(lengths)
    step[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


def counted(owner_sorted: np.ndarray, n: int) -> np.ndarray:
    """Offsets (n + 1) of rows whose sorted owner is 0 .. n - 1."""
    return np.concatenate([[0], np.cumsum(np.bincount(owner_sorted, minlength=n))]).astype(np.int64)
