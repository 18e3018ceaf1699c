"""Word shingle sets of many texts at once."""

from __future__ import annotations

import numpy as np

from edgeloom.llm.bytestrings import binary_slices, counted, digests, mix, ragged

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and offsets of each text's words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    change = np.empty(len(data), bool)
    change[0] = True
    change[1:] = inside[1:] != inside[:-1]
    change |= first[:-1]
    at = np.flatnonzero(change)
    ends = np.append(at[1:], len(data))
    keep = inside[at]
    starts, ends = at[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and their offsets.

    A shingle's hash mixes the cryptographic digests of its words.
    Words are runs of bytes other than the six ASCII spaces, with A-Z lowered. A
    text of fewer than ``k`` words has its whole word sequence as one shingle; a
    text without words has none.
    """
    starts, ends, word_at = words(data, offsets)
    named = binary_slices(_LOWER[data], starts, ends).dictionary_encode()
    hashed = digests(named.dictionary.to_pylist())[named.indices.to_numpy()]
    counts = np.diff(word_at)
    n = np.maximum(counts - k + 1, 0)
    first = ragged(word_at[:-1], n)
    weights = mix(np.arange(1, k + 2, dtype=np.uint64)) | np.uint64(1)
    full = np.zeros(len(first), np.uint64)
    for j in range(k):
        full += hashed[first + j] * weights[j]
    full = mix(full)
    short = np.flatnonzero((counts > 0) & (counts < k))
    own = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        has = counts[short] > j
        own[has] += hashed[word_at[short[has]] + j] * weights[j]
    own = mix(own + counts[short].astype(np.uint64) * weights[k])
    at = counted(np.repeat(np.arange(len(n)), n), len(n))
    parts, sizes = [], np.zeros(len(n), np.int64)
    for i in np.flatnonzero(n):
        parts.append(np.unique(full[at[i]:at[i + 1]]))
        sizes[i] = len(parts[-1])
    sizes[short] = 1
    out_at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(out_at[-1], np.uint64)
    long_rows = np.repeat(n > 0, sizes)
    if parts:
        out[long_rows] = np.concatenate(parts)
    out[~long_rows] = own
    return out, out_at
