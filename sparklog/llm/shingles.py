"""Word shingles of many texts at once, as 64-bit hashes, in NumPy.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  A text's set has the
distinct ``k``-word shingles; with fewer words, the whole sequence as one; without words
it is empty.  UTF-8 bytes are hashed directly, no Python object is made per word.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_STEP = mix(np.arange(1001, 1065, dtype=np.uint64) * _GOLDEN) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, *range(9, 14)]] = False


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers below ``n``."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(1, np.uint64)
        while len(p) < n:
            p = np.concatenate([p, p * _U(pow(base, len(p), 1 << 64))])
        out.append(p)
    return out[0], out[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column, and n + 1 offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and n + 1 offsets of each text's words."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _IN_WORD[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begin = np.flatnonzero(inside[1:-1] & (edge[:-1] | ~inside[:-2]))
    end = np.flatnonzero(inside[1:-1] & (edge[1:] | ~inside[2:])) + 1
    up, down = _powers(1 << max(21, (n - 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
    words = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _GOLDEN)
    return words, np.searchsorted(begin, at)


def shingle_sets(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and n + 1 offsets."""
    raw, at = utf8(column)
    words, bounds = word_hashes(raw, at)
    count = np.diff(bounds)
    shingles = np.maximum(count - (k - 1), np.minimum(count, 1))
    out_at = np.concatenate([[0], np.cumsum(shingles)])
    if not len(words):
        return np.zeros(0, np.uint64), out_at
    first = np.repeat(bounds[:-1] - out_at[:-1], shingles) + np.arange(out_at[-1])
    length = np.repeat(np.minimum(count, k), shingles)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    total = length.astype(np.uint64)
    for j in range(k):
        total += np.where(j < length, padded[first + j] * _STEP[j], _U(0))
    total = mix(total)
    sets = [np.unique(total[a:b]) for a, b in zip(out_at[:-1].tolist(), out_at[1:].tolist(), strict=True)]
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
