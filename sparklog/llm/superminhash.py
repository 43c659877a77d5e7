"""SuperMinHash signatures of many sets at once.

Each element takes the ``m`` places of a signature in a random order of its own.  In round
``j`` it offers ``j`` plus a random fraction to the ``j``-th place of its order, and a place
keeps the least offer.  Offers of round ``j`` exceed all of the rounds before, so a set whose
places are all taken stops early: large sets after two or three rounds, sets of a single
element after ``m``.  The ranks of an element are correlated (they are a permutation), which
makes the variance of the estimate lower than with independent hashes.
"""

from __future__ import annotations

import numpy as np

from sparklog.llm.shingles import _GOLDEN, _U, mix


def _fraction(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def signatures(elements: np.ndarray, at: np.ndarray, m: int = 128) -> np.ndarray:
    """One row of ``m`` doubles for each set of ``elements[at[i]:at[i + 1]]``; infinite for the empty set."""
    n_sets = len(at) - 1
    sig = np.full(n_sets * m, np.inf)
    owner = np.repeat(np.arange(n_sets), np.diff(at))
    order = None
    for j in range(m):
        if not len(elements):
            break
        random = mix(elements + _U((j + 1) * int(_GOLDEN) & (1 << 64) - 1))
        pick = j + (_fraction(mix(random ^ _U(0x5851F42D4C957F2D))) * (m - j)).astype(np.int64)
        if j == 0:
            place = pick
        else:
            rows = np.arange(len(elements))
            place = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, j]
        np.minimum.at(sig, owner * m + place, j + _fraction(random))
        done = np.isfinite(sig).reshape(n_sets, m).all(1)
        left = ~done[owner]
        if j == 0:
            elements, owner, pick = elements[left], owner[left], pick[left]
            order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(elements), 1))
            order[np.arange(len(elements)), pick] = order[:, 0]
        elif not left.all():
            elements, owner, order = elements[left], owner[left], order[left]
    return sig.reshape(n_sets, m)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """For each signature a 64-bit key of each band of ``rows`` places; the band's number is part of it."""
    n, m = sig.shape
    bits = sig.view(np.uint64).reshape(n, m // rows, rows)
    key = np.tile(np.arange(1, m // rows + 1, dtype=np.uint64) * _GOLDEN, (n, 1))
    for j in range(rows):
        key = mix(key ^ bits[:, :, j])
    return key

