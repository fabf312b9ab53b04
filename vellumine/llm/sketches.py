"""Fast similarity sketching of sets (Dahlgaard, Knudsen and Thorup, FOCS 2017), for many sets at once.

A sketch has ``t`` bins.  In round ``i`` of the first ``t`` rounds every element is thrown into one
hashed bin with a hashed value of rank ``i``; in round ``t + j`` every element is thrown into bin
``j``.  A bin keeps its least value, and a set is done once all its bins are filled, which the last
``t`` rounds guarantee.  Two sets agree in a bin with a probability equal to their Jaccard
similarity, and the agreements are concentrated as if bins were drawn without replacement.
"""

from __future__ import annotations

import numpy as np

from vellumine.llm.words import mix

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(elements: np.ndarray, owner: np.ndarray, sets: int, t: int) -> np.ndarray:
    """(sets, t) sketches of the sets given by 64-bit ``elements`` and their ``owner`` (ascending).

    Every set must have an element.
    """
    out = np.full(sets * t, _EMPTY, dtype=np.uint64)
    open_sets = np.ones(sets, dtype=bool)
    for i in range(2 * t):
        h = mix(elements + np.uint64((i * 0x9E3779B97F4A7C15 + 0x1B873593) & 0xFFFFFFFFFFFFFFFF))
        value = (h & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32)
        where = ((h >> np.uint64(32)) % np.uint64(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + where, value)
        still = open_sets & (out.reshape(sets, t) == _EMPTY).any(axis=1)
        if not still.any():
            break
        if still.sum() < open_sets.sum():
            keep = still[owner]
            elements, owner = elements[keep], owner[keep]
        open_sets = still
    return out.reshape(sets, t)


def bands(sketches: np.ndarray, rows: int) -> np.ndarray:
    """(sets, t // rows) hashes of consecutive groups of ``rows`` bins, each group hashed apart."""
    sets, t = sketches.shape
    parts = sketches[:, : t // rows * rows].reshape(sets, -1, rows)
    out = np.broadcast_to(mix(np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(1)), parts.shape[:2]).copy()
    for r in range(rows):
        out = mix(out ^ parts[:, :, r])
    return out.view(np.int64)
