"""Sets of word shingles as 64-bit hashes, and exact Jaccard similarity of such sets."""

from __future__ import annotations

import numpy as np

from graphloom.llm.common import _splitmix, words

_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, laid end to end, and their offsets (texts + 1).

    A text of fewer words than `size`, but one at least, has its whole sequence as the only shingle.
    """
    n = len(offsets) - 1
    w = words(raw, offsets)
    counts = w.per_row(n)
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(0, np.uint64)
    row = np.zeros(0, np.int64)
    if len(w.hash) >= size:
        total = len(w.hash) - size + 1
        out = np.zeros(total, np.uint64)
        for k in range(size):
            out += _splitmix(w.hash[k : k + total] + _STEPS[k % len(_STEPS)] + np.uint64(k))
        inside = w.row[:total] == w.row[size - 1 :]
        out, row = _splitmix(out[inside]), w.row[:total][inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = []
        for r in short:
            h = w.hash[first[r] : first[r + 1]]
            own.append(_splitmix(np.array([sum(int(x) * (2 * i + 3) for i, x in enumerate(h.tolist())) + len(h) & (1 << 64) - 1], np.uint64))[0])
        out, row = np.concatenate([out, np.array(own, np.uint64)]), np.concatenate([row, short])
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    if len(out):
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
        out, row = out[new], row[new]
    return out, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum()) if len(b) else 0
