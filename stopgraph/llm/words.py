"""Words and word shingles of whole texts as 64-bit hashes, a batch at a time."""

from __future__ import annotations

from functools import cache

import numpy as np

from .common import byte_slices, mix

#: Bytes hashed at once; a longer text is cut between words, a longer word is one piece.
PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256)
_LOW[65:91] += 32
_BYTE = mix((_LOW.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_OR_SPACE = np.where(SPACE, np.uint64(0), _BYTE)
_ODD = 0xD1342543DE82EF95
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_ODD, -1, 1 << 64)
    up, down = np.full(n, _ODD, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _piece(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in ``data``; a word also begins at each break."""
    n = len(data)
    size = max(PIECE, 1 << (n - 1).bit_length() if n > 1 else 1)
    up, down = _powers(size)
    space = SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    inside = breaks[breaks < n]
    first[inside] = ~space[inside]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sums = np.add.reduceat(_BYTE_OR_SPACE[data] * up[:n], starts)
    return mix(sums * down[starts]), starts


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in order, and the number of words of each text."""
    hashes, counts = [], np.zeros(len(off) - 1, np.int64)
    for i, j in byte_slices(off, PIECE):
        begin, end = int(off[i]), int(off[j])
        if end - begin <= PIECE:
            h, starts = _piece(data[begin:end], off[i:j] - begin)
            hashes.append(h)
            counts[i:j] = np.diff(np.searchsorted(starts, off[i : j + 1] - begin))
            continue
        while begin < end:  # one long text: cut after the last space within reach
            stop = min(begin + PIECE, end)
            while stop < end:
                gaps = np.flatnonzero(SPACE[data[begin:stop]])
                if len(gaps):
                    stop = begin + int(gaps[-1]) + 1
                    break
                stop = min(stop + PIECE, end)
            h, _ = _piece(data[begin:stop], np.zeros(1, np.int64))
            hashes.append(h)
            counts[i] += len(h)
            begin = stop
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and each set's size.

    A text of fewer words than ``width`` has its whole sequence as its only shingle; one
    without words has none.
    """
    w, counts = word_hashes(data, off)
    n_docs = len(counts)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = np.zeros(n_docs + 1, np.int64)
    np.cumsum(made, out=at[1:])
    out = np.empty(at[-1], np.uint64)
    first = np.zeros(n_docs + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    if len(w) >= width:
        n = len(w) - width + 1
        s = w[:n] * _STEP[0]
        for k in range(1, width):
            s += w[k : n + k] * _STEP[k % 5] * np.uint64(2 * (k // 5) + 1)
        s = mix(s)
    full = counts >= width
    for d in np.flatnonzero(full).tolist():
        part = out[at[d] : at[d + 1]]
        part[:] = s[first[d] : first[d] + made[d]]
        part.sort()
    for d in np.flatnonzero(~full & (counts > 0)).tolist():
        own = w[first[d] : first[d + 1]]
        total = np.full(1, 0x5851F42D4C957F2D, np.uint64) * np.uint64(len(own))
        for k in range(len(own)):
            total += own[k : k + 1] * _STEP[k % 5]
        out[at[d]] = mix(total)[0]
    if not len(out):
        return out, made
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[at[:-1][made > 0]] = True
    kept = np.zeros(len(out) + 1, np.int64)
    np.cumsum(fresh, out=kept[1:])
    return out[fresh], kept[at[1:]] - kept[at[:-1]]
