"""Words of whole texts as 64-bit hashes, in vectorised passes over the bytes.

Words are runs of bytes other than space and 9-13, A-Z lowered.  A word's hash
is a polynomial over a random table of byte values, mixed at the end; all words
of a chunk are summed at once and shifted back by an inverse power.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2^64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _byte_values() -> np.ndarray:
    v = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    v[65:91] = v[97:123]
    v[_SPACE] = 0
    return v


_VALUE = _byte_values()
_powers: list[np.ndarray] = []


def _pow(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK)
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    col = column.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text with the total at the end)."""
    return words_at(raw, offsets)[:2]


def words_at(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes and the byte where each word starts."""
    out, places, at, total = [], [], 0, len(raw)
    while at < total:
        end = min(at + CHUNK, total)
        if end < total:  # end after white space or at a text's end
            cut = offsets[np.searchsorted(offsets, end, "right") - 1]
            gaps = np.flatnonzero(_SPACE[raw[at:end]])
            cut = max(cut, at + gaps[-1] + 1 if len(gaps) else at)
            if cut <= at:
                cut = offsets[np.searchsorted(offsets, end, "left")]
                gaps = np.flatnonzero(_SPACE[raw[end:cut]])
                cut = end + gaps[0] + 1 if len(gaps) else cut
            end = int(cut)
        b = raw[at:end]
        space = _SPACE[b]
        first = np.empty(len(b), bool)
        first[0], first[1:] = True, space[:-1]
        inside = offsets[(offsets >= at) & (offsets < end)] - at
        first[inside] = True
        starts = np.flatnonzero(first & ~space)
        if len(starts):
            p, inverse = _pow(len(b))
            h = np.add.reduceat(_VALUE[b] * p[: len(b)], starts) * inverse[starts]
            out.append(mix(h))
            places.append(starts + at)
        at = end
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    at = np.concatenate(places)
    return np.concatenate(out), np.searchsorted(at, offsets), at


def shingle_sets(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their bounds.

    Fewer words than ``width`` make one shingle, no words none.
    """
    # Random odd factors: with regular ones, rearranged words could cancel out.
    factor = np.random.default_rng(width).integers(1, 1 << 63, width + 1, dtype=np.uint64) | np.uint64(1)
    n = len(words)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h[: max(n - i, 0)] += words[i:] * factor[i]
    h = mix(h)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            sets.append(np.unique(h[a: b - width + 1]))
        elif b > a:
            short = np.add.reduce(words[a:b] * factor[: b - a]) + np.uint64(b - a) * factor[width]
            sets.append(mix(np.atleast_1d(short)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64),
            np.cumsum([0] + [len(s) for s in sets]))
