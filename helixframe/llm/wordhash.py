"""Words `[^\\x20\\x09-\\x0D]+` of many texts at once, as 64-bit hashes in NumPy arrays."""

from __future__ import annotations

import numpy as np

from helixframe.llm.common import mix

_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_EXACT = mix(np.arange(256, dtype=np.uint64), 77) | np.uint64(1)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]
_BASE = 0x9E6C63D0876A9A35
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}
PIECE = 1 << 18


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for the next call."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(PIECE + 1, n)
        have = np.full(size, np.uint64(base))
        have[0] = np.uint64(1)
        _powers[key] = have = np.multiply.accumulate(have)
    return have[:n]


def words(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, its row, and the first word of each row (one more entry closes the last row).

    data, offsets: texts laid end to end.  fold: A-Z count as a-z.  A word's hash is that of its bytes alone.
    """
    n, rows = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    inside = _WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    table, hashes = _FOLDED if fold else _EXACT, np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):  # pieces that end with a word, so that no array grows with a long text
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, "right")))
        lo, hi = starts[a], ends[b - 1]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(table[data[lo:hi]] * _power(_BASE, hi - lo))])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        hashes[a:b] = mix((sums[e] - sums[s]) * _power(_INVERSE, hi - lo)[s])
        a = b
    first = np.searchsorted(starts, offsets)
    return hashes, np.repeat(np.arange(rows), np.diff(first)), first


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, rows not regarded: entry i covers words i to i + k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[j : j + n]
    return mix(out, k)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
