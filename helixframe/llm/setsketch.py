"""SetSketch registers (Ertl, 2021): each holds the exponent, on a scale of powers of `base`, of the least of one exponential minimum a set.

Each element has a stream of points in time of its own, at rate SPEED * REGISTERS, each of which marks one register at random; a register
takes the earliest point of all elements.  So sketches of unions are the maximum of exponents, and a register of two sets is equal about as
often as their Jaccard similarity.  A row looks at points up to a limit only, and again up to a later one until all its registers are
marked: the limit changes the work and never the result.
"""

from __future__ import annotations

import numpy as np

from helixframe.llm.common import mix

REGISTERS = 255
SPEED = 20.0
BASE = 1.1
TOP = 254
#: Points a register that are looked at in the first try.
LIMIT = 9.0
_INF = np.float64(np.inf)


def _minima(x: np.ndarray, row: np.ndarray, size: np.ndarray, limit: float) -> np.ndarray:
    """The earliest point of each register and row, of those before limit / (SPEED * size); infinite where there is none."""
    n = len(size)
    out = np.full(n * REGISTERS, _INF)
    ends = limit / (SPEED * np.maximum(size, 1))
    time, turn = np.zeros(len(x)), 0
    while len(x):
        u = mix(x, 300 + turn)
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (SPEED * REGISTERS)
        alive = time < ends[row]
        x, row, time = x[alive], row[alive], time[alive]
        mark = (mix(x, 5000 + turn) >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)
        np.minimum.at(out, row * REGISTERS + mark.astype(np.int64), time)
        turn += 1
    return out.reshape(n, REGISTERS)


def registers(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers (uint8) of the sets of a flat array of distinct hashes; the set of row i is x[at[i]:at[i + 1]].  An empty set has zeros."""
    size = np.diff(at)
    out = np.zeros((len(size), REGISTERS), np.uint8)
    todo, limit = np.flatnonzero(size), LIMIT
    while len(todo):
        lengths = size[todo]
        begin = np.cumsum(lengths) - lengths
        flat = x[np.repeat(at[:-1][todo] - begin, lengths) + np.arange(lengths.sum())]
        least = _minima(flat, np.repeat(np.arange(len(todo)), lengths), lengths, limit)
        full = np.isfinite(least).all(1)
        out[todo[full]] = np.clip(np.floor(1 - np.log(least[full]) / np.log(BASE)), 0, TOP).astype(np.uint8)
        todo, limit = todo[~full], limit * 2
    return out


def _apart(x: np.ndarray) -> np.ndarray:
    """-log_base(1 - x (base - 1) / base), the chance of one register exceeding another by the share x of its set."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def chances(size_a, size_b, jaccard):
    """Chances that a register of a is greater, that of b is greater, and that both are equal."""
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    more, less = _apart(u - v * jaccard), _apart(v - u * jaccard)
    return more, less, 1 - more - less


def evidence_against(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, jaccard: float, steps: int = 24) -> np.ndarray:
    """How much likelier, as a logarithm, registers a and b are under the best similarity below `jaccard` than under any from it on.

    a, b: (pairs, REGISTERS).  The joint likelihood of a pair is that of its counts of greater, smaller and equal registers, whose chances
    follow from both sizes and the similarity.  It has one peak, so where that is below the limit the limit itself is the best from it on;
    0 where it is not.  Looking at `steps` similarities only makes the evidence weaker.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = REGISTERS - more - less
    size_a, size_b = size_a.astype(float), size_b.astype(float)
    most = np.minimum(size_a, size_b) / np.maximum(size_a, size_b)  # no pair of these sizes is more similar

    def likelihood(j):
        p, q, r = chances(size_a, size_b, j)
        return sum(n * np.log(np.maximum(c, 1e-300)) for n, c in ((more, p), (less, q), (same, r)))

    below = likelihood(np.zeros(1))
    for i in range(1, steps):
        below = np.maximum(below, likelihood(np.minimum(jaccard * i / steps, most)))
    return np.where(most < jaccard, _INF, np.maximum(below - likelihood(jaccard), 0))
