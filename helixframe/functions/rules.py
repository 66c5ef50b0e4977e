"""Constraint rules: each gives the probability that a strand fails, as a column; a rule set is their sum."""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions import strand as S

# Chance of failure by the longest run of a base; longer runs fail.
HOMOPOLYMERS = {
    "strict": [0.0, 0.0, 0.2, 0.5, 0.8, 1.0],
    "three_strict": [0.0, 0.0, 0.0, 0.0, 1.0],
    "four_strict": [0.0, 0.0, 0.0, 0.0, 0.0, 1.0],
    "lax_increasing": [0.0, 0.0, 0.01, 0.05, 0.4, 0.7, 0.9, 1.0],
}
# Undesired motifs and their weights.
MOTIFS = [
    ("ATAACTTCGTATAGCATACATTATACGAAGTTAT", 1.01),
    ("ATAACTTCGTATAGCATACATTATACGAACGGTA", 1.01),
    ("TACCGTTCGTATAGCATACATTATACGAAGTTAT", 1.01),
    ("TACCGTTCGTATAGCATACATTATACGAACGGTA", 1.01),
    ("TACCGTTCGTATATGGTATTATATACGAAGTTAT", 1.01),
    ("TACCGTTCGTATATTCTATCTTATACGAAGTTAT", 1.01),
    ("TACCGTTCGTATAGGATACTTTATACGAAGTTAT", 1.01),
    ("TACCGTTCGTATATACTATACTATACGAAGTTAT", 1.01),
    ("TACCGTTCGTATACTATAGCCTATACGAAGTTAT", 1.01),
    ("ATAACTTCGTATATGGTATTATATACGAACGGTA", 1.01),
    ("ATAACTTCGTATAGTATACCTTATACGAAGTTAT", 1.01),
    ("GAAGTGCCATTCCGCCTGACCT", 1.0),
    ("AGGCTAGGTGGAGGCTCAGTG", 1.0),
]
# Undesired patterns in IUPAC letters and their weights.
IUPAC_MOTIFS = [
    ("CANYYY", 0.01),
    ("ANCCAATCA", 0.01),
    ("KGGGCGGRRY", 0.01),
    ("KRGGCGKRRY", 0.01),
    ("AAAWWTWTTTTNNNAAA", 0.05),
    ("RCCACCATGG", 0.05),
    ("AGGAGGACAGCTAUG", 0.05),
    ("ATAACTTCGTATAGTAYACATTATACGAAGTTAT", 0.01),
]
# What an IUPAC letter stands for (U stands for itself).
IUPAC = {"R": "[AG]", "Y": "[CT]", "K": "[GT]", "W": "[AT]", "N": "[ACGT]"}


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def homopolymer(strand: Column, table: str = "four_strict") -> Column:
    """Chance by the longest run of one base: a search for each length at which the chance changes, from the longest on."""
    values = [*HOMOPOLYMERS[table], 1.0]
    out = None
    for n in sorted((i for i in range(1, len(values)) if values[i] != values[i - 1]), reverse=True):
        fits = strand.rlike("|".join(f"{b}{{{n}}}" for b in S.BASES))
        out = F.when(fits, values[n]) if out is None else out.when(fits, values[n])
    return F.lit(values[0]) if out is None else out.otherwise(F.lit(values[0]))


def gc_band(percent: Column, low: float = 30, high: float = 70) -> Column:
    return F.when((percent > high) | (percent < low), 1.0).otherwise(F.lit(0.0))


def gc_quartic(p: Column) -> Column:
    return _unit((100 + 175 * p / 6 - 121 * p * p / 72 + p * p * p / 36 - p * p * p * p / 7200) / 100)


def gc_strict(p: Column) -> Column:
    return _unit((100 + 49970.8 * p - 2582 * p * p + 41.6458 * p * p * p - 0.208229 * p * p * p * p) / 100)


def windowed_gc(strand: Column, window: int = 50, low: float = 30, high: float = 70) -> Column:
    """The worst window when the strand is cut into windows, of which the last may be shorter."""
    at = F.sequence(F.lit(0), F.greatest(F.length(strand) - 1, F.lit(0)), F.lit(window))
    return F.array_max(F.transform(at, lambda i: gc_band(S.gc_percent(F.substring(strand, i + 1, F.lit(window))), low, high)))


def _sharing(known: list[tuple[str, float]], k: int = 8) -> list[tuple[str, list]]:
    """The motifs by a piece of k bases that as many of them as possible have; without such a piece, by themselves."""
    out, left = [], list(known)
    while left:
        pieces = {}
        for m in left:
            for piece in {m[0][i : i + k] for i in range(len(m[0]) - k + 1)}:
                pieces.setdefault(piece, []).append(m)
        piece, some = max(sorted(pieces.items()), key=lambda x: len(x[1]), default=(left[0][0], left[:1]))
        some = some if len(some) > 1 else left[:1]
        out.append((piece if len(some) > 1 else some[0][0], some))
        left = [m for m in left if m not in some]
    return out


def motifs(strand: Column) -> Column:
    """Sum of the weights of the motifs that a strand has, at most 1.  Motifs are looked for only where a piece that they share is."""
    each = lambda known: _sum([F.when(strand.contains(m), p).otherwise(0.0) for m, p in known])
    return F.least(F.lit(1.0), _sum([F.when(strand.contains(piece), each(known)).otherwise(0.0) for piece, known in _sharing(MOTIFS)]))


def iupac_pattern(motif: str) -> str:
    return "".join(IUPAC.get(c, c) for c in motif)


def iupac_motifs(strand: Column) -> Column:
    return F.least(F.lit(1.0), _sum([F.when(strand.rlike(iupac_pattern(m)), p).otherwise(0.0) for m, p in IUPAC_MOTIFS]))


def unit_runs(strand: Column, unit: int) -> Column:
    n = S.unit_run(strand, unit)
    return _unit(0.00002 * n * n - 0.0001 * n)


def long_strand(strand: Column) -> Column:
    n = F.length(strand)
    return F.when(n >= 117, F.least(F.lit(0.2), 0.00144363 * F.exp(0.0140971 * n))).otherwise(0.0)


def permutation(strand: Column, base: str) -> Column:
    """Chance by the number of a base: 0.001 for each twenty, twice that for C and G, at most ten times."""
    step = 0.002 if base in "CG" else 0.001
    return F.least(F.lit(10 * step), F.floor(S.count_of(strand, base) / 20) * step)


def repeat_region(strand: Column, k: int = 20) -> Column:
    return F.when(S.has_repeat(strand, k), 1.0).otherwise(0.0)


def small_repeats(strand: Column, k: int = 9) -> Column:
    share = k * S.again_count(strand, k) / F.length(strand)
    return F.when(share > 0.44, 1.0).otherwise(share * 0.5)


def illegal_symbols(strand: Column) -> Column:
    return F.when(strand.rlike("[^ACGT]"), 1.0).otherwise(0.0)


def rule_sum(strand: Column, rules: list) -> Column:
    """The sum of any rules, each a function from a strand to a column."""
    return _sum([r(strand) for r in rules])


def default_errors(strands: list[str | None]) -> np.ndarray:
    """The sums of homopolymer, gc_band, windowed_gc and motifs with their defaults, of many strands at once; null counts as empty."""
    texts = [s or "" for s in strands]
    if not all(map(str.isascii, texts)):
        texts = [s if s.isascii() else "".join(c if c.isascii() else "?" for c in s) for s in texts]
    data, n = np.frombuffer("".join(texts).encode(), np.uint8), np.array([len(s) for s in texts], np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    gc = np.concatenate([[0], np.cumsum(_GC[data])])
    outside = lambda have, of: (100.0 * have / np.maximum(of, 1) > 70) | (100.0 * have / np.maximum(of, 1) < 30)

    same = np.zeros(len(data), bool)  # like the letter before
    same[1:] = (data[1:] == data[:-1]) & _BASE[data[1:]]
    same[starts[n > 0]] = False
    long = np.flatnonzero(same[1:-2] & same[2:-1] & same[3:] & np.concatenate([same[4:], [False]])) if len(data) > 3 else np.zeros(0, np.int64)
    out = np.zeros(len(texts))
    out[np.searchsorted(ends, long, side="right")] = 1.0

    out += outside(gc[ends] - gc[starts], n)
    count = np.maximum(-(-n // WINDOW), 1)
    first = np.cumsum(count) - count
    row = np.repeat(np.arange(len(texts)), count)
    low = starts[row] + (np.arange(len(row)) - first[row]) * WINDOW
    high = np.minimum(low + WINDOW, ends[row])
    if len(row):
        out += np.maximum.reduceat(outside(gc[high] - gc[low], high - low).astype(float), first)

    weights = np.zeros(len(texts))
    for piece, known in _SHARED:
        for i, s in enumerate(texts):
            if piece in s:
                weights[i] += sum(p if m in s else 0.0 for m, p in known)
    return out + np.minimum(weights, 1.0)


def default_errors_of(strands: np.ndarray) -> np.ndarray:
    """default_errors() of strands of one length as the rows of a table of letters, A, C, G and T alone."""
    rows, n = strands.shape
    if not rows or not n:
        return np.ones(rows) * 2.0  # no bases: both shares of G and C are too low
    outside = lambda have, of: (100.0 * have / of > 70) | (100.0 * have / of < 30)
    same = strands[:, 1:] == strands[:, :-1]
    out = (same[:, :-3] & same[:, 1:-2] & same[:, 2:-1] & same[:, 3:]).any(1).astype(float) if n > 4 else np.zeros(rows)
    gc, total, bad = (strands == ord("G")) | (strands == ord("C")), np.zeros(rows, np.int64), np.zeros(rows, bool)
    for at in range(0, n, WINDOW):
        have = np.count_nonzero(gc[:, at : at + WINDOW], axis=1)
        total += have
        bad |= outside(have, min(WINDOW, n - at))
    out += outside(total, n)
    out += bad
    whole, weights = strands.tobytes(), {}
    for piece, known in _SHARED:
        at, seen = whole.find(piece.encode()), set()
        while at >= 0:
            row = at // n
            if at + len(piece) <= (row + 1) * n and row not in seen:
                seen.add(row)
                text = whole[row * n : (row + 1) * n].decode()
                weights[row] = weights.get(row, 0.0) + sum(p if m in text else 0.0 for m, p in known)
            at = whole.find(piece.encode(), at + 1)
    for row, weight in weights.items():
        out[row] += min(weight, 1.0)
    return out


WINDOW = 50
_GC, _BASE = np.zeros(256, np.int64), np.zeros(256, bool)
_GC[list(b"GC")], _BASE[list(b"ACGT")] = 1, True
_SHARED = _sharing(MOTIFS)


@lru_cache
def _default_errors():
    @F.pandas_udf("double")
    def run(strands: pd.Series) -> pd.Series:
        return pd.Series(default_errors(strands.tolist()))

    return run


def default_rules(strand: Column) -> Column:
    """homopolymer + gc_band + windowed_gc + motifs, worked out for a batch of strands at a time."""
    return _default_errors()(strand)
