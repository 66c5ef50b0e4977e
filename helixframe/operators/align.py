"""Alignment of two strings: edit scripts, local alignment and CIGAR arithmetic as columns, and plain functions for consensus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from helixframe.functions import strand as S


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, with a bit for each place of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def similarity(a: str, b: str) -> float:
    """2 * LCS over both lengths; two empty strings are alike."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def _columns(a: str, b: str) -> Iterator[tuple[int, int, int]]:
    """For each letter of b a column of the matrix of edit distances, with a bit for each place of a: where a cell equals its corner, and where
    it is one more or one less than the cell above (Myers, Hyyroe)."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    more, less = full, 0
    for c in b:
        eq = where.get(c, 0)
        same = ((((eq & more) + more) ^ more) | eq | less) & full
        right, left = (less | full & ~(same | more)) << 1 | 1, (same & more) << 1
        more, less = (left | ~(same | right)) & full, same & right
        yield same, more, less


def edit_distance(a: str, b: str) -> int:
    more = less = 0
    if not b:
        return len(a)
    for _, more, less in _columns(a, b):
        pass
    return len(b) + more.bit_count() - less.bit_count()


def edit_script(a: str, b: str) -> str:
    """One letter for each column of a global alignment that turns a into b at the least edit cost: = X, I (only in b), D (only in a).

    Of equal costs the diagonal is taken first, then D.
    """
    columns = list(_columns(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append("=")
            continue
        same, more, _ = columns[j - 1]
        if not same >> i - 1 & 1:
            i, j = i - 1, j - 1
            out.append("X")
        elif more >> i - 1 & 1:
            i -= 1
            out.append("D")
        else:
            j -= 1
            out.append("I")
    return "D" * i + "I" * j + "".join(reversed(out))


def to_cigar(script: str) -> str:
    return "".join(f"{len(m[0])}{m[0][0]}" for m in re.finditer(r"(.)\1*", script))


def gapped(a: str, b: str) -> tuple[str, str]:
    """Both strings with gaps, of equal length."""
    x, y, i, j = [], [], 0, 0
    for op in edit_script(a, b):
        x.append("-" if op == "I" else a[i])
        y.append("-" if op == "D" else b[j])
        i, j = i + (op != "I"), j + (op != "D")
    return "".join(x), "".join(y)


_FAR = 1 << 30


def _diagonal(a: Column, b: Column, t: Column, one: Column, two: Column, cell) -> Column:
    """Diagonal t of the matrix of two strings from the two before it, all its cells at once.

    cell(i, j, up, left, corner, equal) gives a cell from its neighbours.  Entry i is the cell of i letters of a and t - i of b; null where
    that is outside the matrix.
    """

    def at(i):
        j = t - i
        equal = F.substring(a, i, F.lit(1)) == F.substring(b, j, F.lit(1))
        return F.when((j >= 0) & (j <= F.length(b)), cell(i, j, F.get(one, i - 1), F.get(one, i), F.get(two, i - 1), equal))

    return F.transform(F.sequence(F.lit(0), F.length(a)), at)


def _distance_diagonals(a: Column, b: Column) -> Column:
    """All diagonals of the matrix of edit distances.  They are the fold's state by themselves: a lambda's result would be copied."""
    far = lambda x: F.coalesce(x, F.lit(_FAR))

    def cell(i, j, up, left, corner, equal):
        inner = F.least(far(up) + 1, far(left) + 1, far(corner) + F.when(equal, 0).otherwise(1))
        return F.when((i == 0) | (j == 0), i + j).otherwise(inner)

    def step(all_, t):
        return F.concat(all_, F.array(_diagonal(a, b, t, F.get(all_, t - 1), F.get(all_, t - 2), cell)))

    return F.aggregate(F.sequence(F.lit(0), F.length(a) + F.length(b)), F.array().cast("array<array<int>>"), step)


def script_of(a: Column, b: Column) -> Column:
    """One letter for each column of a global alignment that turns a into b at the least edit cost: = X, I (only in b), D (only in a).

    Of equal costs the diagonal is taken first, then D.  Null where a or b is.
    """
    kind = "struct<i:int,j:int,ops:string>"
    start = F.struct(F.length(a).alias("i"), F.length(b).alias("j"), F.lit("").alias("ops")).cast(kind)

    def traced(all_):
        def step(s, _):
            i, j = s["i"], s["j"]
            cost = lambda i, j: F.get(F.get(all_, i + j), i)
            equal = F.substring(a, i, F.lit(1)) == F.substring(b, j, F.lit(1))
            here = cost(i, j)
            go = lambda di, dj, op: F.struct((i - di).alias("i"), (j - dj).alias("j"), F.concat(op, s["ops"]).alias("ops"))
            diagonal = (i > 0) & (j > 0) & (here == cost(i - 1, j - 1) + F.when(equal, 0).otherwise(1))
            down = (i > 0) & (here == cost(i - 1, j) + 1)
            return F.when((i == 0) & (j == 0), s).when(diagonal, go(1, 1, F.when(equal, "=").otherwise("X"))).when(down, go(1, 0, F.lit("D"))).otherwise(go(0, 1, F.lit("I")))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a) + F.length(b), F.lit(1))), start, step)["ops"]

    return F.when(a.isNotNull() & b.isNotNull(), S.once(_distance_diagonals(a, b), traced))


def cigar_of(script: Column) -> Column:
    """A script with equal letters put together: their number, and the letter."""
    return F.array_join(F.transform(F.regexp_extract_all(script, F.lit("(=+|X+|I+|D+)"), F.lit(1)), lambda x: F.concat(F.length(x), F.left(x, F.lit(1)))), "")


def count_in(script: Column, op: str) -> Column:
    return F.length(script) - F.length(F.replace(script, F.lit(op), F.lit("")))


def gapped_by(script: Column, text: Column, gap: str) -> Column:
    """A string with a gap for each `gap` of a script: I for the first string, D for the second."""
    other = "=XD" if gap == "I" else "=XI"
    before = lambda t: F.length(F.translate(F.left(script, t), other, ""))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(script)), lambda t: F.when(F.substring(script, t, F.lit(1)) == gap, "-").otherwise(F.substring(text, t - before(t), F.lit(1)))), "")


def local_score_of(a: Column, b: Column, match: int = 1, mismatch: int = -1, gap: int = -1) -> Column:
    """Best local alignment of two strings (Smith and Waterman, linear gaps), as a column; 0 of an empty one, null of null."""
    kind = "struct<one:array<int>,two:array<int>,top:int>"
    start = F.struct(F.array().cast("array<int>").alias("one"), F.array().cast("array<int>").alias("two"), F.lit(0).alias("top")).cast(kind)
    none = lambda x: F.coalesce(x, F.lit(0))
    cell = lambda i, j, up, left, corner, equal: F.when((i == 0) | (j == 0), 0).otherwise(F.greatest(F.lit(0), none(up) + gap, none(left) + gap, none(corner) + F.when(equal, match).otherwise(mismatch)))

    def step(s, t):
        return S.once(_diagonal(a, b, t, s["one"], s["two"], cell), lambda d: F.struct(d.alias("one"), s["one"].alias("two"), F.greatest(s["top"], F.array_max(d)).alias("top")))

    every = F.sequence(F.lit(0), F.length(a) + F.length(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(every, start, step)["top"])


def errors_by_position(rows: DataFrame, cigar: str = "cigar") -> DataFrame:
    """(position, n_match, n_mismatch, n_deletion, n_insertion): what alignments to a reference do at each of its places, from 0.

    CIGARs of = X D I; an insertion counts at the place that it stands before.  Runs become places only after they are cut, so that no
    alignment is gathered; those without a run, and nulls, count nowhere.
    """
    run = F.transform(F.regexp_extract_all(cigar, F.lit("(\\d+[=XDI])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, "(\\d+)", 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))
    kind = "struct<at:int,runs:array<struct<at:int,n:int,op:string>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,n:int,op:string>>").alias("runs")).cast(kind)

    def place(s, x):
        here = F.struct(s["at"].alias("at"), x["n"].alias("n"), x["op"].alias("op"))
        return F.struct((s["at"] + F.when(x["op"] == "I", 0).otherwise(x["n"])).alias("at"), F.concat(s["runs"], F.array(here)).alias("runs")).cast(kind)

    runs = rows.where(F.col(cigar).isNotNull()).select(F.inline(F.aggregate(run, start, place)["runs"])).where("n > 0")
    places = runs.select("op", F.when(F.col("op") == "I", F.col("n")).otherwise(1).alias("n"), F.explode(F.when(F.col("op") == "I", F.array("at")).otherwise(F.sequence("at", F.col("at") + F.col("n") - 1))).alias("position"))
    names = {"match": "=", "mismatch": "X", "deletion": "D", "insertion": "I"}
    return places.groupBy("position").agg(*[F.coalesce(F.sum(F.when(F.col("op") == op, F.col("n"))), F.lit(0)).cast("long").alias(f"n_{name}") for name, op in names.items()])


def local_score(a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -1) -> int:
    """Best local alignment (Smith and Waterman, linear gaps)."""
    y = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    row, steps, top = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1) * gap, 0
    for c in a:
        new = np.zeros_like(row)
        new[1:] = np.maximum(0, np.maximum(row[:-1] + np.where(y == ord(c), match, mismatch), row[1:] + gap))
        row = np.maximum.accumulate(new - steps) + steps
        top = max(top, int(row.max()))
    return top


def kmer_alignment(kmer: str, alt: str) -> list[str]:
    """What a changed k-mer holds for each base of the k-mer: a base, none, or more than one.  Ends are kept apart, so that k-mers chain."""
    if len(kmer) < 2 or not alt:
        return [alt, *[""] * (len(kmer) - 1)]
    inner_a, inner_b = kmer[1:-1], alt[1:-1] if len(alt) > 1 else ""
    out, j = [alt[0]], 0
    for op in edit_script(inner_a, inner_b):
        if op == "I":
            out[-1] += inner_b[j]
        else:
            out.append("" if op == "D" else inner_b[j])
        j += op != "D"
    return [*out, alt[-1] if len(alt) > 1 else ""]


def cigar_identity(cigar: Column) -> Column:
    """Matches over columns of a CIGAR of = X I D; 0 for an empty one."""
    total = lambda ops: F.aggregate(F.regexp_extract_all(cigar, F.lit(f"(\\d+)[{ops}]"), F.lit(1)), F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint"))
    every = total("=XIDM")
    return F.when(every > 0, total("=") / every).otherwise(F.lit(0.0))


def positional_identity(a: Column, b: Column) -> Column:
    """Equal letters at equal places over the length of b; 0 for an empty b."""
    both = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.when(both > 0, F.sequence(F.lit(1), both)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda n, i: n + (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))).cast("int"))
    return F.when(F.length(b) > 0, same / F.length(b)).otherwise(F.lit(0.0))


def phred_error(quality: Column) -> Column:
    """Mean chance of error of a quality string (Phred + 33); null for an empty one."""
    marks = F.split(quality, "")
    total = F.aggregate(F.filter(marks, lambda c: c != ""), F.lit(0.0), lambda s, c: s + F.pow(F.lit(10.0), -(F.ascii(c) - 33) / 10.0))
    return F.when(F.length(quality) > 0, total / F.length(quality))
