"""Nucleotide strands as string columns: built-in expressions, and NumPy over Arrow batches where k-mers of a strand are compared."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

BASES = "ACGT"
HEX = "0123456789abcdef"


def pair(digit: int) -> str:
    """Two bases for four bits, high ones first: A 00, C 01, G 10, T 11."""
    return BASES[digit >> 2] + BASES[digit & 3]


def once(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body names it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Letters whose codes are written with the digits 4 to 7 alone, in order: sixteen, one for each four bits, and a digit for each base.
LETTERS, DIGITS = "DEFGTUVWdefgtuvw", "4567"


#: The four bases of each byte, as the bytes of one number.
FOURS = np.frombuffer("".join(pair(i >> 4) + pair(i & 15) for i in range(256)).encode(), np.uint32)


def hex_to_strand(digits: Column) -> Column:
    """Hexadecimal digits as bases, two for each: a digit's letter has a code of two digits, and each of these is a base."""
    return F.translate(F.hex(F.translate(digits, HEX + "ABCDEF", LETTERS + LETTERS[10:])), DIGITS, BASES)


def to_strand(data: Column) -> Column:
    """Bytes as bases, four for each, high bits first."""
    return hex_to_strand(F.hex(data))


def from_strand(strand: Column) -> Column:
    """The bytes of a strand; null if it isn't whole bytes of A, C, G and T."""
    good = (F.length(strand) % 4 == 0) & (F.length(F.translate(strand, BASES, "")) == 0)
    return F.when(good, F.unhex(F.translate(F.unhex(F.translate(strand, BASES, DIGITS)).cast("string"), LETTERS, HEX)))


def _held(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of binaries or strings end to end, where each ends, from zero on, and which of them aren't null."""
    values = values.cast(pa.large_binary() if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type) else pa.large_string())
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0], values.is_valid().to_numpy(zero_copy_only=False)


def _built(kind: pa.DataType, data: np.ndarray, sizes: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Binaries or strings of bytes end to end, of the given sizes."""
    large = pa.large_string() if pa.types.is_string(kind) else pa.large_binary()
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(large, len(sizes), [pa.py_buffer(np.packbits(valid, bitorder="little")), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).cast(kind)


def strands_of(data: pa.Array) -> pa.Array:
    """to_strand() of a batch."""
    held, ends, valid = _held(data)
    return _built(pa.string(), FOURS[held], np.diff(ends) * 4, valid)


def bytes_of_strands(strands: pa.Array) -> pa.Array:
    """from_strand() of a batch."""
    held, ends, valid = _held(strands)
    n, code = np.diff(ends), _CODE[held]
    odd = np.concatenate([[0], np.cumsum(code > 3)])
    good = valid & (n % 4 == 0) & (odd[ends[1:]] == odd[ends[:-1]])
    if not good.all():
        code = code[np.repeat(good, n)]
    four = code.reshape(-1, 4)
    return _built(pa.binary(), four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3], np.where(good, n // 4, 0), good)


def reverse_complement(strand: Column) -> Column:
    return F.reverse(F.translate(strand, "ACGT", "TGCA"))


def count_of(strand: Column, bases: str) -> Column:
    """How many of the given bases a strand has."""
    return (F.length(strand) - F.length(F.translate(strand, bases, ""))).cast("long")


def gc_percent(strand: Column) -> Column:
    return F.when(F.length(strand) > 0, 100.0 * count_of(strand, "GC") / F.length(strand)).otherwise(F.lit(0.0))


def longest_run(strand: Column) -> Column:
    """Length of the longest run of one base."""
    runs = F.regexp_extract_all(strand, F.lit("(A+|C+|G+|T+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("long")


def kmers(strand: Column, k: int) -> Column:
    """All overlapping k-mers, in order; none of a shorter strand."""
    at = F.when(F.length(strand) >= k, F.sequence(F.lit(1), F.length(strand) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(strand, i, F.lit(k)))


_CODE = np.full(256, 4, np.uint8)
_CODE[list(b"ACGT")] = range(4)


def distinct_in(strands: list[str | None], k: int) -> np.ndarray:
    """Number of different k-mers of each strand: all strands of a batch laid end to end, k-mers as numbers, sorted once."""
    out = np.zeros(len(strands), np.int64)
    some = [i for i, s in enumerate(strands) if s is not None and len(s) >= k]
    odd = [i for i in some if k > 31 or not strands[i].isascii()]  # by strings, as are letters that are no bases
    some = sorted(set(some) - set(odd)) if odd else some
    if some:
        data = _CODE[np.frombuffer("".join([strands[i] for i in some]).encode(), np.uint8)]
        row = np.repeat(np.arange(len(some)), [len(strands[i]) for i in some])
        odd += [some[i] for i in np.unique(row[data > 3])]
        n, value = len(data) - k + 1, np.zeros(len(data) - k + 1, np.uint64)
        for j in range(k):
            value = value << np.uint64(2) | data[j : j + n] & np.uint8(3)
        inside = row[:n] == row[k - 1 :]
        value, row = value[inside], row[:n][inside]
        if 2 * k + len(some).bit_length() <= 64:
            value = np.sort(value | row.astype(np.uint64) << np.uint64(2 * k))
            new = np.concatenate([[True], value[1:] != value[:-1]])
            row = (value >> np.uint64(2 * k)).astype(np.int64)
        else:
            order = np.lexsort((value, row))
            value, row = value[order], row[order]
            new = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])
        out[some] = np.bincount(row[new], minlength=len(some))
    for i in odd:
        out[i] = len({strands[i][j : j + k] for j in range(len(strands[i]) - k + 1)})
    return out


def distinct_of(strands: pa.Array, k: int) -> np.ndarray:
    """distinct_in() of a batch: strands of one length are a table whose rows are sorted; others one by one."""
    held, ends, valid = _held(strands)
    n, code = np.diff(ends), _CODE[held]
    odd = np.concatenate([[0], np.cumsum(code > 3)])
    plain = valid & (odd[ends[1:]] == odd[ends[:-1]]) & (n >= k) & (k <= 31)
    lengths, out = np.unique(n[plain]), np.zeros(len(n), np.int64)
    if len(lengths) > 256:
        return distinct_in(strands.to_pylist(), k)
    for length in lengths.tolist():
        rows = np.flatnonzero(plain & (n == length))
        first, size = code[ends[rows][:, None] + np.arange(length)].astype(np.uint32 if k <= 16 else np.uint64), 1
        value = first
        for digit in bin(k)[3:]:  # by halves
            value = value[:, :-size] << value.dtype.type(2 * size) | value[:, size:]
            size *= 2
            if digit == "1":
                value, size = value[:, :-1] << value.dtype.type(2) | first[:, size:], size + 1
        value = np.sort(value, axis=1)
        out[rows] = 1 + (value[:, 1:] != value[:, :-1]).sum(1)
    rest = np.flatnonzero(valid & ~plain)
    out[rest] = distinct_in(strands.take(pa.array(rest)).to_pylist(), k)
    return out


@lru_cache
def _distinct(k: int):
    @F.arrow_udf(LongType())
    def count(strands: pa.Array) -> pa.Array:
        return pa.array(distinct_of(strands, k))

    return count


def distinct_kmers(strand: Column, k: int) -> Column:
    """How many different k-mers a strand has."""
    return F.when(strand.isNotNull(), _distinct(k)(strand))


def _again(strand: Column, k: int) -> Column:
    return F.greatest(F.length(strand) - k + 1, F.lit(0)) - distinct_kmers(strand, k)


def has_repeat(strand: Column, k: int = 20) -> Column:
    """Whether a k-mer comes again."""
    return _again(strand, k) > 0


def again_count(strand: Column, k: int = 9) -> Column:
    """One more than the number of k-mers that come again later."""
    return 1 + _again(strand, k)


def unit_run(strand: Column, unit: int) -> Column:
    """Longest run of equal units, when the strand is cut into units from its start: each match begins where the last one ends."""
    runs = F.regexp_extract_all(strand, F.lit(rf"(?s)((.{{{unit}}})\2*+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)) / unit, F.lit(0)).cast("long")


def checksum(strand: Column) -> Column:
    """Sum over the bases of A 1, C 2, G 3, T 4, modulo 256."""
    return (count_of(strand, "A") + 2 * count_of(strand, "C") + 3 * count_of(strand, "G") + 4 * count_of(strand, "T")) % 256


_WEIGHT = np.zeros(256, np.uint8)
_WEIGHT[list(b"ACGT")] = range(1, 5)


@F.arrow_udf(StringType())
def _checksums(strands: pa.Array) -> pa.Array:
    held, ends, valid = _held(strands)
    total = np.concatenate([[0], np.cumsum(_WEIGHT[held], dtype=np.int64)])
    return _built(pa.string(), FOURS[(total[ends[1:]] - total[ends[:-1]]) % 256][valid], np.where(valid, 4, 0), valid)


def checksum_bases(strand: Column) -> Column:
    """The checksum as four bases, worked out by the batch."""
    return _checksums(strand)


def with_checksum(strand: Column) -> Column:
    return F.concat(strand, checksum_bases(strand))


def checksum_ok(coded: Column, length: int) -> Column:
    """Whether a strand has `length` bases and the four of their checksum."""
    body = F.substring(coded, 1, length)
    return (F.length(coded) == length + 4) & (checksum_bases(body) == F.right(coded, F.lit(4)))
