"""Field arithmetic in built-in expressions: checksums of 8, 16 and 64 bits, Reed-Solomon over GF(256) with two parity bytes and over GF(4).

Bytes are arrays of numbers, products and logarithms are looked up in arrays of literals, and words are folded byte by byte.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from helixframe.functions import strand as S
from helixframe.functions.strand import BASES, once
from helixframe.operators.correction import EXP, LOG, POLYNOMIALS, _crc_table, _generator, _mul

WORD = 255
PARITY = 2


def _table(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def bytes_of(data: Column) -> Column:
    """Binary data as an array of numbers from 0 to 255."""
    at = F.sequence(F.lit(1), 2 * F.octet_length(data), F.lit(2))
    numbers = once(F.hex(data), lambda x: F.transform(at, lambda i: F.conv(F.substring(x, i, F.lit(2)), 16, 10).cast("int")))
    return F.when(F.octet_length(data) > 0, numbers).when(data.isNotNull(), F.array().cast("array<int>"))


def binary_of(numbers: Column) -> Column:
    """The inverse of bytes_of()."""
    return F.unhex(F.array_join(F.transform(numbers, lambda b: F.lpad(F.hex(b), 2, F.lit("0"))), ""))


def crc(data: Column, letter: str = "B") -> Column:
    """The checksum of bytes by struct letter: B 8, H 16, L or I 32, Q 64 bits (as a signed number); null of null."""
    if letter in "LI":
        return F.crc32(data)
    width = POLYNOMIALS[letter][1]
    signed = [v - (1 << 64) if v >> 63 else v for v in _crc_table(letter)]
    table = F.array(*[F.lit(v).cast("long") for v in signed])
    keep = F.lit(-1 if width == 64 else (1 << width) - 1).cast("long")

    def step(c, b):
        top = F.shiftrightunsigned(c, width - 8).bitwiseAND(F.lit(255)).bitwiseXOR(b.cast("long"))
        return F.shiftleft(c, 8).bitwiseAND(keep).bitwiseXOR(F.get(table, top.cast("int")))

    return F.when(data.isNotNull(), F.aggregate(bytes_of(data), F.lit(0).cast("long"), step))


def crc_bytes(data: Column, letter: str = "B") -> Column:
    """Bytes behind which their checksum is written, low byte first."""
    size = {"B": 1, "H": 2, "L": 4, "I": 4, "Q": 8}[letter]
    digits = F.lpad(F.hex(crc(data, letter)), 2 * size, F.lit("0"))
    return F.concat(data, F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])))


def crc_checked(data: Column, letter: str = "B") -> Column:
    """Bytes without the checksum behind them; null if it is wrong or there is no room for one."""
    size = {"B": 1, "H": 2, "L": 4, "I": 4, "Q": 8}[letter]
    body = F.substring(data, F.lit(1), F.octet_length(data) - size)
    return F.when((F.octet_length(data) >= size) & (crc_bytes(body, letter) == data), body)


def _words(numbers: Column, size: int) -> Column:
    """An array cut into parts of `size`, the last of which may be shorter."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(numbers) / size).cast("int") - 1), lambda i: F.slice(numbers, i * size + 1, F.lit(size)))


def rs_encoded(data: Column) -> Column:
    """Bytes in words of up to 253, each behind which two bytes of parity stand.  No bytes stay none."""
    one, two = (_table(_mul(b, g) for b in range(256)) for g in _generator(PARITY)[1:])
    rest = lambda a, b: F.struct(a.alias("a"), b.alias("b"))

    def step(r, b):
        lead = b.bitwiseXOR(r["a"])
        return rest(r["b"].bitwiseXOR(F.get(one, lead)), F.get(two, lead))

    def coded(word):
        return once(F.aggregate(word, rest(F.lit(0), F.lit(0)), step), lambda r: F.concat(word, F.array(r["a"], r["b"])))

    words = F.flatten(F.transform(_words(bytes_of(data), WORD - PARITY), coded))
    return F.when(F.octet_length(data) > 0, binary_of(words)).otherwise(data)


def rs_repaired(data: Column) -> Column:
    """The bytes of such words, one wrong byte of each set right; null if a word has more, or is too short to be one.

    With two syndromes, e of all bytes and e alpha^i, a single error e stands i places before the end.
    """
    log, exp, twice = _table(LOG), _table(EXP[:WORD]), _table(_mul(b, EXP[1]) for b in range(256))
    sums = lambda a, b: F.struct(a.alias("a"), b.alias("b"))

    def mended(word):
        def fix(s):
            place = F.pmod(F.get(log, s["b"]) - F.get(log, s["a"]), F.lit(WORD))
            inside = (s["a"] != 0) & (s["b"] != 0) & (place < F.size(word))
            right = F.transform(word, lambda b, i: F.when(i == F.size(word) - 1 - place, b.bitwiseXOR(s["a"])).otherwise(b))
            body = F.when((s["a"] == 0) & (s["b"] == 0), word).when(inside, right)
            return F.slice(body, F.lit(1), F.size(word) - PARITY)

        total = F.aggregate(word, sums(F.lit(0), F.lit(0)), lambda s, b: sums(s["a"].bitwiseXOR(b), F.get(twice, s["b"]).bitwiseXOR(b)))
        return F.when(F.size(word) > PARITY, once(total, fix))

    words = F.transform(_words(bytes_of(data), WORD), mended)
    whole = once(words, lambda w: F.when(~F.exists(w, lambda x: x.isNull()), binary_of(F.flatten(w))))
    return F.when(F.octet_length(data) > 0, whole).otherwise(data)


def _four(a: int, b: int) -> int:
    """A product in GF(4), where 2 is a root of x^2 + x + 1."""
    return 0 if not a or not b else (a + b - 2) % 3 + 1


#: Words of three bases: a base, and two of parity with the roots 1 and 2.
WORDS = {BASES[m]: "".join(BASES[x] for x in (m, _four(m, 3), _four(m, 2))) for m in range(4)}


def _nearest(word: str) -> str | None:
    """The base whose word differs in one place at most."""
    return next((b for b, w in WORDS.items() if sum(x != y for x, y in zip(w, word)) <= 1), None)


_CODED = np.arange(256, dtype=np.uint8)[:, None].repeat(3, 1)
for _base, _word in WORDS.items():
    _CODED[ord(_base)] = list(_word.encode())
#: What each three bases are, as six bits; zero where they are near no word.
_REPAIRED = np.array([ord(_nearest("".join(w)) or "\0") for w in product(BASES, repeat=3)], np.uint8)


@F.arrow_udf(StringType())
def _encoded(strands: pa.Array) -> pa.Array:
    held, ends, valid = S._held(strands)
    size = np.where(np.isin(held, list(BASES.encode())), 3, 1)  # other letters stay as they are
    plain = size.min(initial=3) == 3
    data = _CODED[held].reshape(-1) if plain else _CODED[held][np.arange(3) < size[:, None]]
    total = np.concatenate([[0], np.cumsum(size)])
    return S._built(pa.string(), data, total[ends[1:]] - total[ends[:-1]], valid)


@F.arrow_udf(StringType())
def _repaired(strands: pa.Array) -> pa.Array:
    held, ends, valid = S._held(strands)
    n, code = np.diff(ends), S._CODE[held]
    odd = np.concatenate([[0], np.cumsum(code > 3)])
    good = valid & (n % 3 == 0) & (odd[ends[1:]] == odd[ends[:-1]])
    if not good.all():
        code, n = code[np.repeat(good, n)], np.where(good, n, 0)
    three = code.reshape(-1, 3)
    found = _REPAIRED[three[:, 0] << 4 | three[:, 1] << 2 | three[:, 2]]
    ends = np.concatenate([[0], np.cumsum(n // 3)])
    lost = np.concatenate([[0], np.cumsum(found == 0)])
    kept = good & (lost[ends[1:]] == lost[ends[:-1]])
    return S._built(pa.string(), found if kept.all() else found[np.repeat(kept, n // 3)], np.where(kept, n // 3, 0), kept)


def strand_encoded(strand: Column) -> Column:
    """Each base of a strand as a word of three over GF(4), by the batch."""
    return _encoded(strand)


def strand_repaired(strand: Column) -> Column:
    """The bases of such words, one wrong base of each set right; null if a word is near none, or the strand isn't whole words of A, C, G and T.

    A word of three bases is six bits: all words of a batch are looked up at once.
    """
    return _repaired(strand)
