"""Error correction of byte strings: checksums of four widths and Reed-Solomon codes over GF(256)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.strand import FOURS, _built, _held, bytes_of_strands, strands_of
from helixframe.operators.chunks import sliced

# Polynomials of CRC-8/LTE, CRC-16/XMODEM and CRC-64/ECMA by struct letter, with their widths.
POLYNOMIALS = {"B": (0x9B, 8), "H": (0x1021, 16), "Q": (0x42F0E1EBA9EA3693, 64)}
# Fixed value: the field polynomial of the Reed-Solomon code.
FIELD = 0x11D


@lru_cache
def _crc_table(letter: str) -> list[int]:
    poly, width = POLYNOMIALS[letter]
    top, table = 1 << width - 1, []
    for i in range(256):
        c = i << width - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & (1 << width) - 1
        table.append(c)
    return table


def crc(data: bytes, letter: str = "B") -> int:
    """CRC by struct letter: B 8, H 16, L or I 32, Q 64 bits."""
    if letter in "LI":
        return zlib.crc32(data)
    table, width = _crc_table(letter), POLYNOMIALS[letter][1]
    c = 0
    for b in data:
        c = (c << 8 & (1 << width) - 1) ^ table[c >> width - 8 ^ b]
    return c


def crc_encode(data: bytes, letter: str = "B") -> bytes:
    return data + struct.pack("<" + letter, crc(data, letter))


def crc_decode(data: bytes, letter: str = "B") -> bytes | None:
    """The bytes without their checksum; None if it is wrong."""
    n = struct.calcsize("<" + letter)
    body = data[:-n]
    return body if len(data) >= n and crc_encode(body, letter) == data else None


EXP, LOG = [0] * 512, [0] * 256
_x = 1
for _i in range(255):
    EXP[_i] = EXP[_i + 255] = _x
    LOG[_x] = _i
    _x = _x << 1 ^ (FIELD if _x & 128 else 0)


def _mul(a: int, b: int) -> int:
    return EXP[LOG[a] + LOG[b]] if a and b else 0


def _div(a: int, b: int) -> int:
    return EXP[LOG[a] + 255 - LOG[b]] if a else 0


def _value(poly: list[int], x: int) -> int:
    """A polynomial, lowest coefficient first, at x."""
    y = 0
    for c in reversed(poly):
        y = _mul(y, x) ^ c
    return y


def _product(p: list[int], q: list[int]) -> list[int]:
    out = [0] * (len(p) + len(q) - 1)
    for i, a in enumerate(p):
        for j, b in enumerate(q):
            out[i + j] ^= _mul(a, b)
    return out


@lru_cache
def _generator(parity: int) -> list[int]:
    g = [1]
    for i in range(parity):
        g = _product(g, [EXP[i], 1])
    return g[::-1]


def rs_encode(data: bytes, parity: int = 2) -> bytes:
    """Systematic code words of up to 255 bytes, one behind the other."""
    out, gen = bytearray(), _generator(parity)
    for at in range(0, len(data), 255 - parity):
        block = data[at : at + 255 - parity]
        rest = [0] * parity
        for b in block:
            lead = b ^ rest[0]
            rest = [r ^ _mul(lead, g) for r, g in zip([*rest[1:], 0], gen[1:])]
        out += block + bytes(rest)
    return bytes(out)


def _fix(word: bytes, parity: int) -> bytes | None:
    syndromes = [_value(list(word[::-1]), EXP[i]) for i in range(parity)]
    if not any(syndromes):
        return word[:-parity]
    locator, old, length, gap, last = [1], [1], 0, 1, 1  # Berlekamp and Massey
    for n in range(parity):
        delta = syndromes[n]
        for i in range(1, min(length, len(locator) - 1) + 1):
            delta ^= _mul(locator[i], syndromes[n - i])
        if not delta:
            gap += 1
            continue
        scaled = [0] * gap + [_mul(_div(delta, last), c) for c in old]
        size = max(len(scaled), len(locator))
        new = [a ^ b for a, b in zip(locator + [0] * (size - len(locator)), scaled + [0] * (size - len(scaled)))]
        if 2 * length <= n:
            old, length, last, gap = locator, n + 1 - length, delta, 1
        else:
            gap += 1
        locator = new
    places = [i for i in range(len(word)) if _value(locator, EXP[(255 - i) % 255]) == 0]
    if len(places) != length or 2 * length > parity:
        return None
    omega = _product(syndromes, locator)[:parity]
    fixed = bytearray(word)
    for i in places:  # Forney, first consecutive root 1
        inverse = EXP[(255 - i) % 255]
        slope = 0
        for j in range(1, len(locator), 2):
            slope ^= _mul(locator[j], EXP[LOG[inverse] * (j - 1) % 255])
        if not slope:
            return None
        fixed[len(word) - 1 - i] ^= _mul(EXP[i], _div(_value(omega, inverse), slope))
    if any(_value(list(fixed[::-1]), EXP[i]) for i in range(parity)):
        return None
    return bytes(fixed[:-parity])


def rs_decode(data: bytes, parity: int = 2) -> bytes | None:
    """The data bytes with up to parity // 2 wrong bytes a word repaired; None if there are more."""
    out = bytearray()
    for at in range(0, len(data), 255):
        word = data[at : at + 255]
        body = _fix(word, parity) if len(word) > parity else None
        if body is None:
            return None
        out += body
    return bytes(out)


_TIMES = np.array([[_mul(a, b) for b in range(256)] for a in range(256)], np.uint8)


_INVERSE = np.array([0] + [EXP[(255 - LOG[x]) % 255] for x in range(1, 256)], np.uint8)
_POWERS, _LOGS = np.array(EXP[:255], np.uint8), np.array(LOG)


def _by_length(rows: list[bytes | None], least: int, most: int) -> tuple[list[tuple[list[int], np.ndarray]], list[int]]:
    """Rows of one code word each as matrices, one for each length, with their places; and the places of the others."""
    places: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        n = -1 if r is None else len(r)
        places.setdefault(n if least <= n <= most else -1, []).append(i)
    other = places.pop(-1, [])
    return [(at, np.frombuffer(b"".join([rows[i] for i in at]), np.uint8).reshape(len(at), n)) for n, at in places.items()], other


@lru_cache
def _feedback(parity: int) -> np.ndarray:
    """What each byte that leaves the register adds to it."""
    return _TIMES[:, np.array(_generator(parity)[1:])]


def _parities(m: np.ndarray, parity: int) -> np.ndarray:
    """The parity bytes of rows of data, a byte of all of them at a time."""
    rest, table = np.zeros((len(m), parity), np.uint8), _feedback(parity)
    for j in range(m.shape[1]):
        lead = m[:, j] ^ rest[:, 0]
        rest[:, :-1], rest[:, -1] = rest[:, 1:].copy(), 0
        rest ^= table[lead]
    return rest


def rs_encode_all(rows: list[bytes], parity: int = 2) -> list[bytes]:
    """rs_encode of many rows, a byte of all those of one length at a time."""
    alike, other = _by_length(rows, 1, 255 - parity)
    out = [b""] * len(rows)
    for at, m in alike:
        for i, p in zip(at, _parities(m, parity)):
            out[i] = rows[i] + p.tobytes()
    for i in other:
        out[i] = rs_encode(rows[i], parity)
    return out


def _syndromes(m: np.ndarray, parity: int) -> np.ndarray:
    out = np.zeros((parity, len(m)), np.uint8)
    for i in range(parity):
        for j in range(m.shape[1]):
            out[i] = _TIMES[out[i], EXP[i]] ^ m[:, j]
    return out


def _few_fixed(m: np.ndarray, syndromes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with one wrong byte, or two where there are four syndromes, set right by the closed forms; and which ones are words now."""
    n, parity = m.shape[1], len(syndromes)
    s, t = syndromes, lambda a, b: _TIMES[a, b]
    x, first = _POWERS[:n], t(s[1], _INVERSE[s[0]])
    place = np.zeros((len(m), 2), np.int64)
    error = np.zeros((len(m), 2), np.uint8)
    place[:, 0], error[:, 0] = np.minimum(_LOGS[first], n - 1), s[0]
    if parity >= 4:
        det = t(s[1], s[1]) ^ t(s[0], s[2])
        two = np.flatnonzero(det)
        d, (a, b, c, e) = _INVERSE[det[two]], s[:4, two]
        one, none = t(t(b, c) ^ t(a, e), d), t(t(b, e) ^ t(c, c), d)
        zero = (t(x, x)[None, :] ^ t(one[:, None], x[None, :]) ^ none[:, None]) == 0
        good = zero.sum(1) == 2
        two, at = two[good], np.nonzero(zero[good])[1].reshape(-1, 2)
        p, q, a, b = x[at[:, 0]], x[at[:, 1]], a[good], b[good]
        e1 = t(b ^ t(q, a), _INVERSE[p ^ q])
        place[two], error[two] = at, np.stack([e1, a ^ e1], 1)
    fixed = m.copy()
    for i in range(2):
        fixed[np.arange(len(m)), n - 1 - place[:, i]] ^= error[:, i]
    return fixed, ~_syndromes(fixed, parity).any(0)


def _many_fixed(m: np.ndarray, syndromes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with up to parity // 2 wrong bytes set right by the method of _fix(), all at once; and which ones are words now."""
    parity, (rows, n) = len(syndromes), m.shape
    width, t = parity + 1, lambda a, b: _TIMES[a, b]
    locator, old = np.zeros((width, rows), np.uint8), np.zeros((width, rows), np.uint8)  # by coefficient; old: moved up by one each turn
    locator[0] = old[0] = 1
    length, last = np.zeros(rows, np.int64), np.ones(rows, np.uint8)
    for i in range(parity):
        old[1:], old[0] = old[:-1].copy(), 0
        delta = syndromes[i].copy()
        for j in range(1, min(i, width - 1) + 1):  # coefficients over `length` are zero
            delta ^= t(locator[j], syndromes[i - j])
        new = locator ^ t(t(delta, _INVERSE[last])[None, :], old)
        grows = (delta > 0) & (2 * length <= i)
        old = np.where(grows, locator, old)
        last, length = np.where(grows, delta, last), np.where(grows, i + 1 - length, length)
        locator = new
    at = (255 - np.arange(n)) % 255  # logarithms of the inverses of the places
    value, slope, places = np.zeros((rows, n), np.uint8), np.zeros((rows, n), np.uint8), _POWERS[at]
    for c in locator[::-1]:
        value = t(value, places[None, :]) ^ c[:, None]
    wrong = value == 0
    good = (wrong.sum(1) == length) & (2 * length <= parity)
    row, place = np.nonzero(wrong & good[:, None])
    omega = np.zeros((parity, rows), np.uint8)
    for i in range(parity):
        for j in range(i + 1):
            omega[i] ^= t(syndromes[j], locator[i - j])
    x, top, slope = places[place], np.zeros(len(row), np.uint8), np.zeros(len(row), np.uint8)
    for c in omega[::-1]:
        top = t(top, x) ^ c[row]
    for j in range(1, width, 2):
        slope ^= t(locator[j][row], _POWERS[at[place] * (j - 1) % 255])
    fixed = m.copy()
    fixed[row, n - 1 - place] ^= t(_POWERS[place % 255], t(top, _INVERSE[slope]))
    return fixed, good & ~_syndromes(fixed, parity).any(0)


def _words_fixed(m: np.ndarray, parity: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one word each, set right as by rs_decode(), with their parity; and which ones are words now."""
    good = (_parities(m[:, :-parity], parity) == m[:, -parity:]).all(1)
    wrong = np.flatnonzero(~good)
    if not len(wrong) or parity < 2:
        return m, good
    out, s = m.copy(), _syndromes(m[wrong], parity)
    fixed, fits = _few_fixed(m[wrong], s)
    rest = np.flatnonzero(~fits)
    if len(rest):
        fixed[rest], fits[rest] = _many_fixed(m[wrong[rest]], s[:, rest])
    out[wrong], good[wrong] = fixed, fits
    return out, good


def rs_decode_all(rows: list[bytes | None], parity: int = 2) -> list[bytes | None]:
    """rs_decode of many rows: those of one length at once, and one by one only those of more or less than a word."""
    alike, other = _by_length(rows, parity + 1, 255)
    out: list[bytes | None] = [None] * len(rows)
    for at, m in alike:
        fixed, good = _words_fixed(m, parity)
        for i, f, ok in zip(at, fixed, good.tolist()):
            out[i] = f[:-parity].tobytes() if ok else None
    for i in other:
        out[i] = None if rows[i] is None else rs_decode(rows[i], parity)
    return out


def _rs_decoded(words: pa.Array, parity: int) -> pa.Array:
    """rs_decode() of a batch of binaries; null where it can't be repaired."""
    held, ends, valid = _held(words)
    n = np.diff(ends)
    plain, good, sizes = valid & (n > parity) & (n <= 255), np.zeros(len(n), bool), np.zeros(len(n), np.int64)
    if (valid & ~plain).any():
        return pa.array([None if w is None else rs_decode(w, parity) for w in words.to_pylist()], pa.binary())
    parts = []
    for length in np.unique(n[plain]).tolist():
        at = np.flatnonzero(plain & (n == length))
        fixed, ok = _words_fixed(held[ends[at][:, None] + np.arange(length)], parity)
        good[at], sizes[at[ok]] = ok, length - parity
        parts.append((at[ok], fixed[ok, :-parity]))
    out, starts = np.zeros(sizes.sum(), np.uint8), np.cumsum(sizes) - sizes
    for at, rows in parts:
        out[starts[at][:, None] + np.arange(rows.shape[1])] = rows
    return _built(pa.binary(), out, sizes, good)


def encoder(name: str, **options):
    """Functions (encode, decode) over lists of bytes by name: none, crc or rs.  What can't be decoded becomes None."""
    if name == "none":
        return (lambda rows: rows), (lambda rows: rows)
    if name == "crc":
        letter = options.get("letter", "B")
        return (lambda rows: [crc_encode(r, letter) for r in rows]), (lambda rows: [None if r is None else crc_decode(r, letter) for r in rows])
    if name == "rs":
        parity = options.get("parity", 2)
        return (lambda rows: rs_encode_all(rows, parity)), (lambda rows: rs_decode_all(rows, parity))
    raise ValueError(f"no error correction is called {name!r}")


@lru_cache
def checksum_column(letter: str):
    """A column function: the checksum of bytes.  That of 32 bits is built in."""
    if letter in "LI":
        return F.crc32

    @F.pandas_udf("long")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else crc(bytes(d), letter) - (1 << 64 if letter == "Q" and crc(bytes(d), letter) >> 63 else 0) for d in data], dtype="Int64")

    return run


@lru_cache
def protected(name: str, **options):
    """A column function: bytes with an error correction by name."""

    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series(encoder(name, **options)[0]([bytes(d) for d in data]), dtype=object)

    return run


@lru_cache
def restored(name: str, **options):
    """The inverse of protected(); null where bytes can't be repaired."""

    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series(encoder(name, **options)[1]([None if d is None else bytes(d) for d in data]), dtype=object)

    return run


def _parity(size: int, overhead: float) -> int:
    return max(int(size * overhead), 1)


def _numbered_words(held: np.ndarray, lengths: np.ndarray, idx: np.ndarray, parity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes end to end, and sizes: the words of chunks behind their numbers."""
    starts, sizes = np.cumsum(lengths) - lengths, lengths + 4 + parity
    ends = np.cumsum(sizes)
    out, heads = np.zeros(sizes.sum(), np.uint8), idx.astype(">u4").view(np.uint8).reshape(-1, 4)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        plain = np.hstack([heads[at], held[starts[at][:, None] + np.arange(n)]])
        out[(ends - sizes)[at][:, None] + np.arange(n + 4 + parity)] = np.hstack([plain, _parities(plain, parity)])
    return out, sizes


#: Bytes of files that are coded at once.
PIECE = 1 << 19


def _rs_coded(table: DataFrame, id_col: str, data_col: str, size: int, overhead: float, name: str, bases: bool) -> DataFrame:
    parity, kind = _parity(size, overhead), pa.string() if bases else pa.binary()

    def made(held: np.ndarray, lengths: np.ndarray, idx: np.ndarray) -> pa.Array:
        if 4 + size + parity > 255:
            ends = np.cumsum(lengths)
            words = [rs_encode(int(i).to_bytes(4, "big") + held[e - n : e].tobytes(), parity) for i, e, n in zip(idx, ends.tolist(), lengths.tolist())]
            return strands_of(pa.array(words, pa.binary())) if bases else pa.array(words, pa.binary())
        out, sizes = _numbered_words(held, lengths, idx, parity)
        return _built(kind, FOURS[out] if bases else out, sizes * 4 if bases else sizes, np.ones(len(sizes), bool))

    return sliced(table, id_col, data_col, size, name, "string" if bases else "binary", made, PIECE, True).select(id_col, name)


def rs_file_chunks(table: DataFrame, id_col: str, data_col: str, size: int, overhead: float) -> DataFrame:
    """(id_col, packed): chunks of files behind their numbers (four bytes), each with floor(size * overhead) bytes of parity."""
    return _rs_coded(table, id_col, data_col, size, overhead, "packed", False)


def rs_file_strands(table: DataFrame, id_col: str, data_col: str, size: int, overhead: float) -> DataFrame:
    """(id_col, strand): rs_file_chunks() as bases."""
    return _rs_coded(table, id_col, data_col, size, overhead, "strand", True)


def _runs_of(key: pa.Array, plain: pa.Array, size: int) -> list[pa.Array] | None:
    """(key, i, n, data) of chunks behind their numbers: those that follow each other in a batch, and are whole but for the last, are one row."""
    some = plain.is_valid().to_numpy(zero_copy_only=False) & (pc.fill_null(pc.binary_length(plain), 0).to_numpy() >= 4)
    if not some.any():
        return None
    key, plain = key.filter(pa.array(some)), plain.filter(pa.array(some))
    held, ends, _ = _held(plain)
    i = held[ends[:-1][:, None] + np.arange(4)].copy().view(">u4").ravel().astype(np.int64)
    n = np.minimum(np.diff(ends) - 4, size)
    same = pc.equal(key.slice(1), key.slice(0, len(key) - 1)).fill_null(False).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], ~(same & (np.diff(i) == 1) & (n[:-1] == size))]))
    count = np.diff(np.append(first, len(i)))
    at = np.arange(n.sum()) + np.repeat(ends[:-1] + 4 - (np.cumsum(n) - n), n)
    total = np.concatenate([[0], np.cumsum(n)])
    return [key.take(pa.array(first)), pa.array(i[first]), pa.array(count), _built(pa.binary(), held[at], total[first + count] - total[first], np.ones(len(first), bool))]


def _file_of(runs: list[tuple[int, int, bytes]], size: int) -> tuple[bytes, int]:
    """A file of runs (i, n, data), zeros where chunks are missing, and how many are; of a chunk that comes more than once the least."""
    runs, out, lost, after = sorted(runs), [], 0, 0
    if any(i < j + n for (j, n, _), (i, _, _) in zip(runs, runs[1:])):
        chunks: dict[int, bytes] = {}
        for i, n, data in runs:
            for j in range(n):
                piece = data[j * size : (j + 1) * size]
                chunks[i + j] = min(piece, chunks.get(i + j, piece))
        runs = [(i, 1, chunks[i]) for i in sorted(chunks)]
    for i, n, data in runs:
        if i - after >= 1 << 31:
            raise ValueError(f"no file has a chunk {i}")
        lost += i - after
        out.append(bytes(size * (i - after)) + data)
        after = i + n
    return b"".join(out), lost


def _rs_joined(rows: DataFrame, id_col: str, size: int, overhead: float, bases: bool) -> DataFrame:
    parity, kind = _parity(size, overhead), rows.schema[0].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = bytes_of_strands(batch.column(1)) if bases else batch.column(1)
            if found := _runs_of(batch.column(0), _rs_decoded(words, parity), size):
                yield pa.RecordBatch.from_arrays(found, [id_col, "i", "n", "data"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, whole = batch.column(1), batch.column(1).flatten()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).tolist()
            i, n, data = (whole.field(c).to_pylist() for c in ("i", "n", "data"))
            for at in range(0, len(batch), 256):
                got = [_file_of([*zip(i[a:b], n[a:b], data[a:b])], size) for a, b in zip(ends[at : at + 256], ends[at + 1 : at + 257])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array([d for d, _ in got], pa.binary()), pa.array([x for _, x in got], pa.int32())], [id_col, "data", "n_lost"])

    runs = rows.mapInArrow(read, f"`{id_col}` {kind}, i long, n long, data binary")
    files = runs.repartition(F.col(f"`{id_col}`")).groupBy(F.col(f"`{id_col}`")).agg(F.collect_list(F.struct("i", "n", "data")).alias("p"))
    return files.mapInArrow(join, f"`{id_col}` {kind}, data binary, n_lost int")


def rs_file_data(chunks: DataFrame, id_col: str, size: int, overhead: float) -> DataFrame:
    """(id_col, data, n_lost): files of such chunks, zeros where one can't be repaired or isn't there, but for the last.

    Chunks that follow each other in a batch move as one row.
    """
    return _rs_joined(chunks.select(id_col, "packed"), id_col, size, overhead, False)


def rs_strand_data(strands: DataFrame, id_col: str, size: int, overhead: float) -> DataFrame:
    """rs_file_data() of strands (id_col, strand); one that isn't whole bytes of bases counts as lost."""
    return _rs_joined(strands.select(id_col, "strand"), id_col, size, overhead, True)
