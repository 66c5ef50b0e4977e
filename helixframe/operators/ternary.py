"""The rotating ternary codec: bytes to trits by a ternary Huffman code, trits to bases without runs, strands to overlapping oligos."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from helixframe.functions import strand as S
from helixframe.operators.chunks import sliced

BASES = "ACGT"
WINDOW, STRIDE = 100, 25


def huffman_codes(frequencies: dict[int, int]) -> dict[int, str]:
    """Codes in trits: the three rarest nodes are joined until one is left; an even number of symbols gets an empty one more."""
    heap: list[tuple] = [(n, s, (s,)) for s, n in frequencies.items()]
    if len(heap) % 2 == 0:
        heap.append((0, -1, ()))
    codes = dict.fromkeys(frequencies, "")
    if len(heap) == 1:
        return dict.fromkeys(codes, "0")
    heapq.heapify(heap)
    while len(heap) > 1:
        three = [heapq.heappop(heap) for _ in range(3)]
        for trit, (_, _, symbols) in zip("012", three):
            for s in symbols:
                codes[s] = trit + codes[s]
        heapq.heappush(heap, (sum(t[0] for t in three), min(t[1] for t in three), sum((t[2] for t in three), ())))
    return codes


def byte_frequencies(table: DataFrame, data_col: str) -> dict[int, int]:
    """Counts of at most 256 bytes, on the driver; a task sends one row for each byte that it has seen."""

    def count(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.bincount(S._held(batch.column(0))[0], minlength=256)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["b", "n"])

    pairs = table.select(F.col(data_col).cast("binary").alias("data")).mapInArrow(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n"))
    return {r["b"]: r["n"] for r in pairs.collect()}


def to_trits(data: Column, codes: dict[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for s, c in sorted(codes.items()) for x in (f"{s:02X}", c)])
    return F.array_join(F.transform(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1)), lambda b: table[b]), "")


def from_trits(trits: Column, codes: dict[int, str]) -> Column:
    """Hexadecimal digits of what trits stand for; null where they end inside a code."""
    back = {c: f"{s:02x}" for s, c in codes.items()}

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            held, got = "", []
            for c in t or "":
                held += c
                if held in back:
                    got.append(back[held])
                    held = ""
            out.append(None if t is None or held else "".join(got))
        return pd.Series(out, dtype=object)

    return run(trits)


def rotate(trits: Column, start: str | Column = "A") -> Column:
    """Bases of trits: each trit picks one of the three bases that differ from the base before."""
    start = F.lit(start) if isinstance(start, str) else start
    first = F.struct((F.instr(F.lit(BASES), start) - 1).alias("at"), F.lit("").alias("s"))

    def step(acc, t):
        at = F.pmod(acc["at"] + t.cast("int") + 1, F.lit(4)).cast("int")
        return F.struct(at.alias("at"), F.concat(acc["s"], F.substring(F.lit(BASES), at + 1, F.lit(1))).alias("s"))

    return F.aggregate(F.filter(F.split(trits, ""), lambda c: c != ""), first, step)["s"]


def unrotate(strand: Column, start: str | Column = "A") -> Column:
    """Trits of bases, each from the base and the one before; null where a base comes twice in a row or is none."""
    start = F.lit(start) if isinstance(start, str) else start
    letters = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    before, after = letters(F.concat(start, F.left(strand, F.length(strand) - 1))), letters(strand)
    step = lambda x, y: F.pmod(F.instr(F.lit(BASES), y) - F.instr(F.lit(BASES), x) - 1, F.lit(4)).cast("string")
    trits = F.when(F.length(strand) > 0, F.array_join(F.zip_with(before, after, step), "")).otherwise(F.lit(""))
    legal = ~F.concat(start, strand).rlike("AA|CC|GG|TT|[^ACGT]")
    return F.when(legal, trits)


def _code_trits(codes: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
    """(byte, place) and (byte): the trits of each code plus one, and how many it has; -1 of a byte without a code."""
    trits, n = np.zeros((256, max(map(len, codes.values()), default=0)), np.uint8), np.full(256, -1)
    for s, c in codes.items():
        trits[s, : len(c)], n[s] = [int(x) + 1 for x in c], len(c)
    return trits, n


def coded_strands(held: np.ndarray, lengths: np.ndarray, codes: dict[int, str], start: str = "A") -> pa.Array:
    """rotate() of to_trits() of many slices of bytes, laid end to end; null where a byte has no code."""
    trits, size = _code_trits(codes)
    ends, n = np.concatenate([[0], np.cumsum(lengths)]), size[held]
    total, odd = np.concatenate([[0], np.cumsum(np.maximum(n, 0))]), np.concatenate([[0], np.cumsum(n < 0)])
    flat = trits[held]
    steps = np.cumsum(flat[flat > 0], dtype=np.uint8)  # modulo 256, and so modulo 4
    at = total[ends]
    before = np.concatenate([np.zeros(1, np.uint8), steps])[at[:-1]]
    base = (steps - np.repeat(before, np.diff(at)) + np.uint8(BASES.index(start))) & np.uint8(3)
    good = odd[ends[1:]] == odd[ends[:-1]]
    if not good.all():
        base = base[np.repeat(good, np.diff(at))]
    return S._built(pa.string(), _LETTERS[base], np.where(good, np.diff(at), 0), good)


def _code_tree(codes: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
    """For three times a node and a trit: the node behind it, and the byte whose code ends there or -1.  Node 0 is the root, to which whole
    codes lead back; from node 1, which trits of no code lead to, there is no way."""
    nodes = {"": 0, None: 1}
    for c in codes.values():
        for i in range(1, len(c)):
            nodes.setdefault(c[:i], len(nodes))
    after, found = np.ones(3 * len(nodes), np.int32), np.full(3 * len(nodes), -1, np.int16)
    for c in nodes:
        if c:
            after[3 * nodes[c[:-1]] + int(c[-1])] = nodes[c]
    for s, c in codes.items():
        after[3 * nodes[c[:-1]] + int(c[-1])], found[3 * nodes[c[:-1]] + int(c[-1])] = 0, s
    return after, found


def coded_bytes(strands: pa.Array, codes: dict[int, str], start: str = "A") -> pa.Array:
    """from_trits() of unrotate() of a batch, as binaries: all strands go down the code's tree at once, a trit at a time."""
    after, found = _code_tree(codes)
    held, ends, valid = S._held(strands)
    n, code = np.diff(ends), S._CODE[held]
    before = np.concatenate([np.zeros(1, np.uint8), code[:-1]])[: len(code)]
    before[ends[:-1][n > 0]] = BASES.index(start)
    trits = (code - before - np.uint8(1)) & np.uint8(3)
    odd = np.concatenate([[0], np.cumsum((trits > 2) | (code > 3))])
    good = valid & (odd[ends[1:]] == odd[ends[:-1]])
    order = np.argsort(-n, kind="stable")
    order = order[good[order]]
    size = n[order]
    width = int(size.max(initial=0))
    table = np.zeros((len(order), width), np.uint8)
    inside = np.arange(width) < size[:, None]
    table[inside] = trits[(ends[order][:, None] + np.arange(width))[inside]]
    table, many = np.ascontiguousarray(table.T), len(order) - np.searchsorted(size[::-1], np.arange(width), side="right")
    node, got = np.zeros(len(order), np.int32), np.full((width, len(order)), -1, np.int16)
    for i in range(width):
        k = many[i]
        at = node[:k] * 3 + table[i, :k]
        node[:k] = after[at]
        got[i, :k] = found[at]
    rows = np.argsort(order)
    rows = rows[node[rows] == 0]  # those that can be read, in the order of the batch
    got = got.T[rows]
    told = got >= 0
    sizes, good = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
    sizes[order[rows]], good[order[rows]] = told.sum(1), True
    return S._built(pa.binary(), got[told].astype(np.uint8), sizes, good)


#: Bytes whose strands are made at once.
PIECE = 1 << 19


def coded(table: DataFrame, id_col: str, data_col: str, codes: dict[int, str], size: int = 50) -> DataFrame:
    """(id_col, chunk_idx, strand): slices of `size` bytes, each as a strand of its own."""
    return sliced(table, id_col, data_col, size, "strand", "string", lambda held, lengths: coded_strands(held, lengths, codes), PIECE)


def decoded(rows: DataFrame, key: str, codes: dict[int, str]) -> DataFrame:
    """(key, chunk_idx, n, data): the bytes of n slices from chunk_idx on.  Those that follow each other in a batch are one row, so that less is
    moved when a file is put together; strands that can't be read are left out."""

    def read(batches):
        for batch in batches:
            data = coded_bytes(batch.column(2), codes)
            got = batch.filter(data.is_valid())
            data, key_of, idx = data.drop_null(), got.column(0), got.column(1).to_numpy(zero_copy_only=False)
            if not len(data):
                continue
            same = pc.equal(key_of.slice(1), key_of.slice(0, len(got) - 1)).fill_null(False).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], ~(same & (np.diff(idx) == 1))]))
            held, ends, _ = S._held(data)
            n = np.diff(np.append(first, len(data)))
            whole = S._built(pa.binary(), held, ends[first + n] - ends[first], np.ones(len(first), bool))
            yield pa.RecordBatch.from_arrays([key_of.take(pa.array(first)), pa.array(idx[first]), pa.array(n), whole], [key, "chunk_idx", "n", "data"])

    held = rows.select(key, F.col("chunk_idx").cast("long").alias("chunk_idx"), "strand")
    return held.mapInArrow(read, f"`{key}` {held.schema[0].dataType.simpleString()}, chunk_idx long, n long, data binary")


def joined(pieces: DataFrame, key: str) -> DataFrame:
    """(key, data): the pieces of decoded() in order, as one file."""
    whole = pieces.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "data"))).alias("p"))
    return whole.select(key, F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["data"])), "")).alias("data"))


def _ternary(n: Column, width: int) -> Column:
    return F.lpad(F.conv(n.cast("string"), 10, 3), width, "0")


def framed(trits: Column) -> Column:
    """Trits, zeros and their number in 20 trits: a multiple of 25, at least one window long."""
    n = F.length(trits)
    total = F.greatest(F.lit(WINDOW), (F.ceil((n + 20) / STRIDE) * STRIDE).cast("int"))
    return F.concat(F.rpad(trits, (total - 20).cast("int"), "0"), _ternary(n, 20))


def unframed(trits: Column) -> Column:
    return F.left(trits, F.conv(F.right(trits, F.lit(20)), 3, 10).cast("int"))


_TURN = str.maketrans("ACGT", "TGCA")
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[list(b"ACGT")] = list(b"TGCA")
_LETTERS = np.frombuffer(BASES.encode(), np.uint8)


def _index_trits(idx: int, file_trits: str) -> str:
    digits = "".join(str(idx // 3**i % 3) for i in reversed(range(12)))
    return file_trits + digits + str((int(file_trits[1]) + sum(int(digits[i]) for i in (1, 3, 5, 7, 9, 11))) % 3)


def make_oligo(piece: str, idx: int, file_trits: str = "00") -> str:
    """100 bases, turned if idx is odd, 15 index trits, and a base at either end that tells the direction.

    Where two bases would do for an end, the first in order is taken.
    """
    body = piece[::-1].translate(_TURN) if idx % 2 else piece
    for trit in _index_trits(idx, file_trits):
        body += BASES[(BASES.index(body[-1]) + int(trit) + 1) % 4]
    return ("T" if body[0] == "A" else "A") + body + ("G" if body[-1] == "C" else "C")


def parse_oligo(oligo: str | None) -> tuple[int | None, str | None]:
    """(idx, piece) of an oligo in either direction; nulls if its length, ends, trits or parity are wrong."""
    if not oligo or len(oligo) != WINDOW + 17 or set(oligo) - set(BASES):
        return None, None
    o = oligo if oligo[0] in "AT" and oligo[-1] in "CG" else oligo[::-1].translate(_TURN)
    tail = o[WINDOW : WINDOW + 16]
    trits = [(BASES.index(y) - BASES.index(x) - 1) % 4 for x, y in zip(tail, tail[1:])]
    idx = sum(t * 3**i for i, t in enumerate(reversed(trits[2:14])))
    if 3 in trits or "".join(map(str, trits)) != _index_trits(idx, f"{trits[0]}{trits[1]}"):
        return None, None
    piece = o[1 : WINDOW + 1]
    return idx, piece[::-1].translate(_TURN) if idx % 2 else piece


def _index_digits(idx: np.ndarray) -> np.ndarray:
    """The twelve trits of each index, high ones first; the low twelve where it has more."""
    return (idx[:, None] // 3 ** np.arange(11, -1, -1) % 3).astype(np.uint8)


def _parity(first: np.ndarray | int, digits: np.ndarray) -> np.ndarray:
    """The trit behind an index: the second trit of the file and every other one of the index."""
    return (first + digits[:, 1::2].sum(1)) % 3


def make_oligos(pieces: pa.Array, idx: np.ndarray, file_trits: str = "00") -> pa.Array:
    """make_oligo() of a batch: pieces of WINDOW bases at once, others one by one."""
    held, ends, valid = S._held(pieces)
    n, code = np.diff(ends), S._CODE[held]
    odd = np.concatenate([[0], np.cumsum(code > 3)])
    plain = valid & (n == WINDOW) & (odd[ends[1:]] == odd[ends[:-1]])
    body = (code if plain.all() else code[np.repeat(plain, n)]).reshape(-1, WINDOW)
    at = idx[plain]
    body = np.where((at % 2 == 1)[:, None], 3 - body[:, ::-1], body)
    digits = _index_digits(at)
    f = np.tile(np.array([int(t) for t in file_trits], np.uint8), (len(at), 1))
    trits = np.hstack([f, digits, _parity(f[:, 1].astype(np.int64), digits)[:, None].astype(np.uint8)])
    tail = (body[:, -1:] + np.cumsum(trits + 1, axis=1, dtype=np.int64)) % 4
    made = np.hstack([np.where(body[:, :1] == 0, 3, 0), body, tail, np.where(tail[:, -1:] == 1, 2, 1)]).astype(np.uint8)
    out = S._built(pa.string(), _LETTERS[made].reshape(-1), np.full(len(made), made.shape[1]), np.ones(len(made), bool))
    if plain.all():
        return out
    whole = np.full(len(pieces), None, object)
    whole[plain] = out.to_pylist()
    for i in np.flatnonzero(~plain):
        whole[i] = make_oligo(pieces[i].as_py(), int(idx[i]), file_trits)
    return pa.array(whole.tolist(), pa.string())


def parse_oligos(oligos: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """parse_oligo() of a batch: which could be read, and their indexes and pieces."""
    held, ends, valid = S._held(oligos)
    n, code, long = np.diff(ends), S._CODE[held], WINDOW + 17
    odd = np.concatenate([[0], np.cumsum(code > 3)])
    at = np.flatnonzero(valid & (n == long) & (odd[ends[1:]] == odd[ends[:-1]]))
    o = code[ends[at][:, None] + np.arange(long)] if len(at) < len(n) else code.reshape(-1, long)
    right = ((o[:, :1] == 0) | (o[:, :1] == 3)) & ((o[:, -1:] == 1) | (o[:, -1:] == 2))
    o = np.where(right, o, 3 - o[:, ::-1])
    tail = o[:, WINDOW : WINDOW + 16]
    trits = (tail[:, 1:] - tail[:, :-1] + 3) % 4
    good = (trits < 3).all(1) & (_parity(trits[:, 1].astype(np.int64), trits[:, 2:14]) == trits[:, 14])
    o, trits = o[good], trits[good]
    idx = np.zeros(len(trits), np.int64)
    for j in range(2, 14):
        idx = idx * 3 + trits[:, j]
    piece = o[:, 1 : WINDOW + 1]
    piece = np.where((idx % 2 == 1)[:, None], 3 - piece[:, ::-1], piece)
    return at[good], idx, S._built(pa.string(), _LETTERS[piece].reshape(-1), np.full(len(piece), WINDOW), np.ones(len(piece), bool))


#: Rows whose oligos are made or read at once.
TOGETHER = 1 << 14


def _kinds(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def _windows(strands: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(strand, idx, piece): the windows of a batch of strands, none of null or shorter ones."""
    held, ends, valid = S._held(strands)
    if len(held) and held.max() > 127:
        texts = strands.to_pylist()
        cut = [(i, j, t[j * STRIDE : j * STRIDE + WINDOW]) for i, t in enumerate(texts) if t is not None for j in range((len(t) - WINDOW) // STRIDE + 1)]
        return np.array([i for i, *_ in cut], np.int64), np.array([j for _, j, _ in cut], np.int64), pa.array([p for *_, p in cut], pa.string())
    n = np.where(valid, np.maximum((np.diff(ends) - WINDOW) // STRIDE + 1, 0), 0)
    row = np.repeat(np.arange(len(n)), n)
    idx = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    piece = held[(ends[row] + idx * STRIDE)[:, None] + np.arange(WINDOW)] if len(row) else np.zeros((0, WINDOW), np.uint8)
    return row, idx, S._built(pa.string(), piece.reshape(-1), np.full(len(row), WINDOW), np.ones(len(row), bool))


#: Strands whose oligos are made at once.
TOGETHER = 1 << 12


def oligos(rows: DataFrame, key: str, strand: str = "strand", file_trits: str = "00") -> DataFrame:
    """(key, idx, oligo): windows of 100 bases at every 25th."""
    whole = rows.select(key, strand)

    def make(batches):
        for batch in batches:
            for i in range(0, len(batch), TOGETHER):
                some = batch.slice(i, TOGETHER)
                row, idx, piece = _windows(some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row)), pa.array(idx), make_oligos(piece, idx, file_trits)], [key, "idx", "oligo"])

    return whole.mapInArrow(make, f"`{key}` {whole.schema[0].dataType.simpleString()}, idx long, oligo string")


def turned(oligos: pa.Array, turn: np.ndarray) -> pa.Array:
    """The reverse complement of ASCII strands where `turn` holds."""
    held, ends, valid = S._held(oligos)
    n = np.diff(ends)
    row = np.repeat(np.arange(len(n)), n)
    back, at = turn[row], np.arange(len(held))
    out = held[np.where(back, (ends[:-1] + ends[1:] - 1)[row] - at, at)]
    return S._built(pa.string(), np.where(back, _COMPLEMENT[out], out), n, valid)


def read_oligos(rows: DataFrame, oligo: str = "oligo", turn: Column | None = None) -> DataFrame:
    """(idx, piece) of oligos, first turned where `turn` is true; those that can't be read are left out.  Other columns stay."""
    others = [c for c in rows.columns if c not in (oligo, "idx", "piece")]
    held = rows.select(*others, F.col(oligo).alias("_o"), *([] if turn is None else [F.coalesce(turn, F.lit(False)).alias("_t")]))

    turns = turn is not None

    def read(batches):
        for batch in batches:
            found = batch.column(len(others))
            if turns:
                found = turned(found, batch.column(len(others) + 1).to_numpy(zero_copy_only=False))
            at, idx, piece = parse_oligos(found)
            keys = pa.array(at)
            yield pa.RecordBatch.from_arrays([*[batch.column(j).take(keys) for j in range(len(others))], pa.array(idx), piece], [*others, "idx", "piece"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in held.schema[: len(others)])
    return held.mapInArrow(read, f"{kinds}idx long, piece string")


def _votes(windows: list[list[dict]]) -> list[str]:
    """The strands of many lists of windows (idx, piece, w): the heaviest letter of each place, the smaller one of equals, `_` where there is none."""
    flat = [x for some in windows for x in some]
    n = np.array([len(x["piece"]) for x in flat], np.int64)
    at = np.array([x["idx"] for x in flat], np.int64) * STRIDE
    row = np.repeat(np.arange(len(windows)), [len(some) for some in windows])
    size = np.zeros(len(windows), np.int64)
    np.maximum.at(size, row, at + n)
    ends = np.cumsum(size)
    letters, code = np.unique(np.frombuffer("".join(x["piece"] for x in flat).encode("utf-32-le"), np.uint32), return_inverse=True)
    place = np.repeat((ends - size)[row] + at - (np.cumsum(n) - n), n) + np.arange(n.sum())
    weight = np.bincount(place * len(letters) + code, np.repeat(np.array([x["w"] for x in flat], float), n), int(size.sum()) * len(letters)).reshape(-1, len(letters))
    best = np.where(weight.any(1), letters[weight.argmax(1)], ord("_")).astype(np.uint32)
    whole = best.tobytes().decode("utf-32-le")
    return [whole[e - k : e] for e, k in zip(ends.tolist(), size.tolist())]


def _windows_joined(batch: pa.RecordBatch) -> list[pa.Array]:
    """(key, idx, n, data) of windows (key, idx, piece): those of one key that follow each other in a batch, each WINDOW bases long and the same where
    they overlap, are one row of n windows and the bases that they cover, four in a byte.  Any other is a row of its own, n 0 and its text."""
    key, piece = batch.column(0), batch.column(2)
    idx = batch.column(1).to_numpy(zero_copy_only=False)
    held, ends, _ = S._held(piece)
    n, code = np.diff(ends), S._CODE[held]
    odd = np.concatenate([[0], np.cumsum(code > 3)])
    plain = (n == WINDOW) & (odd[ends[1:]] == odd[ends[:-1]])
    at = np.flatnonzero(plain)
    bases = code[ends[at][:, None] + np.arange(WINDOW)] if len(at) < len(n) else code.reshape(-1, WINDOW)
    key, row = key.take(pa.array(at)), idx[at]
    same = pc.equal(key.slice(1), key.slice(0, max(len(key) - 1, 0))).fill_null(False).to_numpy(zero_copy_only=False)
    follows = same & (np.diff(row) == 1) & (bases[:-1, STRIDE:] == bases[1:, :-STRIDE]).all(1) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate([[True], ~follows])[: len(at)])
    count = np.diff(np.append(first, len(at)))
    sizes = -(-(WINDOW + STRIDE * (count - 1)) // 4)
    held_out, starts = np.zeros(sizes.sum() * 4, np.uint8), (np.cumsum(sizes) - sizes) * 4
    held_out[starts[:, None] + np.arange(WINDOW)] = bases[first]
    rest = np.flatnonzero(np.concatenate([[False], follows])[: len(at)])
    run = np.searchsorted(first, rest, side="right") - 1
    held_out[(starts[run] + WINDOW + STRIDE * (rest - first[run] - 1))[:, None] + np.arange(STRIDE)] = bases[rest, -STRIDE:]
    four = held_out.reshape(-1, 4)
    data = S._built(pa.binary(), four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3], sizes, np.ones(len(first), bool))
    out = [key.take(pa.array(first)), pa.array(row[first]), pa.array(count.astype(np.int32)), data]
    if len(at) < len(n):
        others = pa.array(np.flatnonzero(~plain))
        rest = [batch.column(0).take(others), pa.array(idx[~plain]), pa.array(np.zeros(len(others), np.int32)), piece.take(others).cast(pa.binary())]
        out = [pa.concat_arrays([a, b]) for a, b in zip(out, rest)]
    return out


def _windows_of(idx: int, n: int, data: bytes, w: int) -> list[dict]:
    """The windows of a row of _windows_joined() that came w times."""
    if not n:
        return [{"idx": idx, "piece": data.decode(), "w": w}]
    text = S.FOURS[np.frombuffer(data, np.uint8)].tobytes().decode()
    return [{"idx": idx + j, "piece": text[j * STRIDE : j * STRIDE + WINDOW], "w": w} for j in range(n)]


def _overlaid(lists: pa.Array) -> pa.Array:
    """The strands of lists of (idx, n, data, w): a single row from place 0 on is its bases; others are voted on."""
    counts, flat = lists.value_lengths().to_numpy(), lists.flatten()
    ends = np.cumsum(counts)
    idx, n, w = (flat.field(c).to_numpy() for c in ("idx", "n", "w"))
    alone = np.flatnonzero(counts == 1)
    alone = alone[(idx[ends[alone] - 1] == 0) & (n[ends[alone] - 1] > 0)]
    at = ends[alone] - 1
    held, cuts, _ = S._held(flat.field("data").take(pa.array(at)))
    letters, sizes = S.FOURS[held].view(np.uint8), WINDOW + STRIDE * (n[at].astype(np.int64) - 1)
    inside = np.arange(sizes.sum()) + np.repeat(cuts[:-1] * 4 - (np.cumsum(sizes) - sizes), sizes)
    one = S._built(pa.string(), letters[inside], sizes, np.ones(len(at), bool))
    if len(alone) == len(lists):
        return one
    others = np.setdiff1d(np.arange(len(lists)), alone)
    voted = []
    for some in (others[i : i + 1024] for i in range(0, len(others), 1024)):
        rows = [range(ends[i] - counts[i], ends[i]) for i in some]
        data = {j: flat.field("data")[j].as_py() for r in rows for j in r}
        voted += _votes([[x for j in r for x in _windows_of(int(idx[j]), int(n[j]), data[j], int(w[j]))] for r in rows])
    order = np.argsort(np.concatenate([alone, others]))
    return pa.concat_arrays([one, pa.array(voted, pa.string())]).take(pa.array(order))


def _overlay(rows: DataFrame, key: str, read) -> DataFrame:
    """overlay() of what `read` makes of each batch of rows (key, ...): a batch of windows (key, idx, piece)."""
    kind = rows.schema[0].dataType.simpleString()

    def join(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_windows_joined(read(batch)), [key, "idx", "n", "data"])

    def vote(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _overlaid(batch.column(1))], [key, "strand"])

    k = F.col(f"`{key}`")
    same = rows.mapInArrow(join, f"`{key}` {kind}, idx long, n int, data binary").repartition(k).groupBy(k, "idx", "n", "data").agg(F.count("*").alias("w"))
    found = same.groupBy(k).agg(F.collect_list(F.struct("idx", "n", "data", "w")).alias("p"))
    return found.mapInArrow(vote, f"`{key}` {kind}, strand string")


def overlay(pieces: DataFrame, key: str) -> DataFrame:
    """(key, strand): the most frequent base of each place over all windows and copies; `_` where nothing covers a place.

    Neighbouring windows of a batch that agree move as one row, which holds each base once; rows that come again are counted before a strand's are
    gathered, where they are.
    """
    return _overlay(pieces.where("piece != ''").select(key, F.col("idx").cast("long").alias("idx"), "piece"), key, lambda batch: batch)


def overlay_oligos(rows: DataFrame, key: str, oligo: str = "oligo") -> DataFrame:
    """overlay() of read_oligos(), whose windows are joined where they are read."""

    def read(batch):
        at, idx, piece = parse_oligos(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(idx), piece], [key, "idx", "piece"])

    return _overlay(rows.select(key, oligo), key, read)
