"""Packets in longer sequences: rules and checksums of all windows from running sums, and the leftmost windows that don't overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import bases as B
from helixframe.functions.strand import FOURS, _built, _held
from helixframe.operators.packet_table import SEED_MASK, VALUES

_VALUE = np.zeros(256, np.uint8)
_VALUE[list(b"ACGT")] = (1, 2, 3, 4)
_WEIGHTS = (64, 16, 4, 1)


def good_windows(seq: str, length: int, low: float, high: float, longest: int) -> np.ndarray:
    """Where windows of `length` bases begin whose last four bases are the checksum of the others, and that keep the rules.

    All bases are among ACGT, no run is over `longest`, and the share of G and C is between low and high percent.
    """
    data = np.frombuffer(seq.encode("utf-8", "replace"), np.uint8) if seq.isascii() else np.array([ord(c) if ord(c) < 128 else 0 for c in seq], np.uint8)
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value = _VALUE[data]
    sums = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int32)])
    within = lambda x, size: (total := sums(x))[size : size + n] - total[:n]  # noqa: E731  of each window's first places
    told = sum(((value[i : i + n].astype(np.int16) - 1) * w for i, w in zip(range(length - 4, length), _WEIGHTS)), np.zeros(n, np.int16))
    good = (within(value == 0, length) == 0) & (within(value, length - 4) % 256 == told)
    percent = 100.0 * within((value == 2) | (value == 3), length) / length
    good &= (percent >= low) & (percent <= high)
    if longest + 1 <= length:
        same = np.ones(len(data) - longest, bool)  # a run over the longest begins here
        for i in range(1, longest + 1):
            same &= data[: len(same)] == data[i : i + len(same)]
        good &= within(same, length - longest) == 0
    return np.flatnonzero(good)


def found_packets(sequences: DataFrame, length: int, low: float = 30, high: float = 70, longest: int = 4) -> DataFrame:
    """(id, start, strand, seed): packets of `length` bases in longer sequences (id, seq), from the left, each behind the end of the one before.

    A packet is eight bases of a seed, a payload, and four of a checksum.  A sequence is looked at in one pass, whatever its length; nulls and
    sequences that are too short have no packet.
    """

    def find(batches):
        for batch in batches:
            ids, starts, strands = [], [], []
            for i, seq in enumerate(batch.column("seq").to_pylist()):
                end = 0
                for at in good_windows(seq, length, low, high, longest).tolist() if seq else ():
                    if at >= end:
                        ids.append(i)
                        starts.append(at)
                        strands.append(seq[at : at + length])
                        end = at + length
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ids, pa.int64())), pa.array(starts, pa.int64()), pa.array(strands, pa.string())], ["id", "start", "strand"])

    kind = dict(sequences.dtypes)["id"]
    found = sequences.select("id", "seq").mapInArrow(find, f"id {kind}, start long, strand string")
    return found.withColumn("seed", B.from_base_four(F.left("strand", F.lit(8))).cast("int").bitwiseXOR(F.lit(SEED_MASK)))


#: Bytes whose sequences are made at once.
PIECE = 1 << 19


def _sequences(held: np.ndarray, sizes: np.ndarray, ids: np.ndarray, size: int, spacer: str, step: int, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters end to end, and how many of each: the sequences of rows whose bytes lie end to end."""
    count = -(-sizes // size)
    first = np.cumsum(count) - count
    idx = np.arange(count.sum()) - np.repeat(first, count)
    lengths = np.full(len(idx), size, np.int64)
    lengths[first + count - 1] = sizes - (count - 1) * size
    total = np.concatenate([[0], np.cumsum(VALUES[held])])
    ends = np.cumsum(lengths)
    check = ((total[ends] - total[ends - lengths]) % 256).astype(np.uint8)
    gap = np.minimum(np.maximum(np.fmod(idx * step + np.repeat(ids, count), turns), 0), len(spacer))
    whole = gap + 4 * lengths + 4
    starts = np.cumsum(whole) - whole
    out = np.zeros(whole.sum(), np.uint8)
    within = np.arange(gap.sum()) - np.repeat(np.cumsum(gap) - gap, gap)
    out[np.repeat(starts, gap) + within] = np.frombuffer(spacer.encode(), np.uint8)[within]
    out[np.arange(4 * len(held)) + np.repeat(starts + gap - 4 * (ends - lengths), 4 * lengths)] = FOURS[held].view(np.uint8)
    out[(starts + whole - 4)[:, None] + np.arange(4)] = FOURS[check].view(np.uint8).reshape(-1, 4)
    return out, np.add.reduceat(whole, first)


def spaced_packets(table: DataFrame, id_col: str, data_col: str, size: int, spacer: str, step: int, turns: int) -> DataFrame:
    """(id, seq): the strands of all chunks of each row's bytes, each with its checksum, as one sequence made where the row is.

    Before strand i are the first (i * step + id) % turns letters of the spacer.  Only if ids repeat, which is looked up first, are rows moved: those of
    one id are one sequence, with strands in order of their chunks and then of themselves.  Rows without an id have no sequence.
    """
    key, data = F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{data_col}`").cast("binary").alias("data")
    rows = table.select(key, data).where("id IS NOT NULL AND octet_length(data) > 0")
    repeated = not rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    rows = rows.groupBy("id").agg(F.collect_list("data").alias("data")) if repeated else rows

    def alone(ids: pa.Array, some: pa.Array) -> Iterator[pa.RecordBatch]:
        held, ends, _ = _held(some)
        at = 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, side="right")) - 1)
            keys = ids.slice(at, to - at)
            letters, sizes = _sequences(held[ends[at] : ends[to]], np.diff(ends[at : to + 1]), keys.to_numpy(zero_copy_only=False), size, spacer, step, turns)
            yield pa.RecordBatch.from_arrays([keys, _built(pa.string(), letters, sizes, np.ones(len(sizes), bool))], ["id", "seq"])
            at = to

    def merged(i: int, texts: list[bytes]) -> str:
        strands = []
        for text in texts:
            for at in range(-(-len(text) // size)):
                piece = np.frombuffer(text[at * size : (at + 1) * size], np.uint8)
                # one chunk as a row of its own id, so that its spacer is that of chunk `at`
                letters, _ = _sequences(piece, np.array([len(piece)]), np.array([at * step + i]), size, spacer, step, turns)
                strands.append((at, letters.tobytes().decode()))
        return "".join(s for _, s in sorted(strands))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = batch.column(0), batch.column(1)
            if not repeated:
                yield from alone(ids, data)
                continue
            single = pc.equal(pc.list_value_length(data), 1)
            yield from alone(ids.filter(single), data.filter(single).flatten())
            several = pc.invert(single)
            for i, texts in zip(ids.filter(several).to_pylist(), data.filter(several).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([merged(i, texts)], pa.string())], ["id", "seq"])

    return rows.mapInArrow(run, "id long, seq string")
