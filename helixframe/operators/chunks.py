"""Bytes as fixed-size chunks, and chunks as strands."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.strand import FOURS, _built


def chunks(table: DataFrame, id_col: str, data_col: str, size: int) -> DataFrame:
    """(id_col, chunk_idx, chunk_hex): all bytes of a column in chunks of `size`; the last may be shorter, and no bytes give no chunk."""
    data = F.col("data")  # binary: a slice costs its own length, wherever it is
    last = F.ceil(F.octet_length(data) / size).cast("int") - 1
    rows = table.select(id_col, F.col(data_col).cast("binary").alias("data")).where("octet_length(data) > 0")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))
    rows = rows.select(id_col, F.posexplode(cut).alias("chunk_idx", "chunk"))
    return rows.select(id_col, F.col("chunk_idx").cast("long").alias("chunk_idx"), F.lower(F.hex("chunk")).alias("chunk_hex"))


#: Bytes of data whose strands are made at once.
PIECE = 4 << 20


def strands(table: DataFrame, id_col: str, data_col: str, size: int = 47) -> DataFrame:
    """(id_col, chunk_idx, strand): chunks() as bases.  Bytes are looked up for a batch at a time, four bases for each."""
    return sliced(table, id_col, data_col, size, "strand", "string", _bases)


def slices(table: DataFrame, id_col: str, data_col: str, size: int) -> DataFrame:
    """(id_col, chunk_idx, data): chunks() as bytes."""
    return sliced(table, id_col, data_col, size, "data", "binary", _binary)


def _bases(held: np.ndarray, lengths: np.ndarray) -> pa.Array:
    starts = np.concatenate([[0], np.cumsum(lengths * 4)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(starts), pa.py_buffer(FOURS[held])]).cast(pa.string())


def _binary(held: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return _built(pa.binary(), held, lengths, np.ones(len(lengths), bool))


def sliced(table: DataFrame, id_col: str, data_col: str, size: int, name: str, kind: str, made: Callable[..., pa.Array], piece: int = PIECE, numbered: bool = False) -> DataFrame:
    """(id_col, chunk_idx, name): what `made` gives for the bytes of many chunks end to end and their lengths, and their numbers if `numbered`; about
    `piece` bytes at once."""
    rows = table.select(id_col, F.col(data_col).cast("binary").alias("data")).where("octet_length(data) > 0")

    def run(batches):
        for batch in batches:
            data = batch.column(1).cast(pa.large_binary())
            ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
            held, at = np.frombuffer(data.buffers()[2], np.uint8), 0
            while at < len(data):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + piece, side="right")) - 1)
                n = np.diff(ends[at : to + 1])
                count = -(-n // size)
                first = np.cumsum(count) - count
                idx = np.arange(count.sum()) - np.repeat(first, count)
                lengths = np.full(len(idx), size, np.int64)
                lengths[first + count - 1] = n - (count - 1) * size
                keys = batch.column(0).take(pa.array(np.repeat(np.arange(at, to), count)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(idx), made(held[ends[at] : ends[to]], lengths, *([idx] if numbered else []))], [id_col, "chunk_idx", name])
                at = to

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, chunk_idx long, `{name}` {kind}")


def xor_lanes(table: DataFrame, key: str, lane_bytes: int = 4) -> DataFrame:
    """XOR of the chunks of each key, a lane at a time: (key, lane, value).  Shorter chunks count as padded with zeros."""
    width = 2 * lane_bytes
    rows = table.select(key, "chunk_hex", F.explode(F.sequence(F.lit(0), F.ceil(F.length("chunk_hex") / width).cast("int") - 1)).alias("lane"))
    value = F.conv(F.rpad(F.substring("chunk_hex", F.col("lane") * width + 1, F.lit(width)), width, "0"), 16, 10).cast("long")
    return rows.withColumn("value", value).groupBy(key, F.col("lane").cast("long").alias("lane")).agg(F.bit_xor("value").alias("value"))
