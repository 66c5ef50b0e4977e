"""Packets of a rateless code, made and judged by the batch without a shuffle: which chunks a seed uses, their XOR, the strand and its errors.

A block has `most` chunks at most and lies in one row; blocks of one size are coded together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import rules as R
from helixframe.functions.strand import FOURS, _built
from helixframe.operators.fountain import prime_from
from helixframe.operators.packets import TOGETHER, _sums, packet_strand

LANE = 4
#: Multiplier and modulus of the seed's generator (Park and Miller).
FACTOR, MODULUS = 48271, 2147483647
#: Added to a seed before it is written, so that small ones aren't runs of one base; seeds have 16 bits.
SEED_MASK = 0xF9C3
SCALE = 1 << 20


def degree_limits(most: int, c: float = 0.1, delta: float = 0.5) -> list[int]:
    """Limits of a robust soliton distribution in parts of SCALE: the degree of v is one more than the number of limits up to v."""
    s = max(1.0, c * math.log(most / delta) * math.sqrt(most))
    spike = max(1, min(most, round(most / s)))
    p = [1 / most] + [1 / (d * (d - 1)) for d in range(2, most + 1)]
    p = [x + (s / (most * d) if d < spike else s * math.log(s / delta) / most if d == spike and s > delta else 0) for d, x in enumerate(p, 1)]
    out, have = [], 0.0
    for x in p[:-1]:
        have += x / sum(p)
        out.append(round(have * SCALE))
    return out


def primes_from(most: int) -> list[int]:
    """The smallest prime from k on, for k of 0 to `most`."""
    return [prime_from(max(2, k)) for k in range(most + 1)]


def drawn(seed: Column, times: int) -> Column:
    x = seed.cast("long") + 1
    for _ in range(times):
        x = x * FACTOR % MODULUS
    return x


@lru_cache(1 << 10)
def used_chunks(k: int, count: int, most: int) -> list[list[int]]:
    """The chunks of the packets of seeds 0 to count - 1, 0 to k - 1, each once, as many as the packet's degree: a walk with a fixed step over the
    places below a prime."""
    x, draws = np.arange(1, count + 1), []
    for _ in range(5):
        x = x * FACTOR % MODULUS
        draws.append(x)
    prime = primes_from(most)[k]
    degree = 1 + np.searchsorted(degree_limits(most), draws[2] % SCALE, side="right")
    walk = (draws[4][:, None] % prime + np.arange(prime) * (1 + draws[3][:, None] % (prime - 1))) % prime
    return [w[w < k][: min(d, k)].tolist() for w, d in zip(walk, degree.tolist())]


def blocks(table: DataFrame, id_col: str, data_col: str, size: int, most: int) -> DataFrame:
    """(file_id, block, data): the bytes of each row in blocks of `most` chunks of `size` bytes.  Rows without bytes have no block."""
    if size % LANE:
        raise ValueError(f"the size of a chunk is a multiple of {LANE} bytes")
    whole = size * most
    rows = table.select(F.col(f"`{id_col}`").alias("file_id"), F.col(f"`{data_col}`").cast("binary").alias("data")).where("octet_length(data) > 0")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length("data") / whole).cast("int") - 1), lambda i: F.substring(F.col("data"), i * whole + 1, F.lit(whole)))
    return rows.select("file_id", F.posexplode(cut).alias("block", "data")).withColumn("block", F.col("block").cast("long"))


#: The checksum of the bases of a byte.
VALUES = np.array([sum((i >> j & 3) + 1 for j in (0, 2, 4, 6)) for i in range(256)], np.int64)


def checksums(data: np.ndarray) -> np.ndarray:
    """The checksum of the bases of each row of bytes."""
    return (VALUES[data].sum(1) % 256).astype(np.uint8)


def packed_of(data: list[bytes], k: int, size: int, seeds: np.ndarray, used: list[list[int]]) -> np.ndarray:
    """The packets of blocks of k chunks, block by block, a row of bytes each: seed, payload and checksum."""
    heads = ((seeds ^ SEED_MASK) & 0xFFFF).astype(">u2").view(np.uint8).reshape(len(seeds), 2)
    plain = np.concatenate([np.broadcast_to(heads, (len(data), len(seeds), 2)), _sums(data, k, size, used)], axis=2).reshape(-1, size + 2)
    return np.concatenate([plain, checksums(plain)[:, None]], axis=1)


def letters_of(packed: np.ndarray) -> np.ndarray:
    """The bases of rows of bytes, as rows of letters."""
    return FOURS[packed].view(np.uint8)


def _binaries(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return _built(pa.binary(), rows.reshape(-1), np.full(n, width), np.ones(n, bool))


def packed_packets(table: DataFrame, id_col: str, data_col: str, size: int, most: int, tries: float, overhead: float | None = None) -> DataFrame:
    """(file_id, block, n_bytes, k, seed, degree, packed, error_prob): packets() as bytes, with the sum of the default rules of their strands.

    Blocks of one size are coded together, in a batch.  Where `overhead` is given, only the ceil(k (1 + overhead)) packets of each block that break
    the fewest rules, the smaller seed of equals, leave the task; rows that repeat an id choose each by itself.
    """
    rows = blocks(table, id_col, data_col, size, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, alike = batch.column(2).to_pylist(), {}
            for i, d in enumerate(data):
                alike.setdefault(-(-len(d) // size), []).append(i)
            for k, places in alike.items():
                n = min(math.ceil(k * tries), 1 << 16)
                if n < 1:
                    continue
                kept = n if overhead is None else min(n, math.ceil(k * (1 + overhead)))
                used, seeds = used_chunks(k, n, most), np.arange(n)
                degree = np.array([len(u) for u in used], np.int32)
                step = max(1, TOGETHER // n)
                for some in (places[i : i + step] for i in range(0, len(places), step)):
                    whole = packed_of([data[i] for i in some], k, size, seeds, used)
                    error = np.round(R.default_errors_of(letters_of(whole)), 6)
                    at = (np.argsort(error.reshape(len(some), n), axis=1, kind="stable")[:, :kept] + n * np.arange(len(some))[:, None]).ravel()
                    keys, lengths = pa.array(np.repeat(some, n)[at]), np.array([len(data[i]) for i in some], np.int32)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(keys), batch.column(1).take(keys), pa.array(np.repeat(lengths, n)[at]), pa.array(np.full(len(at), k, np.int32)),
                        pa.array((at % n).astype(np.int32)), pa.array(degree[at % n]), _binaries(whole[at]), pa.array(error[at]),
                    ], _PACKED)

    kind = rows.schema["file_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"file_id {kind}, block long, n_bytes int, k int, seed int, degree int, packed binary, error_prob double")


_PACKED = ["file_id", "block", "n_bytes", "k", "seed", "degree", "packed", "error_prob"]


def packets(table: DataFrame, id_col: str, data_col: str, size: int, most: int, tries: float) -> DataFrame:
    """(file_id, block, n_bytes, k, seed, degree, strand): for each block the packets of the seeds from 0, `tries` for each chunk.

    A strand is eight bases of the seed, the payload, and four of a checksum.
    """
    return packed_packets(table, id_col, data_col, size, most, tries).select("file_id", "block", "n_bytes", "k", "seed", "degree", packet_strand(F.col("packed")).alias("strand"))


def best_packed(table: DataFrame, id_col: str, data_col: str, size: int, most: int, tries: float, overhead: float) -> DataFrame:
    """(file_id, block, n_bytes, k, seed, degree, packed, error_prob): fewest_errors() of packets(), by the default rules, as bytes.

    Packets are chosen where they are made.  Only if ids repeat, which is looked up first, are the chosen ones of a block brought together: those
    that a row leaves out are behind as many of that row alone.
    """
    best = packed_packets(table, id_col, data_col, size, most, tries, overhead)
    repeated = table.groupBy(F.col(f"`{id_col}`").alias("file_id")).agg(F.count("*").alias("n")).where("n > 1")
    return best if repeated.isEmpty() else _kept(best, overhead, 0)


def _kept(scored: DataFrame, overhead: float, more: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("file_id", "block").orderBy("error_prob", "seed"))
    return scored.withColumn("_n", n).where(F.col("_n") <= F.ceil(F.col("k") * (1 + overhead)) + more).drop("_n")


def fewest_errors(rows: DataFrame, overhead: float, rules=R.default_rules, more: int = 0) -> DataFrame:
    """Of each block's packets those with the least sum of rules, the smaller seed of equals; with error_prob.

    ceil(k (1 + overhead)) + more packets of a block are kept.
    """
    scored = rows.withColumn("error_prob", F.round(rules(F.col("strand")), 6))
    return _kept(scored, overhead, more)
