"""K-mers of many strands at once, and strands that contain others."""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import strand as S


def kmer_counts(rows: DataFrame, seq: str, k: int) -> DataFrame:
    """(kmer, n) over all strands, in any letters.  Each batch is counted by numbers first, so a k-mer crosses the shuffle once for a batch.

    For k up to 11: a batch counts in an array of 4 ** k.
    """
    if not 0 < k <= 11:
        raise ValueError("k must be in 1..11")
    names = np.array(["".join(x) for x in itertools.product(S.BASES, repeat=k)])

    def count(batches):
        for batch in batches:
            texts = [x for x in batch.column(0).to_pylist() if x]
            data = S._CODE[np.frombuffer("".join(texts).encode("utf-8", "replace"), np.uint8)].astype(np.int64)
            row = np.repeat(np.arange(len(texts)), [len(x.encode("utf-8", "replace")) for x in texts]) if texts else np.zeros(0, np.int64)
            n = len(data) - k + 1
            other: Counter = Counter()
            if n > 0:
                value, plain = np.zeros(n, np.int64), row[:n] == row[k - 1 :]
                strange = set(np.unique(row[data > 3]).tolist())
                for i in strange:
                    other.update(texts[i][j : j + k] for j in range(len(texts[i]) - k + 1))
                if strange:
                    plain &= ~np.isin(row[:n], list(strange))
                for j in range(k):
                    value = value * 4 + (data[j : j + n] & 3)
                seen = np.bincount(value[plain], minlength=4**k)
                some = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array(names[some].tolist() + list(other), pa.string()), pa.array(seen[some].tolist() + list(other.values()), pa.int64())], ["kmer", "n"])

    return rows.select(seq).mapInArrow(count, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def block_bases(rows: DataFrame, seq: str, width: int) -> DataFrame:
    """(block, a, c, g, t, n): how often each base is in the pieces of `width` bases of all strands, by number.  Each batch is counted before anything moves."""
    names = ["block", *S.BASES.lower(), "n"]

    def count(batches):
        for batch in batches:
            data, ends, _ = S._held(batch.column(0))
            at = (np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))) // width
            n = np.bincount(at * 5 + S._CODE[data], minlength=5 * (int(at.max(initial=-1)) + 1)).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(len(n)), *n.T[:4].copy(), n.sum(1))], names)

    counted = rows.select(seq).mapInArrow(count, ", ".join(f"{c} long" for c in names))
    return counted.groupBy("block").agg(*[F.sum(c).alias(c) for c in names[1:]])


#: Bits of the filter that wholes are read through; a fuller one lets more rows through and changes no result.
FILTER = 26
#: Bytes of strands that are looked at together.
PIECE = 1 << 20
_BASE, _SPREAD = 0x9E3779B97F4A7C15 | 1, np.uint64(0xD6E8FEB86659FD93)


def _rolled(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n bytes in a row, by halves."""
    first, size = data.astype(np.uint64), 1
    out = first
    for digit in bin(n)[3:]:
        out = out[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + out[size:] if len(out) > size else out[:0]
        size *= 2
        if digit == "1":
            out = out[:-1] * np.uint64(_BASE) + first[size:] if len(out) > 1 else out[:0]
            size += 1
    out = (out ^ out >> np.uint64(32)) * _SPREAD + np.uint64(n)
    return out ^ out >> np.uint64(29)


def _seeds(parts: DataFrame, k: int) -> DataFrame:
    """(part_id, _part, _p, _h): the bytes of each part, a number of its own, and the hash of its first k bytes, of all where there are fewer."""
    rows = parts.select("part_id", F.col("seq").cast("binary").alias("_part"), F.monotonically_increasing_id().alias("_p")).where("octet_length(_part) > 0")

    def run(batches):
        for batch in batches:
            heads = [x[:k] for x in batch.column(1).to_pylist()]
            out = np.zeros(len(heads), np.uint64)
            for n in set(map(len, heads)):
                at = [i for i, x in enumerate(heads) if len(x) == n]
                out[at] = _rolled(np.frombuffer(b"".join([heads[i] for i in at]), np.uint8), n)[::n]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], ["part_id", "_part", "_p", "_h"])

    return rows.mapInArrow(run, f"part_id {rows.schema[0].dataType.simpleString()}, _part binary, _p long, _h long")


def places(parts: DataFrame, wholes: DataFrame, k: int = 16) -> DataFrame:
    """(whole_id, _w, _h, _tail): where a whole may have the first k bytes of a part, and its bytes from there on, as many as the longest part has.

    The hashes of the parts' heads are a filter of 2^FILTER bits at most, 8 MB on the driver and in each worker, so that no k-mer leaves a
    worker that no part begins with, but for false hits of the filter.
    """
    seeds = _seeds(parts, k)
    bit = F.shiftrightunsigned("_h", 64 - FILTER) + 1  # these buckets begin at one
    bits = seeds.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    sizes = seeds.select(F.octet_length("_part").alias("n")).agg(F.collect_set(F.least("n", F.lit(k))).alias("n"), F.max("n").alias("most")).first()  # k at most
    lengths, most = sorted(sizes["n"]), sizes["most"] or 0
    filled = np.zeros((1 << FILTER) // 8, np.uint8)
    for r in bits:
        filled[(r["b"] - 1) * len(r["bits"]) :][: len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    held = parts.sparkSession.sparkContext.broadcast(filled)

    def run(batches):
        known = held.value
        for batch in batches:
            data = batch.column(1).cast(pa.large_binary())
            ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
            whole, at = np.frombuffer(data.buffers()[2] or b"", np.uint8), 0
            while at < len(data):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, side="right")) - 1)
                low, high = int(ends[at]), int(ends[to])
                row = np.repeat(np.arange(at, to), np.diff(ends[at : to + 1]))
                for n in lengths:
                    value = _rolled(whole[low:high], n)
                    bit = (value >> np.uint64(64 - FILTER)).astype(np.int64)
                    hit = np.flatnonzero(known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    hit = hit[row[hit] == row[hit + n - 1]]
                    if len(hit):
                        tails = [whole[low + i : min(low + i + most, e)].tobytes() for i, e in zip(hit.tolist(), ends[row[hit] + 1].tolist())]
                        rows = pa.array(row[hit])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), pa.array(value[hit].view(np.int64)), pa.array(tails, pa.binary())], ["whole_id", "_w", "_h", "_tail"])
                at = to

    rows = wholes.select("whole_id", F.col("seq").cast("binary").alias("_seq"), F.monotonically_increasing_id().alias("_w")).where("octet_length(_seq) > 0")
    return rows.mapInArrow(run, f"whole_id {rows.schema[0].dataType.simpleString()}, _w long, _h long, _tail binary")


def contained(parts: DataFrame, wholes: DataFrame, k: int = 16) -> DataFrame:
    """(part_id, whole_id): which of the strands (part_id, seq) lie in which of the longer ones (whole_id, seq).

    A part's first k bytes are looked up at all places of the wholes; what meets there is compared.  Parts shorter than k are met
    by their own length, and an empty part lies nowhere.
    """
    met = places(parts, wholes, k).join(_seeds(parts, k), "_h").where(F.startswith("_tail", "_part"))
    return met.select("part_id", "whole_id", "_p", "_w").distinct().select("part_id", "whole_id")


def _codes(strands: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All k-mers of ACGT as numbers of two bits a base, and the strand of each; k is 31 at most.  K-mers with other letters are left out."""
    held, ends, _ = S._held(strands)
    if len(held) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = S._CODE[held]
    first, size = (data & 3).astype(np.int64), 1
    value = first
    for digit in bin(k)[3:]:  # by halves
        value = value[:-size] << 2 * size | value[size:]
        size *= 2
        if digit == "1":
            value, size = value[:-1] << 2 | first[size:], size + 1
    row, odd = np.repeat(np.arange(len(strands)), np.diff(ends)), np.concatenate([[0], np.cumsum(data > 3)])
    n = len(value)
    good = np.flatnonzero((row[:n] == row[k - 1 :]) & (odd[k:] == odd[:-k]))
    return value[good], row[good]


#: Bits of the places where a task keeps k-mers that it has sent, 8 bytes each; what is pushed out is sent once more, and no result changes.
KEPT = 22


def _sent(value: np.ndarray, k: int, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer, place in value, weight): each different k-mer with 1 where it is new to the task and comes once here, else with 2.

    `kept` holds what was sent, exactly: k-mers with a last bit for the weight.  Those that have gone with 2 don't go again.
    """
    at = lambda x: (x.astype(np.uint64) * np.uint64(_BASE) >> np.uint64(64 - KEPT)).astype(np.int64)
    place = np.flatnonzero(kept[at(value)] != (value << 1 | 1))
    value = value[place]
    bits = max(len(value), 1).bit_length()
    if 2 * k + bits <= 63:
        packed = np.sort(value << bits | np.arange(len(value)))
        value, order = packed >> bits, packed & (1 << bits) - 1
    else:
        order = np.argsort(value, kind="stable")
        value = value[order]
    new = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    value, place, n = value[new], place[order[new]], np.diff(np.append(new, len(value)))
    slot = at(value)
    again = (n > 1) | (kept[slot] == value << 1)
    kept[slot] = value << 1 | again
    return value, place, 1 + again


def shared_mers(rows: DataFrame, keys: list[str], seq: str, k: int = 19) -> DataFrame:
    """(keys, n): strands with k-mers that come again, in them or in others, and how many of theirs do.

    A k-mer that comes once has one place, so those that come once are found, with their places, and taken from what a strand has.  K-mers are
    numbers, exactly; a task sends a k-mer once with its place, and once more without one when it meets it again.  K-mers that hold
    other letters than ACGT are compared as they are.  For k up to 31.
    """
    if not 0 < k <= 31:
        raise ValueError("k must be in 1..31")
    at = {c: i for i, c in enumerate(keys)}
    plain = rows.select(*keys, F.col(seq).alias("_seq")).where("_seq IS NOT NULL")

    def send(batches):
        kept = np.full(1 << KEPT, -1, np.int64)
        for batch in batches:
            value, row = _codes(batch.column(len(at)), k)
            value, place, weight = _sent(value, k, kept)
            home = pa.array(row[place], mask=weight > 1)  # no place where it comes again
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(home) for i in range(len(at))], pa.array(value), pa.array(weight)], [*keys, "_code", "_w"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.drop("_seq").schema)
    sent = plain.mapInArrow(send, f"{kinds}, _code long, _w long").repartition("_code")  # no map-side aggregate: a task sends few k-mers twice
    once = sent.groupBy("_code").agg(F.sum("_w").alias("_all"), *[F.first(c).alias(c) for c in keys]).where("_all = 1")

    mers = plain.where(F.col("_seq").rlike("[^ACGT]")).select(*keys, F.explode(S.kmers(F.col("_seq"), k)).alias("_mer")).where(F.col("_mer").rlike("[^ACGT]"))
    strange = mers.groupBy("_mer").agg(F.count("*").alias("_all"), *[F.first(c).alias(c) for c in keys]).where("_all = 1")

    have = plain.where(F.length("_seq") >= k).select(*keys, (F.length("_seq") - k + 1).cast("long").alias("n"))
    for gone in (once, strange):
        have = have.unionByName(gone.select(*keys, F.lit(-1).cast("long").alias("n")))
    return have.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")
