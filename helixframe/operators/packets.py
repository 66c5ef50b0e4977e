"""Bytes to packets to strands and back.

Files are cut into source blocks of at most `block` chunks, and each block is coded by itself.  So encoding is a map without a shuffle,
and decoding groups by (file, block): no group grows with a file, however large, and a file of a third of all rows is many groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from helixframe.functions.strand import bytes_of_strands, strands_of
from helixframe.operators.codes import code, solve, used_chunks
from helixframe.operators.correction import encoder

# Masks over header integers by struct letter.
MASKS = {"H": 0xF9C3, "I": 0xF9C36F9C, "Q": 0xF9C36F9CF9C36F9C, "B": 0}

PACKETS = "file_id long, block long, k int, n_bytes int, seed long, used array<int>, degree int, packed binary"
SOLVED = "file_id long, block long, chunk_idx int, data binary"


def masked(value: int, letter: str = "I") -> int:
    return value ^ MASKS[letter]


def seed_stream(data: bytes, seed: int) -> bytes:
    """XOR with the byte stream that a packet's seed starts; its own inverse."""
    stream = np.frombuffer(np.random.default_rng(seed).bytes(len(data)), np.uint8)
    return (np.frombuffer(data, np.uint8) ^ stream).tobytes()


def source_blocks(table: DataFrame, id_col: str, data_col: str, size: int, block: int) -> DataFrame:
    """(file_id, block, data): slices of up to size * block bytes; null or empty data have none."""
    data, width = F.col("data"), size * block
    rows = table.select(F.col(id_col).alias("file_id"), F.col(data_col).cast("binary").alias("data")).where("octet_length(data) > 0")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length(data) / width).cast("int") - 1), lambda i: F.substring(data, i * width + 1, F.lit(width)))
    return rows.select("file_id", F.posexplode(cut).alias("block", "data")).withColumn("block", F.col("block").cast("long"))


def _block_seeds(block: int, count: int, sequential: bool, turn: int = 0) -> range:
    """Seeds below 2^32, those of one turn; those of one block never meet twice."""
    first = (0 if sequential else block * 7919 % 2**31) + turn * count
    return range(first, first + count)


def encode(table: DataFrame, id_col: str, data_col: str, size: int = 47, block: int = 128, overhead: float = 0.3, name: str = "raptor", correction: str = "rs", sequential: bool = True, scramble: bool = False, **options) -> DataFrame:
    """Packets of every block: `overhead` more than it has chunks (and eight), of seeds 0, 1, 2 and so on, packed as masked seed and payload."""
    return encode_blocks(source_blocks(table, id_col, data_col, size, block), size, overhead, name, correction, sequential, scramble, **options)


def block_seeds(table: DataFrame, id_col: str, data_col: str, size: int = 47, block: int = 128, overhead: float = 0.3) -> DataFrame:
    """(file_id, block, k, seeds): which packets encode() makes of each block, with seeds in sequence, where their payloads aren't wanted."""
    k = F.greatest(F.lit(4), F.ceil(F.octet_length("data") / size).cast("int"))
    rows = source_blocks(table, id_col, data_col, size, block).select("file_id", "block", k.alias("k"))
    return rows.withColumn("seeds", F.sequence(F.lit(0).cast("long"), F.floor(F.col("k") * (1 + overhead)).cast("long") + 7))


#: Packets whose parity is worked out at once.
TOGETHER = 1 << 14


def _sums(data: list[bytes], k: int, size: int, used: list[list[int]]) -> np.ndarray:
    """(block, packet, byte): the XOR of the used chunks of each packet, for blocks of k chunks at once."""
    whole = np.frombuffer(b"".join([d.ljust(k * size, b"\0") for d in data]), np.uint8)
    chunk = np.ascontiguousarray(whole.reshape(len(data), k, size).transpose(1, 0, 2))
    return np.stack([np.bitwise_xor.reduce(chunk[np.array(u, np.int64)], axis=0) for u in used], axis=1)


def encode_blocks(blocks: DataFrame, size: int = 47, overhead: float = 0.3, name: str = "raptor", correction: str = "rs", sequential: bool = True, scramble: bool = False, turn: int = 0, **options) -> DataFrame:
    """Packets of blocks (file_id, block, data); each turn makes as many, of other seeds.  Blocks of one size are coded together."""
    protect, _ = encoder(correction)

    def coded(batch: pa.RecordBatch) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
        data, alike = batch.column(2).to_pylist(), {}
        for i, (at, d) in enumerate(zip(batch.column(1).to_pylist(), data)):
            k = max(-(-len(d) // size), 4)
            alike.setdefault((k, _block_seeds(at, int(k * (1 + overhead)) + 8, sequential, turn)), []).append(i)
        for (k, seeds), rows in alike.items():
            how, n = code(name, k, **options), len(seeds)
            used = [used_chunks(how, seed) for seed in seeds]
            degree = np.array([len(u) for u in used], np.int32)
            flat = np.array([i for u in used for i in u], np.int32)
            heads = np.array([masked(seed) for seed in seeds], "<u4").view(np.uint8).reshape(n, 4)
            if scramble:
                streams = np.stack([np.frombuffer(seed_stream(bytes(size), seed), np.uint8) for seed in seeds])
            step = max(1, TOGETHER // n)
            for some in (rows[i : i + step] for i in range(0, len(rows), step)):
                payload = _sums([data[i] for i in some], k, size, used)
                payload = payload ^ streams if scramble else payload
                plain = np.concatenate([np.broadcast_to(heads, (len(some), n, 4)), payload], axis=2).reshape(-1, 4 + size)
                keys, m = pa.array(np.repeat(some, n)), len(some)
                ends = np.concatenate([[0], np.cumsum(np.tile(degree, m))]).astype(np.int32)
                lengths = np.repeat(np.array([len(data[i]) for i in some], np.int32), n)
                yield [
                    *(batch.column(c).take(keys).cast(pa.int64()) for c in (0, 1)), pa.array(np.full(n * m, k, np.int32)), pa.array(lengths),
                    pa.array(np.tile(np.array(seeds, np.int64), m)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.tile(flat, m))), pa.array(np.tile(degree, m)),
                ], plain

    def flush(held: list) -> pa.RecordBatch:
        packed = protect([x.tobytes() for _, plain in held for x in plain])
        columns = [pa.concat_arrays(list(c)) for c in zip(*(columns for columns, _ in held))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], [c.split()[0] for c in PACKETS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for columns, plain in coded(batch):
                held.append((columns, plain))
                count += len(plain)
                if count >= TOGETHER:
                    yield flush(held)
                    held, count = [], 0
        if held:
            yield flush(held)

    return blocks.select("file_id", "block", "data").mapInArrow(run, PACKETS)


@F.arrow_udf(StringType())
def _packed_strand(packed: pa.Array) -> pa.Array:
    return strands_of(packed)


def packet_strand(packed: Column) -> Column:
    """Bytes as bases, four for each, a batch at a time."""
    return _packed_strand(packed)


def parse(rows: DataFrame, strand: str = "strand", correction: str = "rs", scramble: bool = False) -> DataFrame:
    """Adds seed, payload and status (ok or corrupt) to strands; what isn't a packet or can't be repaired is corrupt and has nulls."""
    _, repair = encoder(correction)

    @F.arrow_udf("seed long, payload binary")
    def unpack(strands: pa.Array) -> pa.Array:
        seeds, payloads = [], []
        for body in repair(bytes_of_strands(strands).to_pylist()):
            if body is None or len(body) < 5:
                seeds.append(None)
                payloads.append(None)
                continue
            seed = masked(int.from_bytes(body[:4], "little"))
            seeds.append(seed)
            payloads.append(seed_stream(body[4:], seed) if scramble else body[4:])
        return pa.StructArray.from_arrays([pa.array(seeds, pa.int64()), pa.array(payloads, pa.binary())], ["seed", "payload"])

    rows = rows.withColumn("_p", unpack(F.col(strand)))
    return rows.select("*", F.col("_p.seed").alias("seed"), F.col("_p.payload").alias("payload"), F.when(F.col("_p.seed").isNull(), "corrupt").otherwise("ok").alias("status")).drop("_p")


def same_seeds(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple[int, ...], list[int], np.ndarray]]:
    """(k, size, seeds, rows, payloads by packet, row and byte): the blocks of a batch whose packets have the same seeds, TOGETHER packets at a time.

    Of a block's payloads those of the longest size count.
    """
    lists, whole = batch.column(3), batch.column(3).flatten()
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    seeds, payloads = whole.field("seed").to_numpy(), whole.field("payload").to_pylist()
    lengths, alike = np.array([len(p) for p in payloads], np.int64), {}
    for row, k in enumerate(batch.column(2).to_pylist()):
        at = np.arange(first[row], first[row + 1])
        at = at[lengths[at] == lengths[at].max()]
        at = at[np.argsort(seeds[at])]
        alike.setdefault((k, int(lengths[at[0]]), seeds[at].tobytes()), []).append((row, at))
    for (k, size, known), blocks in alike.items():
        n = len(blocks[0][1])
        step = max(1, TOGETHER // n)
        for some in (blocks[i : i + step] for i in range(0, len(blocks), step)):
            data = np.frombuffer(b"".join([payloads[i] for _, at in some for i in at]), np.uint8)
            yield k, size, tuple(np.frombuffer(known, np.int64).tolist()), [row for row, _ in some], data.reshape(len(some), n, size).transpose(1, 0, 2)


def decode(packets: DataFrame, name: str = "raptor", solver: str = "gauss", **options) -> DataFrame:
    """(file_id, block, chunk_idx, data) of packets (file_id, block, k, seed, payload): the chunks that they fix.

    Copies of a packet are dropped before a block's packets are gathered.  A block in which packets of one seed differ in payload uses neither
    of them.  Blocks whose packets have the same seeds are solved at once: their payloads lie end to end in one number.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, size, seeds, rows, data in same_seeds(batch):
                got = solve(code(name, k, **options), [(seed, int.from_bytes(d.tobytes(), "big")) for seed, d in zip(seeds, data)], solver)
                found = sorted(got)
                flat = np.frombuffer(b"".join([got[i].to_bytes(size * len(rows), "big") for i in found]), np.uint8)
                flat = flat.reshape(len(found), len(rows), size).transpose(1, 0, 2).tobytes()
                keys = pa.array(np.repeat(rows, len(found)))
                pieces = pa.array([flat[i : i + size] for i in range(0, len(flat), size)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keys) for c in (0, 1)), pa.array(np.tile(np.array(found, np.int32), len(rows))), pieces], ["file_id", "block", "chunk_idx", "data"])

    key = ["file_id", "block"]
    some = packets.where("seed IS NOT NULL AND payload IS NOT NULL").select(*[F.col(c).cast("long").alias(c) for c in key], F.col("k").cast("int").alias("k"), F.col("seed").cast("long").alias("seed"), "payload")
    once = some.repartition(*key).groupBy(*key, "k", "seed").agg(F.min("payload").alias("payload"), F.max("payload").alias("_other"))
    rows = once.where("payload = _other").groupBy(*key).agg(F.min("k").alias("k"), F.collect_list(F.struct("seed", "payload")).alias("p"))
    return rows.select(*key, "k", "p").mapInArrow(run, SOLVED)


def assemble(solved: DataFrame, sizes: DataFrame) -> DataFrame:
    """(file_id, block, data, n_missing): chunks joined in order, zeros where one is missing, cut to the block's length.

    sizes: (file_id, block, k, n_bytes), one row each; blocks without any solved chunk come back as zeros.
    """
    parts = solved.groupBy("file_id", "block").agg(F.map_from_entries(F.collect_list(F.struct("chunk_idx", F.hex("data").alias("h")))).alias("m"), F.max(F.octet_length("data")).alias("size"))
    rows = sizes.join(parts, ["file_id", "block"], "left").withColumn("size", F.coalesce("size", F.ceil(F.col("n_bytes") / F.col("k")))).withColumn("m", F.coalesce("m", F.create_map().cast("map<int,string>")))
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.repeat(F.lit("00"), F.col("size").cast("int")))), "")
    return rows.select("file_id", "block", F.unhex(F.left(digits, F.col("n_bytes") * 2)).alias("data"), (F.col("k") - F.size("m")).alias("n_missing"))


def missing_chunks(solved: DataFrame, sizes: DataFrame) -> DataFrame:
    """(file_id, block, chunk_idx) that no equation fixed."""
    return sizes.select("file_id", "block", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("chunk_idx")).join(solved, ["file_id", "block", "chunk_idx"], "left_anti")


def suspects(packets: DataFrame, corrupt: DataFrame, valid: DataFrame) -> DataFrame:
    """(file_id, block, seed) of packets that use all corrupt chunks of their block and no chunk known to be valid."""
    used = packets.select("file_id", "block", "seed", F.explode("used").alias("chunk_idx"))
    wanted = corrupt.groupBy("file_id", "block").agg(F.count("*").alias("n"))
    key = ["file_id", "block"]
    hit = used.join(corrupt, [*key, "chunk_idx"]).groupBy(*key, "seed").agg(F.count("*").alias("n")).join(wanted, [*key, "n"], "left_semi")
    return hit.select(*key, "seed").join(used.join(valid, [*key, "chunk_idx"]).select(*key, "seed"), [*key, "seed"], "left_anti")


def should_drop(packets: DataFrame, probability: Column, upper: float = 1.0, limit_only: bool = True, salt: int = 0) -> DataFrame:
    """Packets that the rules let through: under the bound, or by chance seeded by the packet's own keys."""
    draw = (F.pmod(F.xxhash64("file_id", "block", "seed", F.lit(salt)), F.lit(1 << 30)) / (1 << 30)) * upper
    rows = packets.withColumn("error_prob", probability).withColumn("error_prob", F.explode(F.array("error_prob")))  # a row of its own: worked out once
    return rows.where(F.col("error_prob") <= (F.lit(upper) if limit_only else draw))


def priority_ok(degree: Column, used: Column, last: int, rank: Column) -> Column:
    """Packets of one chunk must use one up to `last`; of two chunks, both, while fewer than last / 2 packets came before."""
    late = F.exists(used, lambda i: i > last)
    return ~(((degree == 1) & late) | ((degree == 2) & late & (rank < last / 2)))


def erasures(packets: DataFrame, rate: float) -> DataFrame:
    """All but the first floor(n * rate) packets of each block."""
    rows = packets.groupBy("file_id", "block").agg(F.sort_array(F.collect_list(F.struct("seed", "used", "degree", "packed", "k", "n_bytes"))).alias("p"))
    kept = F.slice("p", (F.floor(F.size("p") * rate) + 1).cast("int"), F.size("p"))
    return rows.select("file_id", "block", F.inline(kept))
