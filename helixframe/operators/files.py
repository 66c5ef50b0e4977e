"""Settings of a file's coding, how far packets go, packets that contradict the others, and parts by index.  See file_codes for files."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import bases as B
from helixframe.functions import rules as R
from helixframe.operators import packets as P
from helixframe.operators.codes import back_substitute, code, insert, sources
from helixframe.scratch import scratch


@dataclass
class Settings:
    """How files are coded; fields are the options of a section of settings in INI form."""

    chunk_size: int = 71
    block: int = 128
    algorithm: str = "raptor"
    error_correction: str = "rs"
    insert_header: bool = True
    drop_upper_bound: float = 0.5
    overhead: float = 0.4
    xor_by_seed: bool = False
    priority_chunks: int = 0  # 0: none
    turns: int = 40

    def options(self) -> dict[str, Column]:
        return {k: F.lit(v) for k, v in asdict(self).items()}


def settings(entries: dict[str, str]) -> tuple[Settings, list[str]]:
    """Settings from options of an INI section, and the options that are not known."""
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    known = {k: (v.strip().lower() in ("true", "1", "yes") if kinds[k] is bool else kinds[k](v)) for k, v in entries.items() if k in kinds}
    return Settings(**known), sorted(set(entries) - set(kinds))


@lru_cache(1 << 12)
def _curve(name: str, k: int, seeds: bytes, options: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Rank, and the chunks that are fixed, behind each of the seeds in order."""
    how, pivots, rank, solved = code(name, k, **dict(options)), {}, [], []
    for seed in np.frombuffer(seeds, np.int64).tolist():
        grown = len(pivots) < k and insert(pivots, sources(how, seed), 0)
        rank.append(len(pivots))
        solved.append(k if len(pivots) == k else len(back_substitute(pivots)) if grown else solved[-1] if solved else 0)
    return np.array(rank, np.int32), np.array(solved, np.int32)


#: Blocks whose curves are sent at once.
TOGETHER = 1 << 10


def rank_curves(blocks: DataFrame, name: str = "raptor", **options) -> DataFrame:
    """(file_id, block, k, n, rank, solved): how far the first n packets of a block (file_id, block, k, seeds) go, in order of seed.

    Only equations are looked at, no payloads: rank, and the chunks that they would fix.  A curve depends on k and the seeds alone, and is worked out
    once for all blocks that have the same ones.
    """
    how = tuple(sorted(options.items()))
    rows = blocks.select(F.col("file_id").cast("long").alias("file_id"), F.col("block").cast("long").alias("block"), F.col("k").cast("int").alias("k"), F.sort_array(F.col("seeds").cast("array<long>")).alias("seeds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, TOGETHER) for i in range(0, len(whole), TOGETHER)):
                lists = batch.column(3)
                seeds, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
                ends = np.cumsum(n)
                curves = [_curve(name, k, seeds[e - m : e].tobytes(), how) for k, e, m in zip(batch.column(2).to_pylist(), ends.tolist(), n.tolist())]
                keys, at = pa.array(np.repeat(np.arange(len(n)), n)), np.arange(1, len(seeds) + 1) - np.repeat(ends - n, n)
                rank, solved = (np.concatenate([c[i] for c in curves]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(keys) for i in range(3)), pa.array(at.astype(np.int32)), pa.array(rank), pa.array(solved)], ["file_id", "block", "k", "n", "rank", "solved"])

    return rows.mapInArrow(run, "file_id long, block long, k int, n int, rank int, solved int")


def rank_curve(packets: DataFrame, name: str = "raptor", **options) -> DataFrame:
    """(file_id, block, n, rank, solved): rank_curves() of packets (file_id, block, k, seed)."""
    blocks = packets.select("file_id", "block", "k", "seed").groupBy("file_id", "block").agg(F.min("k").alias("k"), F.collect_list("seed").alias("seeds"))
    return rank_curves(blocks, name, **options).drop("k")


def without_liar(packets: DataFrame, name: str = "raptor", **options) -> DataFrame:
    """(file_id, block, liar, chunk_idx, data): blocks solved without the one packet (file_id, block, k, seed, payload) that contradicts the others.

    liar: its seed, null where no packet contradicts.  Packets are left out one by one until the rest agree; a block with more than one
    liar, or too few packets to tell, has no row.
    """

    def agreed(rows) -> dict | None:
        pivots: dict = {}
        for mask, data in rows:
            while mask:
                held = pivots.get(mask & -mask)
                if held is None:
                    pivots[mask & -mask] = (mask, data)
                    break
                mask, data = mask ^ held[0], data ^ held[1]
            else:
                if data:
                    return None
        return pivots

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        k, size, first = int(frame["k"].iloc[0]), len(frame["payload"].iloc[0]), frame.iloc[0]
        pairs = sorted(zip(frame["seed"], map(bytes, frame["payload"])))
        rows = [(sources(code(name, k, **options), int(s)), int.from_bytes(p, "big")) for s, p in pairs]
        for i in range(-1, len(rows)):
            pivots = agreed([r for j, r in enumerate(rows) if j != i])
            if pivots is not None and len(pivots) == k:
                got = back_substitute(pivots)
                liar = None if i < 0 else int(pairs[i][0])
                return pd.DataFrame({"file_id": first["file_id"], "block": first["block"], "liar": pd.array([liar] * k, "Int64"), "chunk_idx": sorted(got), "data": [got[j].to_bytes(size, "big") for j in sorted(got)]})
        return pd.DataFrame({"file_id": [], "block": [], "liar": [], "chunk_idx": [], "data": []})

    return packets.select("file_id", "block", "k", "seed", "payload").groupBy("file_id", "block").applyInPandas(run, "file_id long, block long, liar long, chunk_idx int, data binary")


def with_part(strand: Column, part: Column, parts: int) -> Column:
    """A strand behind which the number of its part is written in as many bases as `parts` parts need."""
    return F.concat(strand, B.base_four(part, max(1, math.ceil(math.log(parts, 4)))))


def part_of(strand: Column, parts: int) -> Column:
    """A struct (part, strand) of a strand with its part behind it; null part where that isn't one of them."""
    width = max(1, math.ceil(math.log(parts, 4)))
    part = B.from_base_four(F.right(strand, F.lit(width)))
    return F.struct(F.when(part < parts, part).alias("part"), F.substring(strand, F.lit(1), F.length(strand) - width).alias("strand"))
