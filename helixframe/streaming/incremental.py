"""Packets decoded as they come: state for each source block, a result as soon as its rank is full."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from helixframe.operators.codes import back_substitute, code, insert, sources
from helixframe.operators.packets import SOLVED

#: Neighbouring files whose blocks of one number share a state, as a power of two: a call costs far more than a block.
NEIGHBOURS = 5
STATE = "place array<int>, size array<int>, done array<boolean>, held array<binary>"


def _loaded(held: bytes, width: int, size: int) -> dict[int, tuple[int, int]]:
    """Pivots of their bytes: a mask of `width` bytes and a payload for each."""
    step, out = width + size, {}
    for at in range(0, len(held), step):
        mask = int.from_bytes(held[at : at + width], "little")
        out[mask & -mask] = (mask, int.from_bytes(held[at + width : at + step], "big"))
    return out


def decode_stream(packets: DataFrame, name: str = "raptor", **options) -> DataFrame:
    """(file_id, block, chunk_idx, data), once a block is solved, of a stream (file_id, block, k, seed, payload).

    A block's state holds at most k independent equations, whatever comes; packets of a solved block are passed over.  Each packet is worked in
    as it comes, so a block is given in the batch in which its rank fills, however the packets are spread over batches.  The states of blocks of
    one number in up to 2^NEIGHBOURS neighbouring files are kept in one row.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {p: (size, done, held) for p, size, done, held in zip(*state.get)} if state.exists else {}
        open_: dict[int, tuple[int, dict]] = {}  # number of chunks and pivots of the blocks that come here
        sizes = {p: size for p, (size, _, _) in known.items()}
        over = {p for p, (_, done, _) in known.items() if done}
        for frame in frames:
            places = frame["place"].tolist()
            for p, k, seed, payload in zip(places, frame["k"].tolist(), frame["seed"].tolist(), frame["payload"].tolist()):
                if p in over:
                    continue
                if p not in open_:
                    open_[p] = (k, _loaded(known[p][2], (k + 7) // 8, sizes[p]) if p in known else {})
                k, pivots = open_[p]
                size = sizes.get(p, 0)
                if len(pivots) == k or payload is None or pd.isna(seed) or (size and len(payload) != size):
                    continue
                sizes[p] = len(payload)
                insert(pivots, sources(code(name, k, **options), int(seed)), int.from_bytes(payload, "big"))
        out: list[tuple] = []
        for p, (k, pivots) in open_.items():
            size = sizes.get(p, 0)
            if len(pivots) == k > 0:
                solved, file = back_substitute(pivots), None if pd.isna(key[0]) else (int(key[0]) << NEIGHBOURS) + p
                out += [(file, key[1], i, solved[i].to_bytes(size, "big")) for i in sorted(solved)]
                known[p] = (size, True, b"")
            else:
                known[p] = (size, False, b"".join([m.to_bytes((k + 7) // 8, "little") + d.to_bytes(size, "big") for m, d in pivots.values()]))
        state.update(([*known], *(list(c) for c in zip(*known.values()))) if known else ([], [], [], []))
        if out:
            yield pd.DataFrame(dict(zip(["file_id", "block", "chunk_idx", "data"], map(list, zip(*out)))))

    group = F.shiftright(F.col("file_id").cast("long"), NEIGHBOURS).alias("neighbours")
    place = F.coalesce(F.col("file_id").cast("long").bitwiseAND((1 << NEIGHBOURS) - 1), F.lit(0)).cast("int").alias("place")
    rows = packets.select(group, "block", place, "k", "seed", "payload")
    return rows.groupBy("neighbours", "block").applyInPandasWithState(run, SOLVED, STATE, "append", GroupStateTimeout.NoTimeout)
