"""Packing into optimal length buckets.

Texts longer than the longest sequence are cut into pieces of that length.  The histogram of all piece lengths has at most `max_len`
entries, so it fits on the driver whatever the input; dynamic programming over it finds the bucket lengths with the least padding in
all.  Inside a bucket, batches take as many sequences as the token budget allows at the bucket's length, in order of length.

Batches are formed in shards of at most about `shard_rows` pieces, at every size by the same rule, so that no task sorts a whole bucket;
each shard leaves one batch that may not be full.

`pack` deals lengths to batches; `pack_documents` also carries the token ids of each piece, so that its rows are the batches themselves.

Cases: empty and null texts have one piece of length 0, in the first bucket, and pad it whole.  A null doc_id is packed like any other.
An empty table gives no rows.  Repeated rows are packed each by itself; pieces of equal length go by id and number.  Very long texts are
cut into pieces where they are read.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.bpe import codec
from helixframe.llm.common import columns_of, joined, packed, prepare, save, unpacked


def bucket_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """The at most `buckets` bucket lengths, each an occurring length, that minimise padding when each sequence pads to the next one."""
    sizes = np.array(sorted(histogram), np.int64)
    if not len(sizes):
        return []
    count = np.array([histogram[int(s)] for s in sizes], np.int64)
    rows, tokens = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * sizes)])
    n = len(sizes)
    # best[j]: least padding of the first j sizes in the buckets so far; last[k][j]: where the last of k buckets begins
    best, last = np.where(np.arange(n + 1) > 0, np.iinfo(np.int64).max // 4, 0), []
    for _ in range(min(buckets, n)):
        now, begin = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] + sizes[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            i = int(np.argmin(cost))
            if cost[i] < now[j]:
                now[j], begin[j] = cost[i], i
        last.append(begin)
        best = now
    out, j = [], n
    for begin in reversed(last):
        if j and begin[j] >= 0:
            out.append(int(sizes[j - 1]))
            j = int(begin[j])
    return out[::-1]


def _batches(rows: DataFrame, buckets: int, budget: int, shard_rows: int, max_len: int) -> DataFrame:
    """rows: (id, n, piece, piece_len, and others)."""
    extra = [c for c in rows.columns if c not in ("id", "n", "piece", "piece_len")]
    histogram = {r["piece_len"]: r["count"] for r in rows.groupBy("piece_len").count().collect()}  # max_len + 1 rows at most
    bounds = bucket_bounds(histogram, buckets) or [max_len]
    total = {b: sum(c for s, c in histogram.items() if s <= b and all(s > x for x in bounds if x < b)) for b in bounds}
    fit, shards = F.lit(bounds[-1]), F.lit(1)
    for b in reversed(bounds):
        fit = F.when(F.col("piece_len") <= b, F.lit(b)).otherwise(fit)
    for b, c in total.items():
        shards = F.when(F.col("bucket_len") == b, F.lit(-(-c // shard_rows) or 1)).otherwise(shards)
    rows = rows.withColumn("bucket_len", fit).withColumn("shard", F.pmod(F.xxhash64("id", "piece"), shards).cast("int"))
    rank = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy("piece_len", "id", "piece")) - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_len"))))
    rows = rows.withColumn("rank", rank).withColumn("room", room)
    return rows.select(
        "id", "n", "piece", "piece_len", "bucket_len", "shard",
        F.floor(F.col("rank") / F.col("room")).alias("batch"), (F.col("rank") % F.col("room")).cast("int").alias("slot"), (F.col("bucket_len") - F.col("piece_len")).alias("padding"), *extra,
    )


def pack(sizes: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", max_len: int = 2048, buckets: int = 8, budget: int = 65536, shard_rows: int = 20_000) -> DataFrame:
    """Returns id_col, length_col, piece, piece_len, bucket_len, shard, batch (number inside bucket and shard), slot and padding, one row for each piece."""
    rows = sizes.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{length_col}`"), F.lit(0)).cast("long").alias("n"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / max_len).cast("int") - 1)
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumn("piece_len", F.least(F.lit(max_len), F.col("n") - F.col("piece") * max_len).cast("int"))
    return _batches(rows, buckets, budget, shard_rows, max_len).withColumnsRenamed({"id": id_col, "n": length_col})


def pieces(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048) -> DataFrame:
    """(id, n, piece, piece_len, ids): the token ids of whole texts, cut into pieces of at most max_len; ids packed in 2 bytes each, or 4 where a vocabulary is larger."""
    prepare(docs.sparkSession)

    def work(batches):
        c = codec(path, pattern)
        for b in batches:
            coded = [np.array(c.encode(x or ""), np.uint16 if c.encoding.max_token_value < 1 << 16 else np.int32) for x in b.column("text").to_pylist()]
            if not coded:
                continue
            n = np.array([len(x) for x in coded], np.int64)
            count = np.maximum(-(-n // max_len), 1)  # pieces of each text
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            size = np.minimum(max_len, n[row] - piece * max_len).astype(np.int32)
            ids = packed(np.concatenate(coded), np.cumsum(size, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array(n[row]), pa.array(piece.astype(np.int32)), pa.array(size), ids], ["id", "n", "piece", "piece_len", "ids"])

    rows = columns_of(docs, id=id_col, text=text_col).selectExpr("cast(id as long) id", "text")
    return rows.mapInArrow(work, "id long, n long, piece int, piece_len int, ids binary")


def pack_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048, buckets: int = 8, budget: int = 65536, shard_rows: int = 20_000) -> DataFrame:
    """Encode whole texts, once, and pack their pieces.  Returns what `pack` returns (lengths as n_tokens), and ids, the tokens of the piece."""
    rows = save(pieces(docs, path, pattern, id_col, text_col, max_len), "pieces")
    out = _batches(rows, buckets, budget, shard_rows, max_len)

    def unpack(batches):
        for b in batches:
            size = np.asarray(b.column("piece_len")).astype(np.int64)
            table = pa.Table.from_batches([b.select(["ids"])])
            width = int(unpacked(table, "ids", np.uint8)[1].sum() // max(size.sum(), 1))
            ids = joined(table, "ids", np.int32 if width == 4 else np.uint16).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(ids))
            yield b.set_column(b.schema.get_field_index("ids"), "ids", lists)

    kinds = ", ".join(f"{f.name} {'array<int>' if f.name == 'ids' else f.dataType.simpleString()}" for f in out.schema)
    return out.mapInArrow(unpack, kinds).withColumnsRenamed({"id": id_col, "n": "n_tokens"})
