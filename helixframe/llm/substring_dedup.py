"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the ANCHOR_WORDS-word runs in a window of `length` words, the one with the smallest hash.  Equal windows have
equal anchors at equal places, so documents that share a window have postings of the same anchor.  Postings are dealt to groups by their
anchor; there a posting meets those of smaller documents and is extended over the words to its left and right: once for each of the windows
whose anchor it is, by the anchor's hash and the window's together.  (Two different windows are taken for equal only if both 64-bit
hashes agree.)  Extended seeds go back to their rows, where neighbours on one diagonal, that is with the same distance to the same smaller
document, make one maximal repeat of at least `length` words.

Hot passages: a task settles its own postings first and ships a passage only as its smallest document has it; all others are extended where
they are read.  So a passage in a third of all documents costs a posting for each task, and no pairs of documents are made.

Groups hold the postings of GROUP_BYTES of text on average, so a larger table has more groups, not larger ones.

Work saver: a first pass over the anchors alone finds those that two documents have, as a Bloom filter of bounded size; postings of other
anchors need not be shipped.  No result depends on it: a filter that has reached its bound lets more postings through, at most all.

Cases: null and empty texts, and texts shorter than a window, have no repeats.  Rows with a null doc_id are never marked and never mark
others.  Rows with equal doc_id, or repeated ones, are each judged by themselves, against smaller ids only.  Of several places in smaller
documents the first of the smallest id that a seed met is reported.  Texts of any length are read whole, an empty table gives no rows,
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import Bloom, bounds_of, bucket_of, by_group, columns_of, dealt, gather_bloom, groups_of, joined, mix, packed, prepare, segment, slices, unpacked
from helixframe.llm.wordhash import runs, sliding_min, words

ANCHOR_WORDS = 5
#: Windows that a task holds before it settles and ships them.
FLUSH = 2_000_000
_SEEDS = "bucket int, anchor binary, win binary, row binary, at binary, ids binary, keys binary"
_MET = "to int, id binary, row_key binary, at binary, of binary, shift binary"
_REPEATS = "array<struct<start:int,end:int,of:bigint,of_start:int>>"


def _windows(data, offsets, length):
    """Row, position, hash and anchor of each window of `length` words."""
    h, row, first = words(data, offsets, fold=False)
    whole = runs(h, length)
    n = len(whole)
    if not n:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    anchor = mix(sliding_min(runs(h, ANCHOR_WORDS), length - ANCHOR_WORDS + 1)[:n], 5)
    one = np.flatnonzero(row[:n] == row[length - 1 :])
    return row[one], one - first[row[one]], whole[one], anchor[one]


def _extended(anchor, win, ids, at):
    """Order by anchor, window and id; which entries of it have a smaller id before them, and the first entry of each one's seed."""
    order = np.lexsort((ids, win, anchor))
    a, w = anchor[order], win[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])])
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order, ids[order] > ids[first], first


def _met(to, ids, keys, at, of, shift) -> pa.RecordBatch:
    return dealt(to, "to", id=ids, row_key=keys, at=at.astype(np.uint32), of=of, shift=shift.astype(np.int32))


def shared_anchors(docs: DataFrame, length: int, groups: int) -> Bloom:
    """The anchors that windows of two documents have.  A task ships an anchor once, or twice if two documents there have it."""

    def deal(batches):
        seen, rows, base, held = [], [], 0, 0

        def flush():
            a, r = np.concatenate(seen), np.concatenate(rows)
            order = np.argsort(a, kind="stable")
            a, r = a[order], r[order]
            at, end = bounds_of(a)
            again = np.minimum.reduceat(r, at) != np.maximum.reduceat(r, at)
            a = np.concatenate([a[at], a[at][again]])
            return dealt(bucket_of(a, groups), a=a)

        for batch in batches:
            for a, b, data, off in slices(batch, "text"):
                row, _, _, anchor = _windows(data, off, length)
                if len(anchor):
                    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
                    seen.append(anchor[new])
                    rows.append(row[new] + base)
                    held += len(new)
                base += b - a
            if held >= FLUSH:
                yield flush()
                seen, rows, held = [], [], 0
        if held:
            yield flush()

    def build(key, table):
        a = np.sort(joined(table, "a", np.uint64))
        same = np.concatenate([a[1:] == a[:-1], [False]])
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "segment": pa.array([segment(np.unique(a[same]), groups)], pa.binary())})

    found = docs.where("id IS NOT NULL").select("text").mapInArrow(deal, "bucket int, a binary")
    return gather_bloom(by_group(found, groups).applyInArrow(build, "bucket int, segment binary"), groups)


def repeats(docs: DataFrame, length: int) -> DataFrame:
    """(id, row_key, repeats) of the rows (id, row_key, text) that have a window that also starts in a document with a smaller id."""
    spark = prepare(docs.sparkSession)
    groups = groups_of(docs)
    shared = spark.sparkContext.broadcast(shared_anchors(docs, length, groups))

    def deal(batches):
        """Postings by the group of their anchor; with no anchor: windows that are settled here, by the group of their row."""
        held = {c: [] for c in ("anchor", "win", "row", "at", "ids", "keys")}
        n = base = 0

        def flush():
            anchor, win, row, at, ids, keys = (np.concatenate(held[c]) for c in held)
            for x in held.values():
                x.clear()
            order, late, first = _extended(anchor, win, ids[row], at)
            near = np.flatnonzero(late)
            near = near[np.argsort(order[near], kind="stable")]  # back to the order of rows and places: neighbours compress
            mine, other = order[near], first[near]
            if len(mine):
                r = row[mine]
                met = _met(bucket_of(mix(keys[r].view(np.uint64), 21), groups), ids[r], keys[r], at[mine], ids[row[other]], at[other] - at[mine])
                yield pa.RecordBatch.from_arrays([met.column(c) for c in ("to", "of", "shift", "at", "id", "row_key")] + [pa.array([None] * len(met), pa.binary())], ["bucket", "ids", "at", "row", "win", "keys", "anchor"]).select(["bucket", "anchor", "win", "row", "at", "ids", "keys"])
            rest = np.sort(order[~late])
            bucket = bucket_of(anchor[rest], groups)
            rest = rest[np.argsort(bucket, kind="stable")]
            bucket, r = bucket_of(anchor[rest], groups), row[rest]
            b_at, b_end = bounds_of(bucket)
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (bucket[1:] != bucket[:-1])])
            inside = np.cumsum(new) - 1  # a row's number among those of all groups
            used, use_end = np.flatnonzero(new), inside[b_end - 1] + 1
            inside -= np.repeat(np.concatenate([[0], use_end[:-1]]), b_end - b_at)
            cols = [packed(x, e) for x, e in ((anchor[rest], b_end), (win[rest], b_end), (inside.astype(np.uint32), b_end), (at[rest].astype(np.uint32), b_end), (ids[r[used]], use_end), (keys[r[used]], use_end))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[b_at].astype(np.int32)), *cols], ["bucket", "anchor", "win", "row", "at", "ids", "keys"])

        for batch in batches:
            held["ids"].append(np.asarray(batch.column("id")).astype(np.int64))
            held["keys"].append(np.asarray(batch.column("row_key")).astype(np.int64))
            for a, _, data, off in slices(batch, "text"):
                row, at, win, anchor = _windows(data, off, length)
                keep = np.flatnonzero(shared.value.has(anchor))
                for c, x in (("anchor", anchor[keep]), ("win", win[keep]), ("row", (row[keep] + a + base).astype(np.int32)), ("at", at[keep].astype(np.int32))):
                    held[c].append(x)
                n += len(keep)
            base += batch.num_rows
            if n >= FLUSH:
                yield from flush()
                held, n, base = {c: [] for c in held}, 0, 0
        if n:
            yield from flush()

    def extend(table):
        """Windows that start in a smaller document, by the group of their row."""
        here = pa.compute.is_null(table.column("anchor"))
        passed, table = table.filter(here), table.filter(pa.compute.invert(here))
        out = [[joined(passed, c, k) for c, k in (("win", np.int64), ("keys", np.int64), ("row", np.uint32), ("ids", np.int64), ("at", np.int32))]]
        anchor, win, at = joined(table, "anchor", np.uint64), joined(table, "win", np.uint64), joined(table, "at", np.uint32)
        row, n = unpacked(table, "row", np.uint32)
        ids, used = unpacked(table, "ids", np.int64)
        keys, row = joined(table, "keys", np.int64), row + np.repeat(np.cumsum(used) - used, n)
        if len(row):
            order, late, first = _extended(anchor, win, ids[row], at)
            mine, other = order[late], first[late]
            out.append([ids[row[mine]], keys[row[mine]], at[mine], ids[row[other]], (at[other].astype(np.int64) - at[mine]).astype(np.int32)])
        ids, keys, at, of, shift = map(np.concatenate, zip(*out))
        order = np.lexsort((at, keys))
        to = bucket_of(mix(keys.view(np.uint64), 21), groups)
        return pa.Table.from_batches([_met(to[order], ids[order], keys[order], at[order], of[order], shift[order])])

    def join_up(table):
        """One row for each input row that has a repeat: neighbours on one diagonal are one repeat."""
        ids, keys, at, of, shift = (joined(table, c, k) for c, k in (("id", np.int64), ("row_key", np.int64), ("at", np.uint32), ("of", np.int64), ("shift", np.int32)))
        at = at.astype(np.int64)
        order = np.lexsort((at, shift, of, ids, keys))
        ids, keys, at, of, shift = ids[order], keys[order], at[order], of[order], shift[order]
        same = lambda x: x[1:] == x[:-1]
        other_row = np.concatenate([[True], ~(same(keys) & same(ids))])
        begin = np.flatnonzero(other_row | np.concatenate([[True], ~(same(of) & same(shift) & (at[1:] <= at[:-1] + 1))]))  # repeated rows: equal entries
        end = at[np.concatenate([begin[1:], [len(at)]]) - 1] + length if len(at) else np.zeros(0, np.int64)
        rows = np.flatnonzero(other_row[begin])
        fields = [pa.array(x, t) for x, t in ((at[begin], pa.int32()), (end, pa.int32()), (of[begin], pa.int64()), (at[begin] + shift[begin], pa.int32()))]
        found = pa.ListArray.from_arrays(pa.array(np.concatenate([rows, [len(begin)]]).astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "end", "of", "of_start"]))
        return pa.table([pa.array(ids[begin[rows]]), pa.array(keys[begin[rows]]), found], ["id", "row_key", "repeats"])

    seeds = docs.where("id IS NOT NULL").select("id", "row_key", "text").mapInArrow(deal, _SEEDS)
    met = by_group(seeds, groups).applyInArrow(extend, _MET)
    return by_group(met, groups, "to").applyInArrow(join_up, f"id long, row_key long, repeats {_REPEATS}")


def _covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n words lie in one of the given stretches."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:n]) > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13) -> DataFrame:
    """Maximal repeats of at least `length` words, and the texts without them.

    Returns id_col, n_words, n_removed, spans (array of start and end word, end exclusive: what repeats cover), repeats (array of start and
    end, the smaller document and the start there) and kept (the words that stay, joined by one space), one row for each input row.
    """
    if length <= ANCHOR_WORDS:
        raise ValueError(f"length must be over {ANCHOR_WORDS}")
    prepare(docs.sparkSession)
    rows = columns_of(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("id", "text"))
    out = rows.join(repeats(rows, length), ["id", "row_key"], "left").select("id", "text", "repeats")

    def cut(batches):
        for batch in batches:
            n_words, n_removed, spans, kept = [], [], [], []
            found = batch.column("repeats")
            stretches = found.flatten()
            start, end = (np.asarray(stretches.field(i)) for i in (0, 1))
            last = np.cumsum(pa.compute.list_value_length(found).fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            a = 0
            for text, b in zip(batch.column("text").to_pylist(), last):
                w = (text or b"").split()
                gone, where = 0, []
                n_words.append(len(w))
                if a < b:
                    bad = _covered(len(w), start[a:b], end[a:b])
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], bad.astype(np.int8), [0]])))
                    where = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])]
                    gone = int(bad.sum())
                    w = [x for x, y in zip(w, bad.tolist()) if not y]
                a = b
                n_removed.append(gone)
                spans.append(where)
                kept.append(b" ".join(w).decode("utf-8", "replace"))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, kind), "repeats": found, "kept": pa.array(kept, pa.string())})

    out = out.mapInArrow(cut, f"id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, repeats {_REPEATS}, kept string")
    return out.withColumnRenamed("id", id_col)
