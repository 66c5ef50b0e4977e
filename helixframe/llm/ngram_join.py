"""Exact Jaccard self-join of documents on word shingles, with prefix filters under several global token orders.

Two sets that overlap enough share a token among the first n - ceil(t n) + 1 tokens of each, under any order of all tokens.  So a pair is
a candidate only if it shares a prefix token under each of ORDERS orders: the pairs found under each are intersected, and only what is
left is verified.  (Before that, pairs go whose sizes, or whose odd sketches, show that they cannot be similar; both tests are exact.)  All orders put shingles of a single set first, then those that sets share, then those that many share; inside these
classes each order has its own hash.  A set with enough shingles of its own then has a prefix that nobody shares, and is done.

The classes come from a first pass over all shingles, kept as two Bloom filters of bounded size.  They are the same for all documents, so
a false positive, or a filter that has reached its bound, makes another order and more candidates, but loses no pair.

Groups of copies: equal sets are one class.  A first round links each class to one pivot for each of its min-hashes, the one with the
smallest id, most often the original; that joins almost all of a group, however large, by about one pair a member.  The exact round then needs only pairs between different components so far,
so it does not emit the pairs within a group.  No link is lost: every pair of classes that passes the filters is either verified or
already connected.

Cases: null and empty texts have an empty set, are linked with nothing and are their own component.  Texts with fewer words than a
shingle are one shingle.  Rows with equal texts are linked.  Rows with a null doc_id are linked like any others, and link others: rows are
told apart by a key of id and text, not by id.  A component's id is its smallest doc_id; it is null only if all its rows have none.  A
doc_id on several rows with different texts stands for each of them.  Similarity at the limit is a link.  An empty table gives no rows.
Very long texts are read whole.  Extra columns are ignored, and kept by `keep_one`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import Bloom, blob_rows, bounds_of, bucket_of, by_group, columns_of, dealt, gather_bloom, groups_of, id_bloom, joined, mix, one_of_each, prepare, save, segment, shuffle_parts, slices, unpacked, without
from helixframe.llm.components import components
from helixframe.llm.wordhash import runs, words

SKETCHES = 4
ORDERS = 3
#: A shingle counts as common from so many postings of the first pass (one or two for each task that has it).
COMMON_FROM = 6
#: Bits of a set's odd sketch: the parity of its shingles by hash.  Two sketches differ in no more bits than their sets in shingles.
SKETCH_BITS = 512
#: Bytes of prefix tokens that one block of the candidate search holds on average.
BLOCK_BYTES = 16 << 20
#: Classes that one task compares with one pivot.
PIVOT_ROWS = 256
#: Shingles that a task holds before it ships them.
FLUSH = 4_000_000
#: Rows by which a task knows repeated ones.
KNOWN_ROWS = 1_000_000


def shingle_sets(data, offsets, k):
    """The sorted distinct shingle hashes of all rows, one after the other, and where each row's begin (one more entry closes the last)."""
    h, row, first = words(data, offsets, fold=True)
    whole, n = runs(h, k), len(offsets) - 1
    parts, count = [], np.zeros(n, np.int64)
    for r in range(n):
        a, b = first[r], first[r + 1]
        if b - a >= k:
            x = whole[a : b - k + 1].copy()
            x.sort()
        elif b > a:
            x = mix(runs(h[a:b], int(b - a)), 1000 + int(b - a))
        else:
            continue
        parts.append(x)
        count[r] = len(x)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    x, row = np.concatenate(parts), np.repeat(np.arange(n), count)
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (row[1:] != row[:-1])])
    return x[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=n))])


def _by_set(reduce, values, at, empty):
    """reduceat over sets, some of them empty."""
    out, some = np.full(len(at) - 1, empty, np.uint64), np.diff(at) > 0
    if some.any():
        out[some] = reduce.reduceat(values, at[:-1][some])
    return out


def set_keys(x, at):
    """One hash of each set."""
    return (_by_set(np.add, mix(x, 3), at, 0) ^ mix(np.diff(at).astype(np.uint64), 4)).view(np.int64)


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 |a and b| >= percent |a or b|, exactly."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _binary(*arrays):
    return [pa.array([x.tobytes()], pa.binary()) for x in arrays]


def _describe(docs: DataFrame, k: int) -> DataFrame:
    """(id, row_key, n, set_key, sketch) of each document."""

    def scan(batches):
        for batch in batches:
            n, key, sketch = [], [], []
            for _, _, data, off in slices(batch, "text"):
                x, at = shingle_sets(data, off, k)
                n.append(np.diff(at).astype(np.int32))
                key.append(set_keys(x, at))
                sketch.append(np.stack([_by_set(np.minimum, mix(x, 200 + j), at, 0) for j in range(SKETCHES)], 1).view(np.int64))
            if n:
                flat = pa.array(np.concatenate(sketch).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SKETCHES, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row_key"), pa.array(np.concatenate(n)), pa.array(np.concatenate(key)), lists], ["id", "row_key", "n", "set_key", "sketch"])

    return docs.mapInArrow(scan, "id long, row_key long, n int, set_key long, sketch array<long>")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of set keys that are similar.  Each pivot a meets its partners in groups of PIVOT_ROWS."""
    spark = pairs.sparkSession
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIVOT_ROWS).cast("int").alias("parts"))
    partner = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("set_key"))
    pivot = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("set_key"))
    need = save(pivot.unionByName(partner).join(classes.select("set_key", "row_key"), "set_key"), "pairs")
    wanted = spark.sparkContext.broadcast(id_bloom(need.select("row_key").distinct(), "row_key"))

    def pick(batches):
        """The texts that are wanted; of rows that repeat both id and text, one for each KNOWN_ROWS."""
        seen = set()
        for batch in batches:
            keys = np.asarray(batch.column("row_key")).astype(np.int64)
            new = wanted.value.has(mix(keys.view(np.uint64)))
            for i in np.flatnonzero(new):
                new[i] = keys[i] not in seen
                seen.add(keys[i])
            seen = seen if len(seen) < KNOWN_ROWS else set()
            yield batch.filter(pa.array(new))

    texts = docs.select("row_key", "text").mapInArrow(pick, "row_key long, text binary")
    laid = need.join(texts, "row_key").select("a", "part", "role", "set_key", "text")
    laid = laid.repartition(shuffle_parts(spark), "a", "part").sortWithinPartitions("a", "part", "role")

    def compare(batches):
        last, pivot = None, None
        for batch in batches:
            a, part, role, keys = (batch.column(c).to_pylist() for c in ("a", "part", "role", "set_key"))
            good, i = [], 0
            for _, _, data, off in slices(batch, "text"):
                x, at = shingle_sets(data, off, k)
                for j in range(len(at) - 1):
                    one = x[at[j] : at[j + 1]]
                    if role[i] == 0:
                        last, pivot = (a[i], part[i]), one.copy()
                    elif last == (a[i], part[i]) and 100 * min(len(one), len(pivot)) >= percent * max(len(one), len(pivot)) and similar(pivot, one, percent):
                        good.append(i)
                    i += 1
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in good], pa.int64()), "b": pa.array([keys[i] for i in good], pa.int64())})

    return laid.mapInArrow(compare, "a long, b long")


class Classes:
    """Class of a shingle: 0 if only one set has it, 1 if several do, 2 if many do."""

    def __init__(self, shared: Bloom, common: Bloom):
        self.shared, self.common = shared, common

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = reduced(mix(x, 6), self.shared.buckets)
        out = self.shared.has(x).astype(np.uint64)
        some = np.flatnonzero(out)
        out[some] += self.common.has(x[some]).astype(np.uint64)
        return out


def reduced(x: np.ndarray, buckets: int) -> np.ndarray:
    """A spread hash as (bucket, 32 more bits) in one value that bucket_of() gives the same bucket."""
    bucket = bucket_of(x, buckets).astype(np.uint64)
    top = ((bucket << np.uint64(32)) + np.uint64(buckets - 1)) // np.uint64(buckets)  # the least high half with this bucket
    return top << np.uint64(32) | (mix(x, 7) & np.uint64(0xFFFFFFFF))


def _classes(docs: DataFrame, k: int, buckets: int) -> Classes:
    """First pass: which shingles distinct sets share."""

    def deal(batches):
        parts, held, seen = [], 0, set()

        def flush():
            t = np.sort(np.concatenate(parts))
            at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            many = np.diff(np.concatenate([at, [len(t)]])) > 1
            t = np.sort(np.concatenate([t[at], t[at][many]]))
            bucket = bucket_of(t, buckets)
            first, _ = bounds_of(bucket)
            low = t & np.uint64(0xFFFFFFFF)
            step = np.diff(low, prepend=low[:1])  # differences by halves: the high ones compress away
            step[first] = low[first]
            yield dealt(bucket, low=step.astype(np.uint16), high=(step >> np.uint64(16)).astype(np.uint16))

        for batch in batches:
            for _, _, data, off in slices(batch, "text"):
                x, at = shingle_sets(data, off, k)
                keys = set_keys(x, at)
                new = np.zeros(len(keys), bool)
                for i, key in enumerate(keys.tolist()):
                    if at[i] < at[i + 1] and key not in seen:
                        seen.add(key)
                        new[i] = True
                t = x if new.all() else x[np.repeat(new, np.diff(at))]
                parts.append(reduced(mix(t, 6), buckets))
                held += len(t)
            if held >= FLUSH:
                yield from flush()
                parts, held, seen = [], 0, set()
        if held:
            yield from flush()

    def build(key, table):
        low, n = unpacked(table, "low", np.uint16)
        t = np.cumsum(low.astype(np.uint64) | joined(table, "high", np.uint16).astype(np.uint64) << np.uint64(16))
        begin = np.cumsum(n) - n
        t = np.sort(t - np.repeat(np.where(begin > 0, t[begin - 1], np.uint64(0)), n))
        at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        count = np.diff(np.concatenate([at, [len(t)]]))
        b = key[0].as_py()
        top = np.uint64(-(-(b << 32) // buckets) << 32)
        t = t[at] | top
        return pa.table({"bucket": pa.array([b], pa.int32()), "shared": pa.array([segment(t[count > 1], buckets)], pa.binary()), "common": pa.array([segment(t[count >= COMMON_FROM], buckets)], pa.binary())})

    steps = docs.select("text").mapInArrow(deal, "bucket int, low binary, high binary")
    rows = by_group(steps, buckets).applyInArrow(build, "bucket int, shared binary, common binary").collect()  # twice BLOOM_BYTES at most
    return Classes(Bloom({r["bucket"]: bytes(r["shared"]) for r in rows}, buckets), Bloom({r["bucket"]: bytes(r["common"]) for r in rows}, buckets))


def _cross_pairs(docs: DataFrame, known: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """Pairs (a, b) of set keys from different components that share a prefix token under each order and may be similar by size."""
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(_classes(docs, k, buckets))

    def pick(batches):
        """The shared part of the prefixes of each set, one order after the other."""
        for batch in batches:
            ids, keys, n, toks, sketches, i = [], [], [], [], [], 0
            all_ids = batch.column("row_key").to_pylist()
            for _, _, data, off in slices(batch, "text"):
                x, at = shingle_sets(data, off, k)
                if not len(x):
                    i += len(at) - 1
                    continue
                kind, sizes = classes.value(x), np.diff(at)
                alone = _by_set(np.add, (kind == 0).astype(np.uint64), at, 0).astype(np.int64)
                set_key = set_keys(x, at)
                for j in np.flatnonzero((sizes > 0) & (alone < prefix_length(sizes, percent))):
                    a, b = at[j], at[j + 1]
                    shared = kind[a:b] > 0
                    one, first, take = x[a:b][shared], kind[a:b][shared] << np.uint64(61), prefix_length(int(sizes[j]), percent) - int(alone[j])
                    found = []
                    for order in range(ORDERS):
                        key = first | mix(one, 100 + order) >> np.uint64(3)
                        found.append(np.partition(key, take - 1)[:take] if take < len(key) else key)
                    odd = np.bincount((mix(x[a:b], 50) & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
                    sketches.append(np.packbits(odd.astype(np.uint8)).tobytes())
                    ids.append(all_ids[i + j])
                    keys.append(int(set_key[j]))
                    n.append(int(sizes[j]))
                    toks.append(np.stack(found).tobytes())
                i += len(at) - 1
            yield pa.RecordBatch.from_pydict({"row_key": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int32()), "set_key": pa.array(keys, pa.int64()), "toks": pa.array(toks, pa.binary()), "sketch": pa.array(sketches, pa.binary())})

    picked = docs.select("row_key", "text").mapInArrow(pick, "row_key long, n int, set_key long, toks binary, sketch binary")
    picked = save(picked.join(known.select("row_key", "comp"), "row_key").select("set_key", "n", "comp", "toks", "sketch"), "prefixes")
    size = picked.agg(F.sum(F.length("toks"))).first()[0] or 0
    blocks = max(8, -(-size // BLOCK_BYTES))
    buckets = max(shuffle_parts(spark), blocks)
    crossing = spark.sparkContext.broadcast(_crossing(picked, buckets))

    def spread(batches):
        """Postings of the tokens that may lead to another component, for sets that have one under each order."""
        for batch in batches:
            per_set = [np.frombuffer(x, np.uint64) for x in batch.column("toks").to_pylist()]
            if not per_set:
                continue
            width = np.array([len(x) // ORDERS for x in per_set])
            t, order, row = _postings(per_set, width)
            some = crossing.value.has(t)
            t, order, row = t[some], order[some], row[some]
            orders = np.zeros((len(per_set), ORDERS), bool)
            orders[row, order] = True
            some = orders.all(1)[row]
            t, order, row = t[some], order[some], row[some]
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(len(per_set), -1)
            cols = {c: np.asarray(batch.column(c)).astype(np.int64) for c in ("set_key", "n", "comp")}
            for b, x in blob_rows(order * blocks + bucket_of(mix(t, 31), blocks), t=t, row=row):
                used, inside = np.unique(x["row"], return_inverse=True)
                blobs = _binary(x["t"], inside.astype(np.uint32), *(v[used] for v in cols.values()), sketch[used])
                yield pa.RecordBatch.from_arrays([pa.array([b // blocks], pa.int32()), pa.array([b % blocks], pa.int32()), *blobs], ["order", "block", "t", "row", "set_key", "n", "comp", "sketch"])

    def pairs(key, table):
        """Pairs of a block under one order, each once, packed by the bucket of a."""
        t, row, i, n, c, sketch, base = [], [], [], [], [], [], 0
        for blob in zip(*(table.column(x).to_pylist() for x in ("t", "row", "set_key", "n", "comp", "sketch"))):
            t.append(np.frombuffer(blob[0], np.uint64))
            row.append(np.frombuffer(blob[1], np.uint32).astype(np.int64) + base)
            for to, x in zip((i, n, c), blob[2:5]):
                to.append(np.frombuffer(x, np.int64))
            sketch.append(np.frombuffer(blob[5], np.uint64).reshape(len(i[-1]), -1))
            base += len(i[-1])
        t, row, i, n, c, sketch = map(np.concatenate, (t, row, i, n, c, sketch))
        by = np.lexsort((i[row], n[row], t))
        t, row = t[by], row[by]
        at = np.concatenate([np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])), [len(t)]])
        lo, hi = np.minimum.reduceat(c[row], at[:-1]), np.maximum.reduceat(c[row], at[:-1])
        found, held = [], 0
        for g in np.flatnonzero(lo != hi):
            r = row[at[g] : at[g + 1]]
            size, comp, top = n[r], c[r], np.searchsorted(n[r], n[r] * 100 // percent, "right")  # sizes that may still match
            for x in range(len(r) - 1):
                other = np.arange(x + 1, top[x])
                other = other[comp[other] != comp[x]]
                if len(other):
                    both = size[x] + size[other]
                    apart = np.bitwise_count(sketch[r[other]] ^ sketch[r[x]]).sum(1, dtype=np.int64)
                    other = other[(100 + percent) * apart <= (100 - percent) * both]
                    if len(other):
                        found.append(np.stack([np.minimum(i[r[x]], i[r[other]]), np.maximum(i[r[x]], i[r[other]])], 1))
                        held += len(other)
            if held > 500_000:
                found, held = [np.unique(np.concatenate(found), axis=0)], 0
        out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        found = dealt(bucket_of(mix(out[:, 0].copy().view(np.uint64), 32), buckets), "to", a=out[:, 0], b=out[:, 1])
        return pa.Table.from_batches([found]).append_column("order", pa.array([key[0].as_py()] * len(found), pa.int32()))

    def intersect(table):
        """The pairs that every order has."""
        every = []
        for order in range(ORDERS):
            part = table.filter(pa.compute.equal(table.column("order"), order))
            every.append(np.unique(np.stack([joined(part, "a", np.int64), joined(part, "b", np.int64)], 1), axis=0))
        out, n = np.unique(np.concatenate(every), axis=0, return_counts=True)
        out = out[n == ORDERS]
        return pa.table({"a": pa.array(out[:, 0].copy()), "b": pa.array(out[:, 1].copy())})

    laid = picked.mapInArrow(spread, "order int, block int, t binary, row binary, set_key binary, n binary, comp binary, sketch binary")
    found = laid.groupBy("order", "block").applyInArrow(pairs, "to int, a binary, b binary, order int")
    return by_group(found, buckets, "to").applyInArrow(intersect, "a long, b long")


def _postings(per_set, width):
    """Token (salted by its order), order and row of each posting."""
    order = np.concatenate([np.repeat(np.arange(ORDERS), w) for w in width])
    row = np.repeat(np.arange(len(per_set)), width * ORDERS)
    flat = np.concatenate(per_set)
    out = np.empty_like(flat)
    for o in range(ORDERS):
        out[order == o] = mix(flat[order == o], 40 + o)
    return out, order, row


def _crossing(picked: DataFrame, buckets: int) -> Bloom:
    """The prefix tokens that sets of different components have.  A task ships two postings for a token at most."""

    def deal(batches):
        ts, cs, held = [], [], 0

        def flush():
            t, c = np.concatenate(ts), np.concatenate(cs)
            by = np.lexsort((c, t))
            t, c = t[by], c[by]
            at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            end = np.concatenate([at[1:], [len(t)]]) - 1
            end = end[c[end] != c[at]]
            t, c = np.concatenate([t[at], t[end]]), np.concatenate([c[at], c[end]])
            yield dealt(bucket_of(t, buckets), t=t, c=c)

        for batch in batches:
            per_set = [np.frombuffer(x, np.uint64) for x in batch.column("toks").to_pylist()]
            if per_set:
                t, _, row = _postings(per_set, np.array([len(x) // ORDERS for x in per_set]))
                ts.append(t)
                cs.append(np.asarray(batch.column("comp")).astype(np.int64)[row])
                held += len(t)
                if held >= FLUSH:
                    yield from flush()
                    ts, cs, held = [], [], 0
        if held:
            yield from flush()

    def build(key, table):
        t, c = joined(table, "t", np.uint64), joined(table, "c", np.int64)
        by = np.argsort(t)
        t, c = t[by], c[by]
        at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        many = np.minimum.reduceat(c, at) != np.maximum.reduceat(c, at)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "segment": pa.array([segment(t[at][many], buckets)], pa.binary())})

    tokens = picked.select("toks", "comp").mapInArrow(deal, "bucket int, t binary, c binary")
    return gather_bloom(by_group(tokens, buckets).applyInArrow(build, "bucket int, segment binary"), buckets)


def _components(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, row_key, n, root, component_id, stands) of rows (id, row_key, text); root, the component's set key, is null for empty sets.

    stands: the row_key of the one row that stands for the component, that with its smallest id.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    sets = save(_describe(rows, k), "sets")

    # Equal sets are one class, and the text of one row is read for it: that with the smallest id, if one has any.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("first")
    classes = sets.where("n > 0").groupBy("set_key").agg(first, F.first("sketch").alias("sketch")).select("set_key", "first.id", "first.row_key", "sketch")
    classes = save(classes, "classes")
    hashed = classes.select("set_key", "id", F.posexplode("sketch").alias("j", "h"))
    least = hashed.groupBy("j", "h").agg(F.min_by("set_key", F.struct(F.col("id").isNull(), "id", "set_key")).alias("a"), F.count("*").alias("many")).where("many > 1").drop("many")
    star = hashed.join(least, ["j", "h"]).where("a != set_key").select("a", F.col("set_key").alias("b")).distinct()
    comp = components(_verified(star, classes, rows, k, percent))
    known = save(classes.join(comp, classes["set_key"] == comp["node"], "left").select("set_key", "id", "row_key", F.coalesce("root", "set_key").alias("comp")), "known")

    cross = _cross_pairs(rows, known, k, percent, groups_of(rows))
    links = known.select(F.col("set_key").alias("a"), F.col("comp").alias("b")).where("a != b").unionByName(_verified(cross, classes, rows, k, percent))
    comp = components(links)
    final = known.join(comp, known["set_key"] == comp["node"], "left").select("set_key", "id", "row_key", F.coalesce("root", "set_key").alias("root"))
    of_root = final.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("first"))
    final = final.join(of_root, "root").select("set_key", "root", F.col("first.id").alias("component_id"), F.col("first.row_key").alias("stands"))
    empty = F.col("n") == 0
    out = sets.drop("sketch").join(final, "set_key", "left")
    return out.select("id", "row_key", "n", F.when(~empty, F.col("root")).alias("root"), F.when(empty, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.when(~empty, F.col("stands")).alias("stands"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = columns_of(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.select("id", F.xxhash64("id", "text").alias("row_key"), "text")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """Returns id_col, n_shingles and component_id, one row for each input row: documents are linked if 100 |A and B| >= percent |A or B|."""
    prepare(docs.sparkSession)
    out = _components(_rows(docs, id_col, text_col), k, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """All columns of the documents that stand for their component, one for each: that with its smallest id.  Documents without words stay.

    Documents that go don't cross a shuffle, nor those that stay, but for a few.
    """
    prepare(docs.sparkSession)
    out = save(_components(_rows(docs, id_col, text_col), k, percent), "components")
    gone = save(out.where("row_key != stands").select("row_key").distinct(), "gone")
    repeated = save(out.where("row_key = stands").groupBy("row_key").agg(F.count("*").alias("rows")).where("rows > 1").select("row_key"), "repeated")
    text = F.col(f"`{text_col}`").cast("binary")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(f"`{id_col}`").cast("long"), text).alias("row_key"))
    kept = without(rows, out.select("row_key"), gone, "row_key", ["row_key"])
    return one_of_each(kept, repeated, "row_key", ["row_key"], F.first("row")).select("row.*")
