"""Exact deduplication over a bucketed cuckoo-filter index of live content digests.

Rows are dealt to buckets by the SHA-256 of their normalised text.  A bucket inserts the digests into a cuckoo filter, with the digests
themselves stored beside it: when an insertion finds no free slot, the filter is rebuilt at twice the size from the stored keys.  A digest
that the filter does not know is new, and its content is never moved.  Hits are verified: the contents of digests that were hit (and the
few that a bounded Bloom filter over them lets through) are dealt to buckets in order of digest and compared byte by byte.

`replay` runs insertions and deletions in order over the same index, which then also keeps the contents of its bucket.  Deleting the last
copy of a text takes its fingerprint out of the filter.

Hot groups: each task first runs the index over its own rows, so a text crosses the shuffle once for each task that has it, not once for
each copy.

Cases: a null text counts as empty.  Null doc_ids take part; a group keeps a null id only if it has no other.  Rows that repeat the doc_id
that stays all have kept = true in `mark`; `deduplicate` leaves one of them.  An empty table gives no rows.  Texts of any length are
compared whole.  Extra columns are ignored by `mark` and kept by `deduplicate`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import MOST_TASKS, SPACE, columns_of, groups_of, id_bloom, mix, one_of_each, prepare, save, shuffle_parts, without

SLOTS, MAX_KICKS = 4, 200
#: Bytes of content, and number of digests, that a task holds before it ships them.
HELD_BYTES, HELD_DIGESTS = 64 << 20, 500_000


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four slots; each has two places, either found from the other.  Keys are byte digests."""

    def __init__(self, places: int = 64):
        self.places, self.count = places, 0
        self.table = [0] * (places * SLOTS)

    def _spots(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & (self.places - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return place ^ (mark * 0x5BD1E995 & (self.places - 1))

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._spots(digest)
        return mark in self.table[a * SLOTS : a * SLOTS + SLOTS] or mark in self.table[b * SLOTS : b * SLOTS + SLOTS]

    def _put(self, place: int, mark: int) -> bool:
        for i in range(place * SLOTS, place * SLOTS + SLOTS):
            if not self.table[i]:
                self.table[i] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False on overflow; the filter may then have lost another key's mark and must be rebuilt."""
        mark, a, b = self._spots(digest)
        self.count += 1
        if self._put(a, mark) or self._put(b, mark):
            return True
        place = a if mark & 1 else b
        for kick in range(MAX_KICKS):
            at = place * SLOTS + (mark + kick) % SLOTS
            mark, self.table[at] = self.table[at], mark
            place = self._other(place, mark)
            if self._put(place, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Only for digests that were inserted."""
        mark, a, b = self._spots(digest)
        for place in (a, b):
            for i in range(place * SLOTS, place * SLOTS + SLOTS):
                if self.table[i] == mark:
                    self.table[i] = 0
                    self.count -= 1
                    return True
        return False


class CuckooIndex:
    """Live texts of one bucket.  Each entry: [content, smallest id, number of rows, digest]."""

    def __init__(self, places: int = 64):
        self.filter = CuckooFilter(places)
        self.stored: dict[bytes, list[list]] = {}
        self.resizes = self.look_ups = 0

    def _resize(self) -> None:
        places = self.filter.places
        while True:
            places *= 2
            self.resizes += 1
            self.filter = CuckooFilter(places)
            if all(self.filter.insert(d) for d, entries in self.stored.items() for _ in entries):
                return

    def find(self, digest: bytes, content: bytes) -> list | None:
        if digest not in self.filter:
            return None
        self.look_ups += 1
        return next((e for e in self.stored.get(digest, ()) if e[0] == content), None)

    def insert(self, digest: bytes, content: bytes, doc_id: int | None, rows: int = 1) -> bool:
        """True if the text is new."""
        if entry := self.find(digest, content):
            entry[1] = doc_id if entry[1] is None else entry[1] if doc_id is None else min(entry[1], doc_id)
            entry[2] += rows
            return False
        self.stored.setdefault(digest, []).append([content, doc_id, rows, digest])
        if self.filter.count >= self.filter.places * SLOTS or not self.filter.insert(digest):
            self._resize()
        return True

    def delete(self, digest: bytes, content: bytes, rows: int = 1) -> bool:
        """Take rows of a text out; True if none is left.  KeyError if the text isn't there."""
        entry = self.find(digest, content)
        if entry is None:
            raise KeyError(digest.hex())
        entry[2] -= rows
        if entry[2] > 0:
            return False
        self.stored[digest].remove(entry)
        if not self.stored[digest]:
            del self.stored[digest]
        self.filter.delete(digest)
        return True

    def entries(self):
        for found in self.stored.values():
            yield from found


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _hits(keys: DataFrame, parts: int) -> DataFrame:
    """(digest) of those that more than one row may have: a bucket's filter knew them already."""

    def local(batches):
        """Each digest once, and whether this task has it again."""
        counts: dict[bytes, int] = {}
        for b in batches:
            for d in b.column("digest").to_pylist():
                counts[d] = counts.get(d, 0) + 1
            if len(counts) > HELD_DIGESTS:
                yield shipped(counts)
                counts = {}
        yield shipped(counts)

    def shipped(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array([n > 1 for n in counts.values()], pa.bool_())], ["digest", "again"])

    def hit(batches):
        index, told = CuckooIndex(), set()
        for b in batches:
            out = []
            for d, again in zip(b.column("digest").to_pylist(), b.column("again").to_pylist()):
                if (d in index.filter or again) and d not in told:
                    told.add(d)
                    out.append(d)
                if d not in index.stored:
                    index.insert(d, b"", None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["digest"])

    return keys.select("digest").mapInArrow(local, "digest binary, again boolean").repartition(parts, "digest").mapInArrow(hit, "digest binary")


def _parts(docs: DataFrame, text_col: str) -> int:
    """Buckets, each of GROUP_BYTES of text on average up to MOST_TASKS."""
    return min(groups_of(docs, f"`{text_col}`"), max(MOST_TASKS, shuffle_parts(docs.sparkSession)))


def _head() -> Column:
    """The first bytes of a digest as a number."""
    return F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")


def _groups(rows: DataFrame, keys: DataFrame, parts: int) -> DataFrame:
    """(digest, check, keep_id, group_size, keepers) of each text that more than one row has; keepers: rows that have keep_id."""
    spark = prepare(rows.sparkSession)
    hits = save(_hits(keys, parts).select("digest", _head().alias("head")), "hits")
    wanted = spark.sparkContext.broadcast(id_bloom(hits, "head"))
    kind = "digest binary, check long, content binary, id long, rows long, keepers long"
    names = [c.split()[0] for c in kind.split(", ")]

    def shipped(entries):
        cols = list(zip(*entries)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names)

    def add(found, digest, check, content, doc_id, n, keepers):
        """found: digest to its contents, each [content, check, smallest id, rows, rows with it]."""
        entry = next((e for e in found.setdefault(digest, []) if e[0] == content), None)
        if entry is None:
            found[digest].append([content, check, doc_id, n, keepers])
            return len(content) + 100
        entry[3] += n
        if entry[2] == doc_id:
            entry[4] += keepers
        elif doc_id is not None and (entry[2] is None or doc_id < entry[2]):
            entry[2], entry[4] = doc_id, keepers
        return 0

    def flat(found):
        return [(d, check, content, doc_id, n, keepers) for d, entries in found.items() for content, check, doc_id, n, keepers in entries]

    def local(batches):
        found, size = {}, 0
        for b in batches:
            heads = np.asarray(b.column("head")).astype(np.int64)
            b = b.filter(pa.array(wanted.value.has(mix(heads.view(np.uint64)))))
            for digest, check, content, doc_id in zip(*(b.column(c).to_pylist() for c in ("digest", "check", "content", "id"))):
                size += add(found, digest, check, content, doc_id, 1, 1)
            if size > HELD_BYTES:
                yield from parts_of(flat(found))
                found, size = {}, 0
        yield from parts_of(flat(found))

    def parts_of(entries):
        for a in range(0, len(entries), 1000):
            yield shipped(entries[a : a + 1000])

    def verify(batches):
        """Rows come in order of digest, so only the contents of one digest are held."""
        found, many = {}, []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in names)):
                if row[0] not in found:
                    many += [x for x in flat(found) if x[4] > 1]
                    found = {}
                add(found, *row)
            yield shipped([(d, check, None, *rest) for d, check, _, *rest in many])
            many = []
        yield shipped([(d, check, None, *rest) for d, check, _, *rest in flat(found) if rest[1] > 1])

    met = rows.withColumn("head", _head()).select("digest", "check", "content", "id", "head").mapInArrow(local, kind)
    met = met.repartition(parts, "digest").sortWithinPartitions("digest").mapInArrow(verify, kind)
    return met.select("digest", "check", F.col("id").alias("keep_id"), F.col("rows").alias("group_size"), "keepers")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the digest of their content, and a second hash: content decides, so equal digests of other contents stay apart."""
    return rows.withColumn("digest", F.unhex(F.sha2("content", 256))).withColumn("check", F.xxhash64("content"))


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, keep_id, group_size, kept and text_sha256, one row for each input row."""
    prepare(docs.sparkSession)
    rows = _keyed(columns_of(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), normalised(F.col("text")).cast("binary").alias("content")))
    keys = save(rows.select("id", "digest", "check"), "digests")
    out = keys.join(_groups(rows, keys, _parts(docs, text_col)), ["digest", "check"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each text, with all their columns.  What goes and what stays is decided by keys; texts that go don't move."""
    prepare(docs.sparkSession)
    exact = ["id", "digest", "check"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), normalised(F.col(f"`{text_col}`")).cast("binary").alias("content"))
    rows = _keyed(rows).withColumn("key", F.xxhash64(*exact))
    keys = save(rows.select("key", *exact), "digests")
    groups = save(_groups(rows.select("id", "content", "digest", "check"), keys.select("digest"), _parts(docs, text_col)).select("digest", "check", "keep_id", "keepers"), "groups")
    met = keys.join(groups, ["digest", "check"])
    gone = save(met.where("NOT id <=> keep_id").select("key", *exact).distinct(), "gone")
    repeated = save(met.where("id <=> keep_id AND keepers > 1").select("key", *exact).distinct(), "repeated")
    kept = without(rows.select("row", "key", *exact), keys, gone, "key", exact)
    return one_of_each(kept, repeated, "key", exact, F.min_by("row", F.sha2(F.col(f"row.`{text_col}`").cast("binary"), 256))).select("row.*")


def replay(changes: DataFrame, seq_col: str = "seq", op_col: str = "op", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Insertions and deletions of live texts in order of seq: returns seq, op and done, one row for each change.

    done: of an `insert`, whether the text was not live yet; of a `delete`, whether it was, and this was its last copy.  Deleting a text that
    is not live does nothing; other operations are ignored, as are rows with a null seq.  All changes of a bucket pass through one index,
    which holds its live contents; buckets have GROUP_BYTES of text on average.
    """
    prepare(changes.sparkSession)
    rows = columns_of(changes, seq=seq_col, op=op_col, id=id_col, text=text_col).where("seq IS NOT NULL AND op IN ('insert', 'delete')")
    rows = rows.select(F.col("seq").cast("long"), "op", F.col("id").cast("long"), normalised(F.col("text")).cast("binary").alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))
    parts = _parts(changes, text_col)

    def run(batches):
        index = CuckooIndex()
        for b in batches:
            done = []
            for op, doc_id, content, digest in zip(*(b.column(c).to_pylist() for c in ("op", "id", "content", "digest"))):
                done.append(index.insert(digest, content, doc_id) if op == "insert" else index.find(digest, content) is not None and index.delete(digest, content))
            yield pa.RecordBatch.from_arrays([b.column("seq"), b.column("op"), pa.array(done, pa.bool_())], ["seq", "op", "done"])

    out = rows.repartition(parts, "digest").sortWithinPartitions("seq").mapInArrow(run, "seq long, op string, done boolean")
    return out.withColumnsRenamed({"seq": seq_col, "op": op_col})
