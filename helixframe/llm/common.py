"""What the operators share: the shared folder, shipping of the package, packed arrays keyed by bucket, and a bounded Bloom filter."""

from __future__ import annotations

import io
import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT, PACKAGE = str(Path(__file__).resolve().parents[2]), __name__.split(".")[0]
_SHIPPED = f"{PACKAGE}_shipped.zip"
SPACE = r"[\x20\x09-\x0D]+"
#: A Bloom filter never takes more than this on the driver or an executor; a fuller one only lets more rows through.
BLOOM_BYTES = 1 << 26
#: Bytes of text that one slice of an Arrow batch holds at most, unless a single row is longer.
SLICE_BYTES = 1 << 20
#: Bytes of text whose entries one group of a Python aggregation holds on average.
GROUP_BYTES = 16 << 20
#: Tasks that groups are dealt to at most; beyond it a task takes several groups, one after the other.
MOST_TASKS = 20_000
#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = "8m"
_thread = threading.local()


def _written() -> list[str]:
    """Tables that save() wrote in this thread and that are still there, in order; so runs beside each other don't meet."""
    if not hasattr(_thread, "written"):
        _thread.written = []
    return _thread.written


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches small enough for long texts.

    On one machine workers find the package where it lies; to the executors of a cluster it is shipped, once for each context.
    """
    context = spark.sparkContext
    if is_local(spark):
        env = context.environment
        paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
        if ROOT not in paths:
            env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    elif not any(x.endswith("/" + _SHIPPED) for x in context.listFiles):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as out:
            for path in sorted((Path(ROOT) / PACKAGE).rglob("*.py")):
                out.write(path, path.relative_to(ROOT).as_posix())
        path = Path(tempfile.mkdtemp()) / _SHIPPED  # read by the driver's file server alone
        path.write_bytes(data.getvalue())
        context.addPyFile(str(path))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where all is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints/helixframe"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    _written().append(path)
    return out


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written().remove(where)


def drop(df: DataFrame) -> None:
    """Delete a table that save() wrote, once nothing reads it any more."""
    _delete(df.sparkSession, df.saved_at)


def drop_others(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Delete all tables that save() wrote after the first `since`, except those given."""
    for path in [x for x in _written()[since:] if x not in {k.saved_at for k in kept}]:
        _delete(spark, path)


def written() -> int:
    """How many tables of this thread's save() there are."""
    return len(_written())


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def columns_of(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under names of our own, so that extra columns never clash.  Keyword: our name; value: theirs."""
    return df.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in wanted.items()])


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads its input (splitmix finaliser)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the high half of a well-spread 64-bit value."""
    return (((x >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a batch into row ranges of at most `limit` bytes of a binary column.

    Yields (first row, one past the last row, bytes as uint8, offsets from 0); a null counts as empty.
    """
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return
    if col.null_count:
        col = col.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    _, off, data = col.buffers()
    off = np.frombuffer(off, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n), data[off[a] : off[min(b, n)]], off[a : min(b, n) + 1] - off[a]
        a = min(b, n)


def groups_of(rows: DataFrame, column: str = "text") -> int:
    """How many groups to deal a table to, so that each has GROUP_BYTES of a column's bytes on average, whatever the size of the table."""
    size = rows.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(shuffle_parts(rows.sparkSession), -(-size // GROUP_BYTES))


def by_group(df: DataFrame, groups: int, column: str = "bucket"):
    """The table grouped by a column of `groups` values; a task has one group, or as many as keep the number of tasks under MOST_TASKS."""
    return df.repartition(min(groups, max(MOST_TASKS, shuffle_parts(df.sparkSession))), column).groupBy(column)


def packed(values: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """The bytes of consecutive parts of an array; part i ends before ends[i]."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * int(np.prod(values.shape[1:]))
    offsets = (np.concatenate([[0], ends]) * width).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def bounds_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and where it ends."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return at, np.concatenate([at[1:], [len(sorted_keys)]])


def dealt(bucket: np.ndarray, name: str = "bucket", **arrays: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket that occurs: its number, and the entries of parallel arrays as one binary value each."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at, ends = bounds_of(bucket)
    return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), *(packed(v[order], ends) for v in arrays.values())], [name, *arrays])


def blob_rows(bucket: np.ndarray, **arrays: np.ndarray):
    """Each bucket that occurs, with its entries of parallel arrays."""
    order = np.argsort(bucket, kind="stable")
    bucket, arrays = bucket[order], {k: v[order] for k, v in arrays.items()}
    for a, b in zip(*bounds_of(bucket)):
        yield int(bucket[a]), {k: v[a:b] for k, v in arrays.items()}


def unpacked(table: pa.Table, column: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays as one array, and how many each row has."""
    parts, counts = [], []
    for x in table.column(column).chunks:
        if len(x):
            off = np.frombuffer(x.buffers()[1], np.int64 if pa.types.is_large_binary(x.type) else np.int32)[x.offset : x.offset + len(x) + 1]
            data = x.buffers()[2]
            parts.append(np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind) if data is not None and off[-1] > off[0] else np.zeros(0, kind))
            counts.append(np.diff(off).astype(np.int64) // np.dtype(kind).itemsize)
    return (np.concatenate(parts), np.concatenate(counts)) if parts else (np.zeros(0, kind), np.zeros(0, np.int64))


def joined(table: pa.Table, column: str, kind) -> np.ndarray:
    """All blobs of a column as one array."""
    return unpacked(table, column, kind)[0]


def segment(shared: np.ndarray, buckets: int) -> bytes:
    """A bucket's part of a Bloom filter over the given distinct hashes: about 10 bits each, within the bucket's share of BLOOM_BYTES."""
    size = 64
    while size < 10 * len(shared) and size * 2 <= BLOOM_BYTES * 8 // buckets:
        size *= 2
    bits = np.zeros(size, np.uint8)
    for salt in (11, 12, 13):
        bits[(mix(shared, salt) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Bloom:
    """The segments of all buckets, laid end to end; pickles small and tests whole arrays at once."""

    def __init__(self, parts: dict[int, bytes], buckets: int):
        self.buckets = buckets
        sizes = np.array([len(parts.get(b, b"\0" * 8)) for b in range(buckets)], np.int64)
        self.bytes = np.frombuffer(b"".join(parts.get(b, b"\0" * 8) for b in range(buckets)), np.uint8)
        self.first, self.mask = np.concatenate([[0], np.cumsum(sizes)[:-1]]), (sizes * 8 - 1).astype(np.uint64)

    def has(self, x: np.ndarray) -> np.ndarray:
        b = bucket_of(x, self.buckets)
        first, mask, out = self.first[b], self.mask[b], np.ones(len(x), bool)
        for salt in (11, 12, 13):
            at = (mix(x, salt) & mask).astype(np.int64)
            out &= (self.bytes[first + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def gather_bloom(parts: DataFrame, buckets: int) -> Bloom:
    """Collect (bucket, segment) rows: BLOOM_BYTES in all at most, whatever the size of the input."""
    return Bloom({r["bucket"]: bytes(r["segment"]) for r in parts.collect()}, buckets)


def id_bloom(ids: DataFrame, column: str) -> Bloom:
    """A bounded Bloom filter over a bigint column."""
    spark = prepare(ids.sparkSession)
    buckets = max(shuffle_parts(spark), -(-8 * ids.count() // GROUP_BYTES))

    def deal(batches):
        for batch in batches:
            x = mix(np.asarray(batch.column(0)).astype(np.int64).view(np.uint64))
            if len(x):
                yield dealt(bucket_of(x, buckets), x=x)

    def build(key, table):
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "segment": pa.array([segment(np.unique(joined(table, "x", np.uint64)), buckets)], pa.binary())})

    rows = ids.where(F.col(column).isNotNull()).select(column).mapInArrow(deal, "bucket int, x binary")
    return gather_bloom(by_group(rows, buckets).applyInArrow(build, "bucket int, segment binary"), buckets)


def may_be_in(keys: DataFrame, column: str):
    """A column function over bigints: false only for those that a table's column surely lacks.  Only these numbers go to Python."""
    found = keys.sparkSession.sparkContext.broadcast(id_bloom(keys, column))

    @F.pandas_udf("boolean")
    def test(x: pd.Series) -> pd.Series:
        some = x.notna().to_numpy()
        out = np.zeros(len(x), bool)
        out[some] = found.value.has(mix(x[some].to_numpy(np.int64).view(np.uint64)))
        return pd.Series(out)

    return test


def _equal(a: DataFrame, b: DataFrame, columns: list[str]):
    out = a[columns[0]].eqNullSafe(b[columns[0]])
    for c in columns[1:]:
        out &= a[c].eqNullSafe(b[c])
    return out


def without(rows: DataFrame, keys: DataFrame, gone: DataFrame, key: str, exact: list[str]) -> DataFrame:
    """The rows whose columns `exact` are not in `gone`, without moving those that go, nor those that surely stay.

    key: a bigint column of all three that follows from `exact`.  keys has key and exact of all rows, so that the rows which a bounded filter
    holds back by mistake are found by their keys alone; only these cross a shuffle.
    """
    test = may_be_in(gone, key)
    held = keys.where(test(F.col(key))).select(*dict.fromkeys([key, *exact])).distinct()
    mistaken = save(held.join(gone, _equal(held, gone, exact), "left_anti"), "mistaken")
    out = rows.where(~test(F.col(key)))
    if mistaken.isEmpty():
        return out
    some = rows.where(test(F.col(key)) & may_be_in(mistaken, key)(F.col(key)))
    return out.unionAll(some.join(mistaken, _equal(some, mistaken, exact), "left_semi"))


def one_of_each(rows: DataFrame, repeated: DataFrame, key: str, exact: list[str], choose) -> DataFrame:
    """The rows, but of those whose columns `exact` are in `repeated` one for each: `choose` is an aggregate that gives its column `row`."""
    if repeated.isEmpty():
        return rows
    test = may_be_in(repeated, key)
    some = rows.where(test(F.col(key)))
    others = some.join(repeated, _equal(some, repeated, exact), "left_anti")
    one = some.join(repeated, _equal(some, repeated, exact), "left_semi").groupBy(key, *[c for c in exact if c != key]).agg(choose.alias("row"))
    return rows.where(~test(F.col(key))).unionAll(others).unionByName(one.select(*rows.columns))
