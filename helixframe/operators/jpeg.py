"""Marker segments of JPEG bytes, restart numbers and the spans that survive lost chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def markers(files: DataFrame, key: str, data: str, drop_restarts: bool = False) -> DataFrame:
    """(key, offset, marker): every byte FF before another than 00 (two hex digits, upper case)."""
    digits = F.hex(F.col(data).cast("binary"))
    cut = files.select(key, F.posexplode(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))).alias("pos", "b"), digits.alias("_h"))
    rows = cut.where("b = 'FF'").select(key, F.col("pos").cast("long").alias("offset"), F.substring("_h", (F.col("pos") * 2 + 3).cast("int"), F.lit(2)).alias("marker"))
    rows = rows.where("marker NOT IN ('00', '')")
    return rows.where("NOT marker RLIKE '^D[0-7]$'") if drop_restarts else rows


def marker_of_bytes(found: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """(key, start, end, marker): the stretch of bytes that each marker heads, the last up to the file's n_bytes."""
    after = F.lead("offset").over(Window.partitionBy(key).orderBy("offset"))
    return found.join(sizes, key).select(key, F.col("offset").alias("start"), F.coalesce(after, F.col("n_bytes")).alias("end"), "marker")


def restart_numbers(found: DataFrame, key: str) -> DataFrame:
    """(key, offset, scan, number): restart markers numbered through each scan, the number in base eight."""
    by = Window.partitionBy(key).orderBy("offset")
    rows = found.withColumn("scan", F.sum(F.when(F.col("marker") == "DA", 1).otherwise(0)).over(by)).where("marker RLIKE '^D[0-7]$'")
    number = F.row_number().over(Window.partitionBy(key, "scan").orderBy("offset")) - 1
    return rows.select(key, "offset", "scan", F.conv(number.cast("string"), 10, 8).alias("number"))


def valid_spans(flags: DataFrame, key: str, bucket: int = 4096) -> DataFrame:
    """(key, first, last) of the longest stretches of chunks that are all ok: (key, chunk_idx, ok).

    Stretches are found in buckets of chunks first, so that no window sorts a whole file; those that meet at a border are joined.
    """

    def islands(rows: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
        before = F.max(high).over(Window.partitionBy(*by).orderBy(low).rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_new", F.when(before + 1 == F.col(low), 0).otherwise(1))
        rows = rows.withColumn("_no", F.sum("_new").over(Window.partitionBy(*by).orderBy(low)))
        return rows.groupBy(*by, "_no").agg(F.min(low).alias("first"), F.max(high).alias("last"))

    good = flags.where("ok").select(key, "chunk_idx", F.floor(F.col("chunk_idx") / bucket).alias("_b"), F.col("chunk_idx").alias("_end"))
    return islands(islands(good, [key, "_b"], "chunk_idx", "_end"), [key], "first", "last").select(key, "first", "last")


def restart_interval(spark: SparkSession, blocks: int, bytes_per_block: float, chunk: int) -> DataFrame:
    """(interval): the smallest odd number of blocks whose bytes and markers fill two thirds of a chunk; no row if none below 100 does."""
    n = F.floor(F.lit(blocks) / F.col("id"))
    digits = F.when(n > 1, _octal_digits(n)).otherwise(1.0)
    rows = spark.range(1, 100, 2).where(F.ceil(F.lit(bytes_per_block) * F.col("id")) + 2 * digits > 0.66 * chunk)
    return rows.agg(F.min("id").alias("interval")).where("interval IS NOT NULL")


def _octal_digits(n):
    """Mean number of octal digits of 0 .. n - 1: one each, and one more for those from each power of eight on."""
    more = sum((F.greatest(n - 8**i, F.lit(0)) for i in range(1, 11)), F.lit(0))
    return (n + more) / n
