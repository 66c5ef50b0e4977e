"""Tables in one global order: numbered rows, sorted merges of sequence files, and files cut after so many records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.scratch import scratch
from helixframe.sources.sequences import read_fasta, score_and_seed


def numbered(rows: DataFrame, *order, name: str = "number") -> DataFrame:
    """Rows with their place in a global order, from 0.

    Rows are sorted in ranges, and written once, so that a range stays what it was when it is read again.  A range's first number is the sum of
    the sizes of those before it, of which there are as many as tasks; no task sees more than its range.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "sorted")
    low = F.lit((1 << 33) - 1)
    rows.orderBy(*order).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(low).alias("_at")).write.parquet(path)
    held = spark.read.parquet(path)
    sizes = held.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each task
    firsts = sizes.select("_range", before.alias("_first"))
    return held.join(F.broadcast(firsts), "_range").select(*rows.columns, (F.col("_first") + F.col("_at")).alias(name))


def merged_fasta(spark: SparkSession, paths: list[str], most: int | None = None) -> DataFrame:
    """(number, error, seed, seq) of the records of many files, in order of their error as text, then seed, then strand; `most` of them at most.

    Records whose name tells no error and seed have "0" for both, as text.
    """
    files = [read_fasta(spark, p).select(score_and_seed(F.col("name")).alias("n"), "seq") for p in paths]
    rows = files[0]
    for f in files[1:]:
        rows = rows.unionByName(f)
    out = numbered(rows.select("n.error", "n.seed", "seq"), "error", "seed", "seq")
    return out if most is None else out.where(F.col("number") < most)


def write_in_order(rows: DataFrame, path: str, number: str = "number", records: int = 100_000) -> None:
    """FASTA files of `records` records each, in folders part=0, part=1, ... in order of number; rows: (number, error, seed, seq)."""
    value = F.concat(F.lit(">"), "error", F.lit("_"), "seed", F.lit("\n"), "seq")
    cut = rows.select(F.floor(F.col(number) / records).alias("part"), number, value.alias("value"))
    cut.repartition("part").sortWithinPartitions("part", number).select("part", "value").write.mode("overwrite").partitionBy("part").text(path)
