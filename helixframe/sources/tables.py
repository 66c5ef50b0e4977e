"""Parquet tables whose rows are long texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(table: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt to all cores; any other one as it is.

    A file with one row group is one task, however many partitions its bytes are cut into, and work on long texts costs far more than
    moving them once.  A table of many files is never moved.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if len(table.inputFiles()) < cores else table


def dealt(spark: SparkSession) -> int:
    """Tasks for small rows that cost much: one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(table) if name == "documents" else table
