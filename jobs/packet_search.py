"""Packet search: for each block of each file the packets, of many seeds, whose strands break the fewest synthesis rules.

    python -m jobs.packet_search --config jobs/packet_search.json --files PATH --output PATH

`files` is a Parquet table with an id and the data (text or binary) of each file.  Data is cut into blocks of `block_chunks` chunks, each coded
by itself; `tries_per_chunk` seeds for each chunk are tried, and ceil(k * (1 + overhead)) packets of a block of k chunks are kept.

    output/packets/pool=   file_id, block, n_bytes, k, seed, degree, strand, error_prob
    output/fasta/pool=     the same strands as records >error_file_block_seed for the synthesis

A run replaces all that an earlier one wrote, so it may be repeated, after a failure too.  A null or empty file has no packet.  Files without an
id are coded under none, in pool 0.  Rows that repeat are coded as one file would be, each block keeping the best of all its rows' packets:
ids are meant to be distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import packet_table
from helixframe.operators.packets import packet_strand
from helixframe.sources.tables import spread
from jobs.common import LOG, command_line, settings

DEFAULTS = {"id_column": "doc_id", "data_column": "text", "chunk_bytes": 48, "block_chunks": 64, "tries_per_chunk": 2.0, "overhead": 0.4, "pools": 16}


def search(spark: SparkSession, files: str, output: str, config: dict | None = None) -> dict:
    """Search, write both outputs, and say how many files were read and how many packets were tried and written."""
    config = DEFAULTS | (config or {})
    table = spark.read.parquet(files)
    best = packet_table.best_packed(spread(table), config["id_column"], config["data_column"], config["chunk_bytes"], config["block_chunks"], config["tries_per_chunk"], config["overhead"])
    best = best.withColumn("pool", F.coalesce(F.pmod(F.col("file_id").cast("long"), F.lit(config["pools"])), F.lit(0)).cast("int"))
    # moved as bytes, a quarter of the bases
    dealt = best.hint("rebalance", "pool").withColumn("packed", packet_strand(F.col("packed"))).withColumnRenamed("packed", "strand")
    dealt.write.mode("overwrite").partitionBy("pool").parquet(f"{output}/packets")

    written = packets(spark, output, dict(best.dtypes)["file_id"])
    name = F.concat_ws("_", F.ceil(F.col("error_prob") * 100).cast("string"), F.coalesce(F.col("file_id").cast("string"), F.lit("")), F.col("block").cast("string"), F.col("seed").cast("string"))
    record = written.select(F.concat(F.lit(">"), name, F.lit("\n"), F.col("strand")).alias("value"), "pool")
    record.write.mode("overwrite").partitionBy("pool").text(f"{output}/fasta")

    n = written.agg(F.count("*").alias("n"), F.count_if(F.col("error_prob") >= 1).alias("bad"), F.count_distinct(F.struct("file_id", "block")).alias("blocks")).first()
    total = {"files_read": table.count(), "blocks": n["blocks"], "packets_written": n["n"], "packets_over_one": n["bad"]}
    LOG.info("read %s, wrote %s: %s", files, output, total)
    return total


def packets(spark: SparkSession, output: str, id_type: str = "long") -> DataFrame:
    """The packets that a run has kept.  No packets are no files, so the schema is said."""
    schema = f"file_id {id_type}, block long, n_bytes int, k int, seed int, degree int, strand string, error_prob double, pool int"
    return spark.read.schema(schema).parquet(f"{output}/packets")


if __name__ == "__main__":
    command_line("packet_search", ["files", "output"], lambda spark, config, *paths: search(spark, *paths, settings(config, DEFAULTS)))
