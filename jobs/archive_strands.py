"""Incremental archive: what documents came since the last run becomes strands to be synthesised.

    python -m jobs.archive_strands --config jobs/archive_strands.json --documents PATH --output PATH --checkpoint PATH

`documents` is a Parquet table that grows by files.  A file stream with a checkpoint gives each run the files that are new, in loads of
`files_per_batch`.  Each text is cut into chunks; a chunk takes the form, of one for each mask, that breaks the fewest synthesis rules, and gets
a checksum.

Written, by load and so each load once, however often it is tried (a load that is repeated replaces its own partitions):

    output/strands/load=/pool=   doc_id, chunk_idx, mask, strand, error_prob
    output/files/load=           doc_id, n_bytes, n_chunks, digest (md5 of the bytes)

A document that comes again with the same bytes, in a later load, isn't archived again; with other bytes it is, under its new load.  Rows
that repeat within a load are archived as often as they come.  A null text counts as empty: a row in files, and no strand.  A null id goes
to pool 0.  Files that are changed in place aren't read again.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import strand as S
from helixframe.operators.chunks import chunks
from helixframe.operators.screening import screened_strands
from jobs.common import LOG, command_line, exact_glob, read_if_there, settings

DEFAULTS = {"id_column": "doc_id", "text_column": "text", "chunk_bytes": 47, "masks": [0, 1, 6, 11], "pools": 16, "files_per_batch": 64}
FILES = "load long, doc_id long, n_bytes long, n_chunks long, digest string"
STRANDS = "load long, pool int, doc_id long, chunk_idx long, mask int, strand string, error_prob double"


def coded(docs: DataFrame, config: dict) -> DataFrame:
    """(doc_id, chunk_idx, mask, strand, error_prob, pool) of documents (doc_id, text)."""
    rows = screened_strands(chunks(docs, "doc_id", "text", config["chunk_bytes"]), config["masks"])
    pool = F.coalesce(F.pmod("doc_id", F.lit(config["pools"])), F.lit(0)).cast("int")
    return rows.withColumn("strand", S.with_checksum(F.col("strand"))).withColumn("pool", pool)


def archive(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> dict:
    """Archive what is new, wait for the end, and say how many documents were read and how many strands were written."""
    config = DEFAULTS | (config or {})
    total = {"loads": 0, "documents_read": 0, "documents_archived": 0, "strands_written": 0}

    def load(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        docs = batch.select(F.col(f"`{config['id_column']}`").cast("long").alias("doc_id"), F.col(f"`{config['text_column']}`").cast("string").alias("text"))
        data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
        docs = docs.select("doc_id", "text", F.octet_length(data).cast("long").alias("n_bytes"), F.md5(data).alias("digest"))
        known = read_if_there(session, f"{output}/files", FILES).where(F.col("load") < number).select(F.col("doc_id").alias("known_id"), F.col("digest").alias("known_digest")).distinct()
        new = docs.join(known, F.col("doc_id").eqNullSafe(F.col("known_id")) & (F.col("digest") == F.col("known_digest")), "left_anti")

        strands = coded(new.select("doc_id", "text"), config).withColumn("load", F.lit(number).cast("long"))
        strands.hint("rebalance", "pool").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load", "pool").parquet(f"{output}/strands")
        files = new.select(F.lit(number).cast("long").alias("load"), "doc_id", "n_bytes", F.ceil(F.col("n_bytes") / config["chunk_bytes"]).cast("long").alias("n_chunks"), "digest")
        files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(f"{output}/files")

        read = batch.count()
        archived = read_if_there(session, f"{output}/files", FILES).where(F.col("load") == number).count()
        written = read_if_there(session, f"{output}/strands", STRANDS).where(F.col("load") == number).count()
        LOG.info("load %d: %d documents read from %s, %d of them new, %d strands written to %s", number, read, documents, archived, written, output)
        for key, n in (("loads", 1), ("documents_read", read), ("documents_archived", archived), ("strands_written", written)):
            total[key] += n

    schema = spark.read.parquet(documents).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(exact_glob(documents))
    run = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    LOG.info("done: %s", total)
    return total


def strands(spark: SparkSession, output: str) -> DataFrame:
    """All strands archived so far."""
    return read_if_there(spark, f"{output}/strands", STRANDS)


def files(spark: SparkSession, output: str) -> DataFrame:
    """All documents archived so far."""
    return read_if_there(spark, f"{output}/files", FILES)


if __name__ == "__main__":
    command_line("archive_strands", ["documents", "output", "checkpoint"], lambda spark, config, *paths: archive(spark, *paths, settings(config, DEFAULTS)))
