"""FASTA and FASTQ as DataFrames, read by Spark's text source, so that any store and compression it knows will do."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RECORD = "name string, description string, seq string, qual string"


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(head, body) of each FASTA record.  A record begins where a line begins with >, so a > inside a header does no harm."""
    rows = spark.read.option("lineSep", "\n>").text(path).where("trim(value) != ''")
    rows = rows.select(F.regexp_replace(F.regexp_replace("value", r"^\s*>", ""), r"\r", "").alias("value"))
    return rows.select(F.regexp_extract("value", r"^([^\n]*)", 1).alias("head"), F.regexp_extract("value", r"(?s)^[^\n]*\n?(.*)", 1).alias("body"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq, depth, circular): lines of a record are joined and upper-cased; depth and circular come from the header."""
    head = F.col("head")
    depth = F.regexp_extract(F.lower(head), r"depth=([\d.]+)", 1)
    return _records(spark, path).select(
        F.regexp_extract(head, r"^(\S*)", 1).alias("name"), head.alias("description"), F.upper(F.regexp_replace("body", r"\s", "")).alias("seq"),
        F.when(depth == "", 1.0).otherwise(depth.cast("double")).alias("depth"), F.lower(head).contains("circular=true").alias("circular"),
    )


def read_strand_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, line, seq): each line that begins with a base is a strand of its own; lines are numbered inside their record."""
    rows = _records(spark, path).select(F.regexp_extract("head", r"^(\S*)", 1).alias("name"), F.posexplode(F.split("body", "\n")).alias("line", "seq"))
    return rows.where(F.col("seq").rlike("^[ACGT]"))


def score_and_seed(name: Column) -> Column:
    """A struct (error, seed) of strings from a header `error_seed`; "0" and "0" from any other."""
    parts = F.split(name, "_")
    fits = F.size(parts) == 2
    return F.struct(F.when(fits, parts[0]).otherwise("0").alias("error"), F.when(fits, F.get(parts, F.lit(1))).otherwise("0").alias("seed"))


def origin_of(description: Column) -> Column:
    """The strand that a simulated read's header names: the first entry of its second word; null without one."""
    second = F.get(F.split(description, " "), F.lit(1))
    return F.get(F.split(second, ","), F.lit(0))


def write_fasta(rows: DataFrame, path: str, name: str = "name", seq: str = "seq", blank_lines: bool = False) -> None:
    rows.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(seq), F.lit("\n" if blank_lines else "")).alias("value")).write.text(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq, qual) of records of four lines; blank lines between them do no harm.

    Records are told apart at lines that begin with @.  A quality line may begin so too: it then comes apart from its record, and is put
    back, also where a split of the file lies between them.
    """
    rows = spark.read.option("lineSep", "\n@").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))

    def mend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole records, and at the borders of splits the parts of one: what comes before a quality line (open), or that line (rest)."""
        here, held = None, None
        for frame in frames:
            out = []
            for value, file, at in zip(frame["value"], frame["file"], frame["at"]):
                first = (file, at) != here
                if first and held:
                    out.append((*here, "open", *held, None))
                    held = None
                here = (file, at)
                lines = value.replace("\r", "").rstrip("\n").split("\n")
                if first and at == 0:
                    lines = value.replace("\r", "").strip("\n").removeprefix("@").split("\n")
                    if lines == [""]:
                        continue
                if len(lines) >= 4:
                    out.append((file, at, "whole", *lines[:2], lines[3]))
                elif len(lines) == 3:
                    held = lines[:2]
                elif held:
                    out.append((file, at, "whole", *held, "@" + lines[0]))
                    held = None
                elif first:
                    out.append((file, at, "rest", None, None, "@" + lines[0]))
            yield pd.DataFrame(out, columns=["file", "at", "part", "description", "seq", "qual"])
        if held:
            yield pd.DataFrame([(*here, "open", *held, None)], columns=["file", "at", "part", "description", "seq", "qual"])

    found = rows.mapInPandas(mend, "file string, at long, part string, description string, seq string, qual string")
    after = F.lead("qual").over(Window.partitionBy("file").orderBy("at", "part"))  # one row or two for each split: "open" of a split goes after its "rest"
    parts = found.where("part != 'whole'").withColumn("part", F.when(F.col("part") == "open", "z").otherwise("a")).withColumn("qual", F.coalesce("qual", after)).where("part = 'z' AND qual IS NOT NULL")
    both = found.where("part = 'whole'").select("description", "seq", "qual").unionByName(parts.select("description", "seq", "qual"))
    return both.select(F.regexp_extract("description", r"^(\S*)", 1).alias("name"), "description", F.upper("seq").alias("seq"), "qual")


def fastq_slice(reads: DataFrame, start: int, end: int, probability: Column, upper: float = 1.0) -> DataFrame:
    """The bases start..end (end exclusive) of each read, where the rules give less than `upper`.  probability: a column over `seq`."""
    rows = reads.withColumn("seq", F.substring("seq", start + 1, end - start)).withColumn("_p", probability)
    return rows.withColumn("_p", F.explode(F.array("_p"))).where(F.col("_p") < upper).drop("_p")  # a row of its own: else the filter works out seq again for each use
