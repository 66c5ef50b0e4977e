"""Alignments, models, logs and packet folders as DataFrames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def compression(content: Column) -> Column:
    """gz, bz2, zip or plain, by the first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.startswith("1F8B08"), "gz").when(head.startswith("425A68"), "bz2").when(head == "504B0304", "zip").otherwise("plain")


def sequence_kind(content: Column) -> Column:
    """fasta or fastq by the first character that isn't white space; null for any other."""
    first = F.left(F.ltrim(F.regexp_replace(F.decode(F.substring(content, 1, 4096), "iso-8859-1"), r"^\s+", "")), F.lit(1))
    return F.when(first == ">", "fasta").when(first == "@", "fastq")


def sequence_format(spark: SparkSession, path: str) -> str:
    """fasta or fastq, by the first character.  Compression is told by the first bytes: gzip is read, if its extension says so to Spark; others raise."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    head = bytes(max(stream.read(), 0) for _ in range(4))
    stream.close()
    if head.startswith((b"BZh", b"PK\x03\x04")):
        raise ValueError(f"{path}: only gzip is supported")
    row = spark.read.text(path).where("trim(value) != ''").first()
    kind = {">": "fasta", "@": "fastq"}.get(row[0].lstrip()[:1] if row else "")
    if kind is None:
        raise ValueError(f"{path} is neither FASTA nor FASTQ")
    return kind


def write_fastq(rows: DataFrame, path: str, name: str = "name", seq: str = "seq", qual: str = "qual") -> None:
    rows.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col(name).cast("string")), F.col(seq), F.lit("+"), F.col(qual)).alias("value")).write.text(path)


def classed_reads(reads: DataFrame, header: str, bad: str = "chimera|random_seq|junk_seq") -> DataFrame:
    """Reads whose header names none of the bad classes."""
    return reads.where(~F.col(header).rlike(bad))


def write_fastq_by_reference(reads: DataFrame, path: str) -> DataFrame:
    """Good reads, a folder for each reference; returns (ref_name, n)."""
    good = reads.where("kind = 'good'")
    good.select("ref_name", F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_id").cast("string")), "seq", F.lit("+"), "qual").alias("value")).write.partitionBy("ref_name").text(path)
    return good.groupBy("ref_name").agg(F.count("*").alias("n"))


def write_packets_fasta(packets: DataFrame, path: str, suffix: str = "") -> None:
    """Records named by the ceiling of 100 times the error chance and by the seed: (error_prob, seed, strand)."""
    name = F.concat(F.lit(">"), F.ceil(F.col("error_prob") * 100).cast("string"), F.lit("_"), F.col("seed").cast("string"), F.lit(suffix))
    packets.select(F.concat_ws("\n", name, "strand").alias("value")).write.text(path)


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """All alignments: read_name, read_start, read_end, strand, ref_name, ref_start, ref_end, matches, bases, score, cigar, identity."""
    rows = spark.read.text(path).where("trim(value) != ''")
    c = F.split("value", "\t")
    names = [("read_name", 0, "string"), ("read_start", 2, "long"), ("read_end", 3, "long"), ("strand", 4, "string"), ("ref_name", 5, "string"), ("ref_start", 7, "long"), ("ref_end", 8, "long"), ("matches", 9, "long"), ("bases", 10, "long")]
    rows = rows.where(F.size(c) >= 12).select(*[c[i].cast(t).alias(n) for n, i, t in names], F.regexp_extract("value", r"\tAS:i:(-?\d+)", 1).try_cast("long").alias("score"), F.regexp_extract("value", r"\tcg:Z:(\S+)", 1).alias("cigar"))
    return rows.withColumn("identity", F.when(F.col("bases") > 0, 100 * F.col("matches") / F.col("bases")))


def best_alignments(paf: DataFrame, bases: int = 100, identity: float = 80) -> DataFrame:
    """The best-scored alignment of each read, if it is long and good enough."""
    key = F.struct("score", "bases", "matches", "ref_name", "ref_start")
    best = paf.groupBy("read_name").agg(F.max_by(F.struct(*[c for c in paf.columns if c != "read_name"]), key).alias("b")).select("read_name", "b.*")
    return best.where((F.col("bases") > bases) & (F.col("identity") > identity))


def read_error_model(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, rank, alt, p) of lines `kmer,p;alt,p;...`; the first pair is the k-mer itself."""
    parts = F.filter(F.split("value", ";"), lambda x: x.contains(","))
    rows = spark.read.text(path).where("value LIKE '%,%'").select(F.split(parts[0], ",")[0].alias("kmer"), F.posexplode(parts).alias("rank", "pair"))
    return rows.select("kmer", "rank", F.split("pair", ",")[0].alias("alt"), F.split("pair", ",")[1].cast("double").alias("p"))


def read_quality_model(spark: SparkSession, path: str) -> DataFrame:
    """(cigar, n, q, p) of lines `cigar;count;q:p,...`; a line of another form gives a row whose n is null."""
    parts = F.split("value", ";")
    rows = spark.read.text(path).where("trim(value) != ''").select(parts[0].alias("cigar"), F.get(parts, F.lit(1)).try_cast("long").alias("n"), F.explode_outer(F.filter(F.split(F.get(parts, F.lit(2)), ","), lambda x: x != "")).alias("pair"))
    return rows.select("cigar", "n", F.split("pair", ":")[0].try_cast("int").alias("q"), F.get(F.split("pair", ":"), F.lit(1)).try_cast("double").alias("p"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Experiment logs with a header."""
    return spark.read.csv(path, schema=schema, header=True)


def read_packet_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, packed, error, corrupt): a packet in each file of a folder; those in zip archives are taken out of them, one at a time.

    error: the chance of error that a name's second part states, or null.  corrupt: an archive that can't be read, or a file without content.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                name = file.rsplit("/", 1)[-1]
                if not name.lower().endswith(".zip"):
                    yield pd.DataFrame({"name": [name], "packed": [bytes(content)], "corrupt": [not content]})
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        for inner in z.namelist():
                            data = z.read(inner)
                            yield pd.DataFrame({"name": [inner], "packed": [data], "corrupt": [not data]})
                except zipfile.BadZipFile:
                    yield pd.DataFrame({"name": [name], "packed": [None], "corrupt": [True]})

    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInPandas(run, "name string, packed binary, corrupt boolean")
    error = F.regexp_extract("name", r"^[^_]*_(\d+(?:\.\d+)?)", 1)
    return rows.select("name", "packed", F.when(error != "", error.cast("double")).alias("error"), "corrupt")


def by_error(packets: DataFrame) -> DataFrame:
    """Packets of a folder or archive in order of their stated error, those without one last."""
    return packets.orderBy(F.col("error").asc_nulls_last(), "name")


def write_packets(packets: DataFrame, path: str, groups: Column | None = None) -> None:
    """Packets (seed, packed, error_prob) as rows in order of error and seed; with groups, a folder for each group."""
    if groups is None:
        packets.repartitionByRange("error_prob", "seed").sortWithinPartitions("error_prob", "seed").write.parquet(path)
    else:
        packets.withColumn("part", groups).repartition("part").sortWithinPartitions("part", "error_prob", "seed").write.partitionBy("part").parquet(path)


def write_zip(packets: DataFrame, path: str, suffix: str = ".RU10") -> None:
    """An archive in a file of the driver, entries `seed_error` in order of error.  Rows come one partition at a time."""
    rows = packets.select("seed", F.col("packed").alias("packed"), "error_prob").orderBy("error_prob", "seed")
    with zipfile.ZipFile(path, "w") as z:
        for r in rows.toLocalIterator():
            z.writestr(f"{r['seed']}_{r['error_prob']:g}{suffix}", bytes(r["packed"]))


def stanzas(rows: DataFrame, key: str, text: str, size: int = 4, skip: int = 0) -> DataFrame:
    """(key, stanza, the names before the colons): results logged as stanzas of `size` lines `name: value` after `skip` lines."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")
    at = F.posexplode(F.slice(lines, skip + 1, F.size(lines))).alias("pos", "line")
    rows = rows.select(key, at).select(key, F.floor(F.col("pos") / size).alias("stanza"), (F.col("pos") % size).alias("at"), F.substring_index("line", ": ", -1).alias("value"))
    return rows.groupBy(key, "stanza").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("at", "value")))).alias("values")).where(F.size("values") == size)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Candidates or settings in JSON documents of several lines."""
    return spark.read.schema(schema).json(path, multiLine=True)


def ini_entries(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, option, value) of settings in INI form: options in lower case, lines after # or ; left out, the last of equal ones counts."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x))
    rows = rows.select(key, F.posexplode(lines).alias("pos", "line")).where("line != '' AND NOT line RLIKE '^[#;]'")
    section = F.regexp_extract("line", r"^\[(.*)\]$", 1)
    by = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("section", F.last(F.when(section != "", section), ignorenulls=True).over(by)).where("NOT line RLIKE '^\\\\[.*\\\\]$'")
    pair = F.regexp_extract("line", r"^([^=:]*?)\s*[=:]", 1), F.regexp_extract("line", r"^[^=:]*[=:]\s*(.*)$", 1)
    rows = rows.select(key, "section", "pos", F.lower(pair[0]).alias("option"), pair[1].alias("value")).where("option != ''")
    return rows.groupBy(key, "section", "option").agg(F.max_by("value", "pos").alias("value"))


def ini_text(section: Column, options: dict[str, Column]) -> Column:
    """Settings as text in INI form, options in the given order; those that are null are left out."""
    lines = [F.concat(F.lit("["), section, F.lit("]"))] + [F.concat(F.lit(f"{k} = "), v.cast("string")) for k, v in options.items()]
    return F.concat_ws("\n", *lines)


def read_packet_stream(spark: SparkSession, path: str) -> DataFrame:
    """(name, pos, packed): files of packets, each after its length in four bytes, low one first; a broken end is left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                data, at, rows = bytes(content), 0, []
                while at + 4 <= len(data):
                    n = int.from_bytes(data[at : at + 4], "little")
                    if at + 4 + n > len(data):
                        break
                    rows.append((file.rsplit("/", 1)[-1], len(rows), data[at + 4 : at + 4 + n]))
                    at += 4 + n
                yield pd.DataFrame(rows, columns=["name", "pos", "packed"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "name string, pos long, packed binary")
