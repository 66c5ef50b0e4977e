"""Queries of single operators over the driver's tables, and the SQL that must agree with them."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.functions import bases as B
from helixframe.functions import rules as R
from helixframe.functions import strand as S
from helixframe.operators import align, channel, clusters, correction, experiments, fields, files, fountain, jpeg, kmers, matching, near, packet_table, packets, search, ternary, windows
from helixframe.operators.chunks import strands
from helixframe.plans.catalogue import _CHECK_BASES, _GC, _RUN, _S, _TOTAL, CHUNK, _hexed, _strands, query, rows_only
from helixframe.plans.codec import _B, _pool, _table
from helixframe.scratch import scratch
from helixframe.sources import models, ordered, sequences
from helixframe.sources.tables import spread


def _four(value: str, width: int) -> str:
    """SQL: a number as bases."""
    return "(" + " || ".join(f"substr('ACGT', CAST(({value}) // {4**i} % 4 + 1 AS BIGINT), 1)" for i in reversed(range(width))) + ")"


def _written(df: DataFrame, name: str) -> str:
    path = scratch(df.sparkSession, name)
    df.write.text(path)
    return path


# ---- files


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS seed, CAST(CAST(ceil(o_custkey % 64 / 64.0 * 100) AS BIGINT) AS VARCHAR) AS error, {_four('o_orderkey', 16)} AS seq FROM orders")
def packet_fasta(spark, sf_dir):
    """Packets written under names of their error and seed, and read back."""
    rows = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 64 / 64).alias("error_prob"), F.col("o_orderkey").alias("seed"), B.base_four(F.col("o_orderkey"), 16).alias("strand"))
    path = scratch(spark, "packets")
    models.write_packets_fasta(rows, path)
    return sequences.read_fasta(spark, path).select(sequences.score_and_seed(F.col("name")).alias("n"), "seq").select("n.seed", "n.error", "seq")


_MERGED = f"SELECT row_number() OVER (ORDER BY error, seed, seq) - 1 AS number, error, seed, seq FROM (SELECT CAST(o_orderkey AS VARCHAR) AS seed, CAST(CAST(ceil(o_custkey % 64 / 64.0 * 100) AS BIGINT) AS VARCHAR) AS error, {_four('o_orderkey', 16)} AS seq FROM orders)"


def _packet_files(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 64 / 64).alias("error_prob"), F.col("o_orderkey").alias("seed"), B.base_four(F.col("o_orderkey"), 16).alias("strand"))
    paths = [scratch(spark, "packets") for _ in range(3)]
    for i, path in enumerate(paths):
        models.write_packets_fasta(rows.where(F.col("seed") % 3 == i), path)
    return paths


@query(_MERGED)
def merged_packet_files(spark, sf_dir):
    """Packets of three FASTA files in one order: error as text, seed, strand."""
    return ordered.merged_fasta(spark, _packet_files(spark, sf_dir))


@query(f"{_MERGED} QUALIFY number < 1020")
def first_packets(spark, sf_dir):
    """The first records of the merged files, up to a limit."""
    return ordered.merged_fasta(spark, _packet_files(spark, sf_dir), 1020)


def _contigs(spark, sf_dir):
    four = B.base_four(F.col("p_partkey"), 12)
    head = F.concat(F.lit(">"), F.col("p_partkey").cast("string"), F.lit(" len>3 Depth="), (F.col("p_size") / 8).cast("string"), F.when(F.col("p_partkey") % 2 == 0, " CIRCULAR=true").otherwise(""))
    return _written(_table(spark, sf_dir, "part").select(F.concat_ws("\n", head, F.lower(F.left(four, F.lit(7))), F.substring(four, 8, 5), F.lit("")).alias("value")), "contigs")


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS name, {_four('p_partkey', 12)} AS seq, p_size / 8.0 AS depth, p_partkey % 2 = 0 AS circular FROM part")
def contig_fasta(spark, sf_dir):
    """Records of several lines in lower case, with depth, shape and a > in the header."""
    return sequences.read_fasta(spark, _contigs(spark, sf_dir)).select("name", "seq", "depth", "circular")


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS name, 1 AS line, right({_four('p_partkey', 12)}, 5) AS seq FROM part")
def strand_lines(spark, sf_dir):
    return sequences.read_strand_lines(spark, _contigs(spark, sf_dir))


@query(f"SELECT 'o' || o_orderkey AS name, {_four('o_orderkey', 12)} AS seq, translate({_four('o_orderkey * 7', 12)}, 'ACGT', '@I+>') AS qual FROM orders")
def fastq_records(spark, sf_dir):
    """Reads whose quality lines may begin like a header, written and read back in small splits."""
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), k).alias("name"), B.base_four(k, 12).alias("seq"), F.translate(B.base_four(k * 7, 12), "ACGT", "@I+>").alias("qual"))
    path = scratch(spark, "reads")
    models.write_fastq(rows, path)
    return sequences.read_fastq(spark, path).select("name", "seq", "qual")


@query("""WITH a AS (SELECT 'r' || l_orderkey AS read_name, 'c' || l_partkey AS ref_name, CAST(l_quantity * 10 AS BIGINT) AS bases, CAST(l_quantity * 10 AS BIGINT) * (60 + l_linenumber * 8) // 100 AS matches, l_suppkey % 50 AS score, l_linenumber FROM lineitem),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY read_name ORDER BY score DESC, bases DESC, matches DESC, ref_name DESC) = 1)
SELECT read_name, ref_name, bases, matches, round(100.0 * matches / bases, 6) AS identity FROM b WHERE bases > 100 AND 100.0 * matches / bases > 80""")
def best_alignment(spark, sf_dir):
    """Alignments as PAF text, and the best of each read."""
    n = (F.col("l_quantity") * 10).cast("long")
    m = F.floor(n * (60 + F.col("l_linenumber") * 8) / 100)
    cells = [F.concat(F.lit("r"), "l_orderkey"), n, F.lit(0), n, F.lit("+"), F.concat(F.lit("c"), "l_partkey"), F.lit(9000), F.lit(0), n, m, n, F.lit(60), F.concat(F.lit("AS:i:"), F.col("l_suppkey") % 50), F.concat(F.lit("cg:Z:"), n, F.lit("="))]
    path = _written(_table(spark, sf_dir, "lineitem").select(F.concat_ws("\t", *cells).alias("value")), "paf")
    return models.best_alignments(models.read_paf(spark, path)).select("read_name", "ref_name", "bases", "matches", F.round("identity", 6).alias("identity"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def experiment_log(spark, sf_dir):
    """A log written as CSV and read with a schema; only the columns in use are parsed."""
    path = scratch(spark, "log")
    _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").write.csv(path, header=True)
    log = models.read_log(spark, path, "event_id long, user_id long, event_type string, value double")
    return log.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH m AS (SELECT {_four('n_nationkey', 4)} AS kmer, n_nationkey % 4 AS w FROM nation)
SELECT kmer, 0 AS rank, kmer AS alt, 0.5 AS p FROM m UNION ALL SELECT kmer, 1, left(kmer, 3), 0.25 FROM m UNION ALL SELECT kmer, 2, kmer || 'A', 0.125 * w FROM m WHERE w > 0""")
def error_model_file(spark, sf_dir):
    k = B.base_four(F.col("n_nationkey"), 4)
    more = F.when(F.col("n_nationkey") % 4 > 0, F.concat(k, F.lit("A,"), 0.125 * (F.col("n_nationkey") % 4)))
    path = _written(_table(spark, sf_dir, "nation").select(F.concat_ws(";", F.concat(k, F.lit(",0.5")), F.concat(F.left(k, F.lit(3)), F.lit(",0.25")), more, F.lit("")).alias("value")), "model")
    return models.read_error_model(spark, path)


@query("SELECT 'X' || n_nationkey AS cigar, n_nationkey * 10 AS n, u AS q, u / 16.0 AS p FROM nation, range(3) t(u)")
def quality_model_file(spark, sf_dir):
    pairs = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda u: F.concat(u, F.lit(":"), u / 16)), ",")
    path = _written(_table(spark, sf_dir, "nation").select(F.concat(F.lit("X"), "n_nationkey", F.lit(";"), F.col("n_nationkey") * 10, F.lit(";"), pairs).alias("value")), "scores")
    return models.read_quality_model(spark, path).withColumn("n", F.col("n").cast("int"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS score FROM customer")
def json_candidates(spark, sf_dir):
    path = scratch(spark, "candidates")
    _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("score")).alias("c")).write.json(path)
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.from_json("value", "id long, c struct<name:string,score:double>").alias("j")).select("j.id", "j.c.name", "j.c.score")


@query("""SELECT p_partkey, p_name AS section, 'chunk_size' AS option, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, p_name, 'error_correction', p_brand FROM part
UNION ALL SELECT p_partkey, p_name, 'insert_header', 'True' FROM part WHERE p_size % 2 = 0""")
def ini_settings(spark, sf_dir):
    """Settings written in INI form and read back."""
    text = models.ini_text(F.col("p_name"), {"chunk_size": F.col("p_size"), "Error_Correction": F.col("p_brand"), "insert_header": F.when(F.col("p_size") % 2 == 0, "True")})
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("# settings\n\n"), text, F.lit("\n; end\n")).alias("text"))
    return models.ini_entries(rows, "p_partkey", "text")


@query("SELECT o_custkey, g AS stanza, CAST(o AS BIGINT) AS spacing, CAST(o % 7 AS DOUBLE) / 4 AS mean, CAST(o % 50 AS BIGINT) AS packets FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS g, o_orderkey AS o FROM orders)")
def result_stanzas(spark, sf_dir):
    """Results logged as stanzas of four lines, read as rows."""
    o = F.col("o_orderkey")
    four = F.concat(F.lit("Spacing: "), o, F.lit("\nMean error: "), o % 7 / 4, F.lit("\nStd: 0.5\nPackets < 1.0: "), o % 50)
    logs = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat(F.lit("a\nb\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(o, four.alias("t")))), lambda x: x["t"]), "\n\n")).alias("text"))
    v = F.col("values")
    return models.stanzas(logs, "o_custkey", "text", 4, 2).select("o_custkey", "stanza", v[0].cast("long").alias("spacing"), v[1].cast("double").alias("mean"), v[3].cast("long").alias("packets"))


_HEADS = ["1F8B0800", "425A6839", "504B0304", "0A3E7365710A41", "40720A41", "41434754"]


@query(f"SELECT o_orderkey, list_value('gz', 'bz2', 'zip', 'plain', 'plain', 'plain')[i] AS compression, list_value(NULL, NULL, NULL, 'fasta', 'fastq', NULL)[i] AS kind FROM (SELECT o_orderkey, o_orderkey % {len(_HEADS)} + 1 AS i FROM orders)")
def file_kinds(spark, sf_dir):
    """Compression and kind of files by their first bytes."""
    data = F.unhex(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("o_orderkey") % len(_HEADS) + 1).cast("int")))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", data.alias("data"))
    return rows.select("o_orderkey", models.compression(F.col("data")).alias("compression"), models.sequence_kind(F.col("data")).alias("kind"))


@query("SELECT p_partkey, p_name AS name FROM part")
def strand_file_bytes(spark, sf_dir):
    """Names as strands in a text file, and the bytes that are read from it."""
    rows = _table(spark, sf_dir, "part").select(S.to_strand(F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), "p_name").cast("binary")).alias("value"))
    text = F.decode(S.from_strand(F.trim("value")), "utf-8")
    return spark.read.text(_written(rows, "strands")).select(F.left(text, F.lit(9)).cast("long").alias("p_partkey"), F.substring(text, 10, 1000).alias("name"))


# ---- JPEG markers

_PIECES = "'FFD8FFDB0043' || hex(encode(p_name)) || 'FFDA0008' || array_to_string(list_transform(generate_series(0, p_size % 11), lambda i: 'FFD' || i % 8 || hex(encode(left(p_brand, 1 + i % 5))) || 'FF00'), '') || 'FFD9'"
_MARKS = f"""WITH d AS (SELECT p_partkey, {_PIECES} AS x FROM part), b AS (SELECT p_partkey, x, unnest(generate_series(0, length(x) // 2 - 2)) AS i FROM d),
m AS (SELECT p_partkey, length(x) // 2 AS n_bytes, i AS "offset", substr(x, 2 * i + 3, 2) AS marker FROM b WHERE substr(x, 2 * i + 1, 2) = 'FF' AND substr(x, 2 * i + 3, 2) != '00')"""


def _pictures(spark, sf_dir):
    piece = lambda i: F.concat(F.lit("FFD"), i % 8, F.hex(F.encode(F.left("p_brand", 1 + i % 5), "utf-8")), F.lit("FF00"))
    x = F.concat(F.lit("FFD8FFDB0043"), F.hex(F.encode("p_name", "utf-8")), F.lit("FFDA0008"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 11), piece), ""), F.lit("FFD9"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.unhex(x).alias("d"))


@query(f'{_MARKS} SELECT p_partkey, "offset", marker FROM m')
def marker_scan(spark, sf_dir):
    """Markers of pictures: start, tables, scan, numbered restarts, stuffed bytes that are no markers, end."""
    return jpeg.markers(_pictures(spark, sf_dir), "p_partkey", "d")


@query(f"""{_MARKS} SELECT p_partkey, "offset" AS start, coalesce(lead("offset") OVER (PARTITION BY p_partkey ORDER BY "offset"), n_bytes) AS "end", marker FROM m WHERE NOT regexp_matches(marker, '^D[0-7]$')""")
def marker_stretches(spark, sf_dir):
    """The bytes that each marker heads, restarts left out."""
    files = _pictures(spark, sf_dir)
    found = jpeg.markers(files, "p_partkey", "d", drop_restarts=True)
    return jpeg.marker_of_bytes(found, files.select("p_partkey", F.octet_length("d").cast("long").alias("n_bytes")), "p_partkey")


@query(f"""{_MARKS} SELECT p_partkey, "offset", 1 AS scan, CASE WHEN n < 8 THEN '' ELSE CAST(n // 8 AS VARCHAR) END || n % 8 AS number
FROM (SELECT p_partkey, "offset", row_number() OVER (PARTITION BY p_partkey ORDER BY "offset") - 1 AS n FROM m WHERE regexp_matches(marker, '^D[0-7]$'))""")
def restart_numbers(spark, sf_dir):
    return jpeg.restart_numbers(jpeg.markers(_pictures(spark, sf_dir), "p_partkey", "d"), "p_partkey").withColumn("scan", F.col("scan").cast("int"))


@query("""WITH n AS (SELECT i, 40000 // i AS n FROM range(1, 100, 2) t(i)), d AS (SELECT i, n, (n + list_sum(list_transform(generate_series(1, 6), lambda e: greatest(n - CAST(8 ** e AS BIGINT), 0)))) / n AS digits FROM n)
SELECT min(i) AS interval FROM d WHERE ceil(2.5 * i) + 2 * CASE WHEN n > 1 THEN digits ELSE 1 END > 0.66 * 71""")
def restart_interval(spark, sf_dir):
    return jpeg.restart_interval(spark, 40000, 2.5, 71)


# ---- filters


@query("SELECT o_orderkey, upper(left(x, 12)) AS seq FROM (SELECT o_orderkey, lower(" + _four("o_orderkey", 16) + ") AS x, o_orderkey % 5 AS n FROM orders) WHERE n < 4 AND 16 - n >= 13")
def fixed_length(spark, sf_dir):
    """Candidates of at least 13 bases cut to 12, in upper case."""
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").where(k % 5 < 4).select("o_orderkey", F.lower(F.left(B.base_four(k, 16), (16 - k % 5).cast("int"))).alias("seq"))
    return clusters.cut_candidates(rows.where(F.length("seq") >= 13), 12).withColumn("seq", F.upper("seq"))


@query(f"{_S}, r AS (SELECT doc_id, chunk_idx, substr(strand, 19, 146) AS strand FROM s) SELECT doc_id, chunk_idx, strand AS seq FROM r WHERE length(strand) > 0 AND CAST({_TOTAL} AS DOUBLE) < 1.0")
def sliced_reads(spark, sf_dir):
    """Bases 18 to 163 of each strand, where the rules allow them."""
    rows = _strands(spark, sf_dir).where(F.length("strand") > 18).select("doc_id", "chunk_idx", F.col("strand").alias("seq"))
    return sequences.fastq_slice(rows, 18, 164, R.default_rules(F.col("seq")))


@query("""SELECT l_suppkey AS origin, count(*) AS n FROM lineitem WHERE l_linenumber NOT IN (2, 4, 6) GROUP BY 1""")
def good_reads(spark, sf_dir):
    """Reads by the origin in their header; chimeras, junk and random ones go."""
    kind = F.when(F.col("l_linenumber") == 2, "chimera").when(F.col("l_linenumber") == 4, "junk_seq").when(F.col("l_linenumber") == 6, "random_seq").otherwise("+strand")
    rows = _table(spark, sf_dir, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit(" "), F.col("l_suppkey").cast("string"), F.lit(","), kind).alias("header"))
    return models.classed_reads(rows, "header").groupBy(sequences.origin_of(F.col("header")).cast("long").alias("origin")).agg(F.count("*").alias("n"))


@query(f"{_S} SELECT doc_id, count(*) AS n FROM s WHERE {_TOTAL} <= 0.5 AND CASE WHEN {_GC.format('strand')} NOT BETWEEN 40 AND 60 THEN 1.0 ELSE 0.0 END <= 0.5 GROUP BY 1")
def drop_in_two_stages(spark, sf_dir):
    """Strands as packets that pass the rules when they are made, and stricter ones when they are stored."""
    rows = _strands(spark, sf_dir).select(F.col("doc_id").alias("file_id"), F.lit(0).alias("block"), F.col("chunk_idx").alias("seed"), "strand")
    made = packets.should_drop(rows, R.default_rules(F.col("strand")), 0.5)
    stored = packets.should_drop(made, R.gc_band(S.gc_percent(F.col("strand")), 40, 60), 0.5)
    return stored.groupBy(F.col("file_id").alias("doc_id")).agg(F.count("*").alias("n"))


_USED = "list_distinct([o_custkey % 40, o_custkey * 7 % 40, o_orderkey % 40][1:CAST(1 + o_orderkey % 3 AS BIGINT)])"


def _packets(spark, sf_dir):
    """Packets with up to three chunks out of 40, an error and a rank."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    used = F.array_distinct(F.slice(F.array(c % 40, c * 7 % 40, o % 40), F.lit(1), (1 + o % 3).cast("int")))
    rows = _table(spark, sf_dir, "orders").select((c % 10).alias("file_id"), F.lit(0).cast("long").alias("block"), o.alias("seed"), used.alias("used"), (F.col("o_totalprice") / 500000).alias("error_prob"), (o % 50).alias("rank"))
    return rows.withColumn("degree", F.size("used"))


_PACKETS = f"WITH p AS (SELECT o_custkey % 10 AS file_id, o_orderkey AS seed, {_USED} AS used, o_totalprice / 500000 AS error_prob, o_orderkey % 50 AS rank FROM orders)"


@query(f"{_PACKETS} SELECT seed FROM p WHERE NOT (len(used) = 1 AND list_max(used) > 30) AND NOT (len(used) = 2 AND list_max(used) > 30 AND rank < 15)")
def priority_packets(spark, sf_dir):
    return _packets(spark, sf_dir).where(packets.priority_ok(F.col("degree"), F.col("used"), 30, F.col("rank"))).select("seed")


@query(f"{_PACKETS} SELECT seed FROM p WHERE error_prob <= (SELECT avg(error_prob) FROM p) * 1.1")
def under_mean(spark, sf_dir):
    return search.under_mean(_packets(spark, sf_dir), 0.1).select("seed")


@query(f"{_PACKETS} SELECT len(used) AS degree, count(*) AS n, round(avg(error_prob), 9) AS mean FROM p GROUP BY 1")
def degree_errors(spark, sf_dir):
    return search.degree_errors(_packets(spark, sf_dir)).withColumn("mean", F.round("mean", 9))


@query(f"{_PACKETS} SELECT file_id, chunk_idx, count(*) AS n, round(avg(error_prob), 9) AS mean FROM (SELECT file_id, unnest(used) AS chunk_idx, error_prob FROM p) GROUP BY 1, 2")
def chunk_errors(spark, sf_dir):
    return search.chunk_errors(_packets(spark, sf_dir)).select("file_id", "chunk_idx", "n", F.round("mean", 9).alias("mean"))


@query(f"""{_PACKETS}, u AS (SELECT file_id, seed, unnest(used) AS c FROM p), h AS (SELECT file_id, seed FROM u WHERE c IN (3, 21) GROUP BY 1, 2 HAVING count(*) = 2) SELECT file_id, seed FROM h WHERE seed NOT IN (SELECT seed FROM u WHERE c IN (5, 6))""")
def suspect_packets(spark, sf_dir):
    rows = _packets(spark, sf_dir)
    files = rows.select("file_id", "block").distinct()
    of = lambda *chunks: files.select("file_id", "block", F.explode(F.array(*[F.lit(c).cast("long") for c in chunks])).alias("chunk_idx"))
    return packets.suspects(rows, of(3, 21), of(5, 6)).select("file_id", "seed")


@query(f"{_PACKETS} SELECT file_id, seed FROM p QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY seed) > floor(count(*) OVER (PARTITION BY file_id) * 0.3)")
def erased_packets(spark, sf_dir):
    rows = _packets(spark, sf_dir).select("file_id", "block", "seed", "used", "degree", F.lit(None).cast("binary").alias("packed"), F.lit(40).alias("k"), F.lit(0).alias("n_bytes"))
    return packets.erasures(rows, 0.3).select("file_id", "seed")


@query(f"{_PACKETS} SELECT p.seed, len(list_filter(p.used, lambda x: NOT list_contains(q.used, x))) AS n_new, len(list_filter(p.used, lambda x: NOT list_contains(q.used, x))) = 0 AS is_part FROM p JOIN p q ON q.seed = p.seed + 1")
def chunk_sets(spark, sf_dir):
    """The chunks of a packet that the next one lacks, and whether it has all of them."""
    rows = _packets(spark, sf_dir).select("seed", "used")
    other = rows.select((F.col("seed") - 1).alias("seed"), F.col("used").alias("other"))
    left = F.array_except("used", "other")
    return rows.join(other, "seed").select("seed", F.size(left).cast("long").alias("n_new"), (F.size(left) == 0).alias("is_part"))


@query(f"{_PACKETS}, u AS (SELECT file_id, seed, used, unnest(used) AS c FROM p), n AS (SELECT file_id, c FROM u GROUP BY 1, 2 HAVING count(*) < 6) SELECT DISTINCT file_id, seed FROM u JOIN n USING (file_id, c)")
def rare_chunk_packets(spark, sf_dir):
    """Packets that hold a chunk which fewer than six packets of its file hold."""
    return search.holding_rare(_packets(spark, sf_dir), 6).select("file_id", "seed")


@query(f"{_S}, p AS (SELECT doc_id AS file_id, chunk_idx AS seed, round(CAST({_TOTAL} AS DOUBLE), 6) AS error_prob FROM s) SELECT * FROM p ORDER BY error_prob, file_id, seed LIMIT 500")
def best_packets(spark, sf_dir):
    """Two searches over strands as packets, some in both, and the best of them all."""
    rows = _strands(spark, sf_dir).select(F.col("doc_id").alias("file_id"), F.lit(0).alias("block"), F.col("chunk_idx").alias("seed"), F.round(R.default_rules(F.col("strand")), 6).alias("error_prob"))
    parts = [search.best_packets(rows.where(w), 500) for w in ("file_id % 3 != 0", "file_id % 3 != 1")]
    return search.merge_best(parts, 500).select("file_id", "seed", "error_prob")


# ---- channels and files


@query(f"{_PACKETS} SELECT seed, len(list_filter(generate_series(0, 1), lambda c: list_min(used) >= c * 10 AND list_max(used) < c * 10 + 30)) AS n_window, CASE WHEN len(list_filter(used, lambda i: i % 2 = 1)) = 0 THEN 2 ELSE 0 END AS n_even, CASE WHEN len(used) % 2 = 0 THEN [0] ELSE [1] END AS secure FROM p")
def packet_channels(spark, sf_dir):
    of = lambda m: experiments.channel_of(F.col("used"), F.col("degree"), 40, 2, m, 30, 10)
    return _packets(spark, sf_dir).select("seed", F.size(of("window")).cast("long").alias("n_window"), F.size(of("even")).alias("n_even"), of("secure").alias("secure"))


@query(f"{_PACKETS}, u AS (SELECT DISTINCT file_id, unnest(used) AS c FROM p WHERE error_prob < 0.05) SELECT f.file_id AS channel, t.c AS chunk_idx FROM (SELECT DISTINCT file_id FROM p) f, range(40) t(c) WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.file_id = f.file_id AND u.c = t.c)")
def channel_gaps(spark, sf_dir):
    """The chunks that no packet of a channel holds."""
    rows = _packets(spark, sf_dir).withColumnRenamed("file_id", "channel")
    return experiments.unused_chunks(rows.where("error_prob < 0.05"), 40, rows.select("channel").distinct()).withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


@query("SELECT o_orderpriority AS file, md5(string_agg(o_orderstatus || o_custkey, '' ORDER BY o_orderkey)) AS digest, count(*) AS n_parts FROM orders GROUP BY 1")
def merged_parts(spark, sf_dir):
    """Parts of files, numbered, put together again; none is missing."""
    rows = _table(spark, sf_dir, "orders")
    number = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")) - 1
    parts = rows.select(F.concat("o_orderpriority", F.lit("_"), number).alias("name"), F.concat("o_orderstatus", "o_custkey").cast("binary").alias("data"))
    return experiments.merged_parts(parts).where(F.size("missing") == 0).select("file", F.md5("data").alias("digest"), F.col("n_parts").cast("long").alias("n_parts"))


@query("SELECT 'a_' || r_name AS name FROM region UNION ALL SELECT 'b_' || n_name FROM nation")
def merged_folders(spark, sf_dir):
    return experiments.prefixed({"a": _table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), "b": _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))})


@query("SELECT c_custkey, ntile(7) OVER (ORDER BY c_acctbal, c_custkey) - 1 AS part FROM customer")
def equal_parts(spark, sf_dir):
    return experiments.parts_of(_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], 7).select("c_custkey", "part")


@query("SELECT c_custkey FROM customer ORDER BY md5('3:' || c_custkey), c_custkey LIMIT 100")
def sampled_rows(spark, sf_dir):
    return experiments.sampled(_table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 100, 3)


def _poisson(share: float) -> str:
    total, p, out = 0.0, math.exp(-share), []
    for k in range(16):
        total += p
        out.append(f"CASE WHEN u >= {total!r} THEN 1 ELSE 0 END")
        p *= share / (k + 1)
    return " + ".join(out)


@query(f"WITH d AS (SELECT o_orderkey, CAST('0x' || left(md5('5:' || o_orderkey), 8) AS BIGINT) / 4294967296.0 AS u FROM orders) SELECT o_orderkey, unnest(generate_series(1, {_poisson(0.7)})) AS copy FROM d")
def resampled_rows(spark, sf_dir):
    rows = experiments.resampled(_table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 0.7, 5)
    return rows.withColumn("copy", F.col("copy").cast("long"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY md5('0:' || o_orderkey), o_orderkey) <= 5")
def sampled_members(spark, sf_dir):
    """Five reads of each cluster."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cluster_id"), F.col("o_orderkey").alias("read_id"), F.lit("A").alias("seq"))
    return clusters.sample_members(rows, 5).select(F.col("cluster_id").alias("o_custkey"), F.col("read_id").alias("o_orderkey"))


@query("SELECT o_custkey AS cluster_id, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, cluster_id LIMIT 20")
def largest_clusters(spark, sf_dir):
    return clusters.largest(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cluster_id")), 20)


_COPIES = f"WITH {_B}, p AS (SELECT item_id * 1000 + chunk_idx AS cluster_id, strand FROM s), r AS (SELECT cluster_id, j AS read_id, left(strand, j * 5) || 'AC' || substr(strand, j * 5 + 2) AS seq FROM p, range(4) t(j))"


def _copies(spark, sf_dir):
    rows = _pool(spark, sf_dir).select(F.col("strand_id").alias("cluster_id"), "strand", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    return rows.select("cluster_id", F.col("j").cast("long").alias("read_id"), F.expr("concat(left(strand, j * 5), 'AC', substr(strand, j * 5 + 2))").alias("seq"))


@query(f"{_COPIES}, d AS (SELECT a.cluster_id, a.read_id, sum(levenshtein(a.seq, b.seq)) AS cost FROM r a JOIN r b USING (cluster_id) GROUP BY 1, 2) SELECT cluster_id, read_id, CAST(cost AS BIGINT) AS cost FROM d QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY cost, read_id) = 1")
def centroids(spark, sf_dir):
    return clusters.centroids(_copies(spark, sf_dir))


@query(f"{_COPIES} SELECT cluster_id, read_id, seq FROM r")
def oriented_reads(spark, sf_dir):
    """Every other read turned, and turned back by its mark."""
    rows = _copies(spark, sf_dir).withColumn("read_id", F.col("cluster_id") * 10 + F.col("read_id"))
    turned = F.col("read_id") % 2 == 1
    reads = rows.select("read_id", F.when(turned, S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
    return clusters.oriented(rows.select("cluster_id", "read_id", turned.alias("is_reversed")), reads).withColumn("read_id", F.col("read_id") % 10)


@query(f"{_S}, {_B.replace('h0 AS', 'g0 AS').replace('FROM h0', 'FROM g0').replace('h1 AS', 'g1 AS').replace('FROM h1', 'FROM g1').replace('c AS (', 'gc AS (').replace('FROM c)', 'FROM gc)').replace('s AS (SELECT item_id', 't AS (SELECT item_id')}, f AS (SELECT DISTINCT strand FROM t) SELECT (SELECT count(*) FROM f) AS n_refs, (SELECT count(*) FROM f WHERE strand IN (SELECT strand FROM s)) AS n_found, (SELECT count(*) FROM f) = (SELECT count(*) FROM f WHERE strand IN (SELECT strand FROM s)) AS all_found")
def recovered(spark, sf_dir):
    """How many strands of `benchmark` the documents have."""
    refs = strands(_table(spark, sf_dir, "benchmark"), "item_id", "text", CHUNK).select(F.col("strand").alias("seq")).distinct()
    return clusters.recovery(_strands(spark, sf_dir).select(F.col("strand").alias("seq")), refs)


_TURNED = "reverse(translate({}, 'ACGT', 'TGCA'))"


@query(f"""WITH {_B}, p AS (SELECT item_id * 1000 + chunk_idx AS cluster_id, strand || {_CHECK_BASES} AS c FROM s),
m AS (SELECT cluster_id, CASE cluster_id % 3 WHEN 0 THEN translate(left(c, 1), 'ACGT', 'CATG') || substr(c, 2) WHEN 1 THEN {_TURNED.format("c")} ELSE c END AS c FROM p),
b AS (SELECT cluster_id, c, left(c, {4 * CHUNK}) AS strand FROM (SELECT * FROM m UNION ALL SELECT cluster_id, {_TURNED.format("c")} FROM m)) SELECT DISTINCT cluster_id, strand AS seq FROM b WHERE length(c) = {4 * CHUNK + 4} AND right(c, 4) = {_CHECK_BASES}""")
def checksum_candidates(spark, sf_dir):
    """Strands with a checksum: some turned, some with another base in front; what the checksum lets through."""
    coded = _pool(spark, sf_dir).select(F.col("strand_id").alias("cluster_id"), S.with_checksum(F.col("strand")).alias("seq"))
    spoiled = F.concat(F.translate(F.left("seq", F.lit(1)), "ACGT", "CATG"), F.substring("seq", 2, 1 << 20))
    rows = coded.select("cluster_id", F.when(F.col("cluster_id") % 3 == 0, spoiled).when(F.col("cluster_id") % 3 == 1, S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
    return clusters.checked_candidates(rows, 4 * CHUNK)


# ---- matching


@query("""WITH j AS (SELECT o_totalprice AS depth, c_acctbal AS score FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'depth' AS "column", count(*) AS n, round(avg(depth), 4) AS mean, round(stddev_samp(depth), 4) AS sd, min(depth) AS least, max(depth) AS most FROM j UNION ALL SELECT 'score', count(*), round(avg(score), 4), round(stddev_samp(score), 4), min(score), max(score) FROM j""")
def joined_summary(spark, sf_dir):
    left = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uuid"), F.col("o_totalprice").alias("depth"))
    right = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uuid"), F.col("c_acctbal").alias("score"))
    return matching.joined_summary(left, right, "uuid", ["depth", "score"]).withColumns({c: F.round(c, 4) for c in ("mean", "sd")})


@query(f"""WITH {_B}, p AS (SELECT item_id * 1000 + chunk_idx AS strand_id, strand FROM s), k AS (SELECT strand_id AS cand_id, left(strand, 30) || CASE WHEN strand_id % 3 = 0 THEN 'ACG' ELSE 'T' END || substr(strand, 32) AS c FROM p),
o AS (SELECT cand_id, {_TURNED.format("c")} AS c FROM k WHERE cand_id % 2 = 1 UNION ALL SELECT cand_id, c FROM k WHERE cand_id % 2 = 0), b AS (SELECT cand_id, c, false AS is_reversed FROM o UNION ALL SELECT cand_id, {_TURNED.format("c")}, true FROM o),
x AS (SELECT cand_id, is_reversed, strand_id AS ref_id, CAST(list_sum(list_transform(generate_series(1, least(length(c), length(strand))), lambda i: CASE WHEN substr(c, i, 1) = substr(strand, i, 1) THEN 1 ELSE 0 END)) AS DOUBLE) / length(strand) AS score FROM b, p)
SELECT cand_id, ref_id, round(score, 9) AS score, is_reversed FROM x QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY score DESC, is_reversed, ref_id) = 1""")
def oriented_match(spark, sf_dir):
    """Changed strands, every other one turned, against all strands in both directions."""
    pool = _pool(spark, sf_dir)
    cands = pool.select(F.col("strand_id").alias("cand_id"), F.concat(F.left("strand", F.lit(30)), F.when(F.col("strand_id") % 3 == 0, "ACG").otherwise("T"), F.expr("substr(strand, 32)")).alias("seq"))
    cands = cands.withColumn("seq", F.when(F.col("cand_id") % 2 == 1, S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    return matching.oriented_best_match(cands, pool.select(F.col("strand_id").alias("ref_id"), F.col("strand").alias("seq"))).withColumn("score", F.round("score", 9))


@query("""SELECT l_orderkey AS read_name, l_partkey AS ref_name, 'read' AS missing FROM lineitem WHERE l_orderkey % 7 = 0 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT l_orderkey, l_partkey, 'reference' FROM lineitem WHERE l_partkey % 11 = 0 OR l_partkey NOT IN (SELECT p_partkey FROM part)""")
def dangling_alignments(spark, sf_dir):
    found = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_name"), F.col("l_partkey").alias("ref_name"))
    return matching.dangling(found, _table(spark, sf_dir, "orders").where("o_orderkey % 7 != 0").select(F.col("o_orderkey").alias("read_name")), _table(spark, sf_dir, "part").where("p_partkey % 11 != 0").select(F.col("p_partkey").alias("ref_name")))


_OPS = "translate({}, 'ACGT', '=XID')".format(_four("o_orderkey * 37 % 262144", 9))
_TRIM = "regexp_replace(substr({0}, 2, greatest(length({0}) - 2, 0)), '^D+|D+$', '', 'g')"


@query(f"""WITH f0 AS (SELECT o_orderkey AS id, {_OPS} AS a FROM orders), f AS (SELECT *, {_TRIM.format('a')} AS b FROM f0), g AS (SELECT *, {_TRIM.format('b')} AS c FROM f), h AS (SELECT *, {_TRIM.format('c')} AS d FROM g), i AS (SELECT *, {_TRIM.format('d')} AS e FROM h),
k AS (SELECT id, unnest([a, b, c, d, e]) AS cigar, unnest([0, 1, 2, 3, 4]) AS n FROM i), m AS (SELECT DISTINCT {_OPS.replace('262144', '64').replace('// 65536', '// 65536')} AS w FROM orders),
t AS (SELECT DISTINCT right(w, 3) AS cigar FROM m WHERE right(w, 1) != 'D' AND left(right(w, 3), 1) != 'D' UNION SELECT unnest(['=', 'X', 'I']))
SELECT id, cigar AS found FROM k JOIN t USING (cigar) WHERE cigar != '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) = 1""")
def context_backoff(spark, sf_dir):
    """Contexts of nine columns looked up in a model of contexts of three and one: the longest that it has."""
    ops = lambda n: F.translate(B.base_four(F.col("o_orderkey") * 37 % n, 9), "ACGT", "=XID")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ops(262144).alias("cigar"), F.right(ops(64), F.lit(3)).alias("three"))
    model = rows.select(F.col("three").alias("cigar")).where("NOT cigar RLIKE '^D|D$'").unionByName(spark.createDataFrame([("=",), ("X",), ("I",)], "cigar string")).distinct()
    return matching.backed_off(rows.select("id", "cigar"), model, 4).select("id", "found")


@query(f"""WITH {_B}, parts AS (SELECT item_id * 1000 + chunk_idx AS part_id, left(strand, 80) AS part FROM s WHERE length(strand) >= 16), w0 AS (SELECT doc_id, lower(hex(encode(text))) AS x FROM documents WHERE length(text) > 0),
w1 AS (SELECT doc_id, x, unnest(generate_series(0, (length(x) - 1) // 800)) AS b FROM w0), w2 AS (SELECT doc_id * 1000 + b AS whole_id, substr(x, b * 800 + 1, 800) AS h FROM w1),
w AS (SELECT whole_id, {''.join('replace(' for _ in S.HEX)}h{''.join(f", '{c}', '{S.pair(i)}')" for i, c in enumerate(S.HEX))} AS whole FROM w2)
SELECT part_id, whole_id FROM parts JOIN w ON contains(whole, part)""")
def contained_strands(spark, sf_dir):
    """Which heads of strands of `benchmark` lie in which blocks of documents."""
    parts = _pool(spark, sf_dir).where(F.length("strand") >= 16).select(F.col("strand_id").alias("part_id"), F.left("strand", F.lit(80)).alias("seq"))
    wholes = packets.source_blocks(_table(spark, sf_dir, "documents"), "doc_id", "text", 400, 1).select((F.col("file_id") * 1000 + F.col("block")).alias("whole_id"), S.to_strand(F.col("data")).alias("seq"))
    return kmers.contained(parts, wholes)


@query("SELECT p_name AS seq, p_partkey, p_name IN (SELECT p_name FROM part WHERE p_size > 40) AS is_correct FROM part")
def screened(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("seq"), "p_size")
    return matching.checked_against(rows.drop("p_size"), rows.where("p_size > 40"))


@query(f"WITH {_B}, r AS (SELECT item_id * 1000 + chunk_idx AS id, strand AS a, left(strand, 20) || 'ACG' || substr(strand, 25, 60) || 'T' || substr(strand, 85) AS b FROM s WHERE length(strand) > 0) SELECT id, CAST(levenshtein(a, b) AS BIGINT) AS cost, length(b) - length(a) AS longer, a, b FROM r")
def edit_operations(spark, sf_dir):
    """Strands against changed ones: as many edits as their distance, insertions less deletions, and both strands back from the alignment."""
    rows = _pool(spark, sf_dir).where(F.length("strand") > 0).select(F.col("strand_id").alias("id"), F.col("strand").alias("a"), F.expr("concat(left(strand, 20), 'ACG', substr(strand, 25, 60), 'T', substr(strand, 85))").alias("b"))
    rows = spread(rows).select("id", "a", "b", F.explode(F.array(align.script_of(F.col("a"), F.col("b")))).alias("e"))  # a row of its own: worked out once
    n = lambda op: align.count_in(F.col("e"), op).cast("long")
    back = lambda gap, c: F.replace(align.gapped_by(F.col("e"), F.col(c), gap), F.lit("-"), F.lit("")).alias(c)
    return rows.select("id", (n("I") + n("D") + n("X")).alias("cost"), (n("I") - n("D")).alias("longer"), back("I", "a"), back("D", "b"))


@query(f"""WITH RECURSIVE {_B}, p AS (SELECT item_id * 1000 + chunk_idx AS id, strand AS a, substr(strand, 60, 50) || 'ACG' || substr(strand, 115, 20) || {_TURNED.format('left(strand, 40)')} AS b FROM s),
h AS (SELECT id, 0 AS i, j, CAST(0 AS BIGINT) AS v FROM (SELECT id, unnest(range(length(b) + 1)) AS j FROM p)
UNION ALL SELECT id, i, j, max(t + j) OVER (PARTITION BY id ORDER BY j) - j FROM (SELECT h.id, h.i + 1 AS i, j, CASE WHEN j = 0 THEN 0 ELSE greatest(0, v - 1, lag(v) OVER (PARTITION BY h.id ORDER BY j) + CASE WHEN substr(a, h.i + 1, 1) = substr(b, j, 1) THEN 1 ELSE -1 END) END AS t FROM h JOIN p USING (id) WHERE h.i < length(a)))
SELECT id, CAST(max(v) AS INTEGER) AS score FROM h GROUP BY id""")
def local_scores(spark, sf_dir):
    """Strands against parts of themselves and a part turned: the best local alignment."""
    a = F.col("a")
    b = F.concat(F.substring("a", 60, 50), F.lit("ACG"), F.substring("a", 115, 20), S.reverse_complement(F.left(a, F.lit(40))))
    rows = spread(_pool(spark, sf_dir).select(F.col("strand_id").alias("id"), F.col("strand").alias("a"))).withColumn("b", b)
    return rows.select("id", align.local_score_of(F.col("a"), F.col("b")).alias("score"))


@query("""WITH c AS (SELECT CAST(l_quantity AS BIGINT) AS q, l_linenumber AS x, l_suppkey % 3 AS d, l_partkey % 4 AS e FROM lineitem),
p AS (SELECT unnest(range(q)) AS position, '=' AS op, 1 AS n FROM c UNION ALL SELECT q + unnest(range(x)), 'X', 1 FROM c UNION ALL SELECT q + x, 'I', q FROM c WHERE q > 0 UNION ALL SELECT q + x + unnest(range(d)), 'D', 1 FROM c UNION ALL SELECT q + x + d + unnest(range(e)), '=', 1 FROM c)
SELECT CAST(position AS INTEGER) AS position, CAST(coalesce(sum(n) FILTER (op = '='), 0) AS BIGINT) AS n_match, CAST(coalesce(sum(n) FILTER (op = 'X'), 0) AS BIGINT) AS n_mismatch, CAST(coalesce(sum(n) FILTER (op = 'D'), 0) AS BIGINT) AS n_deletion, CAST(coalesce(sum(n) FILTER (op = 'I'), 0) AS BIGINT) AS n_insertion FROM p GROUP BY 1""")
def position_errors(spark, sf_dir):
    """Matches, mismatches, deletions and insertions of alignments by their place in the reference."""
    q = F.col("l_quantity").cast("long")
    c = F.concat(q, F.lit("="), F.col("l_linenumber"), F.lit("X"), q, F.lit("I"), F.col("l_suppkey") % 3, F.lit("D"), F.col("l_partkey") % 4, F.lit("="))
    return align.errors_by_position(_table(spark, sf_dir, "lineitem").select(c.alias("cigar")))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN 2 * l_quantity + l_linenumber > 0 THEN l_quantity / (2 * l_quantity + l_linenumber + l_suppkey % 3) ELSE 0 END, 9) AS identity FROM lineitem")
def cigar_identity(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    c = F.concat(q, F.lit("="), F.col("l_linenumber"), F.lit("X"), q, F.lit("I"), F.col("l_suppkey") % 3, F.lit("D"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(align.cigar_identity(c), 9).alias("identity"))


@query("SELECT c_custkey, round(list_avg(list_transform(string_split(c_name, ''), lambda c: pow(10, -(ascii(c) - 33) / 10.0))), 12) AS error FROM customer")
def mean_quality(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", F.round(align.phred_error(F.col("c_name")), 12).alias("error"))


_GAPPED = f"WITH {_B}, r AS (SELECT strand AS ref, left(strand, chunk_idx % 50 + 9) || '-' || substr(strand, chunk_idx % 50 + 11, 20) || 'A' || substr(strand, chunk_idx % 50 + 32) AS read FROM s WHERE length(strand) = {4 * CHUNK})"


@query(f"""{_GAPPED}, k AS (SELECT substr(ref, i, 4) AS kmer, replace(substr(read, i, 4), '-', '') AS alt FROM (SELECT ref, read, unnest(generate_series(1, length(ref) - 3)) AS i FROM r)),
n AS (SELECT kmer, alt, count(*) AS n FROM k WHERE alt != '' AND left(kmer, 1) = left(alt, 1) AND right(kmer, 1) = right(alt, 1) GROUP BY 1, 2)
SELECT kmer, alt, n, round(n / sum(n) OVER (PARTITION BY kmer), 9) AS share FROM n QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY alt != kmer, n DESC, alt) <= 25""")
def learned_errors(spark, sf_dir):
    """What reads hold for each 4-mer of strands, of pairs with a deletion and a changed base."""
    rows = strands(_table(spark, sf_dir, "benchmark"), "item_id", "text", CHUNK).where(F.length("strand") == 4 * CHUNK)
    read = F.expr("concat(left(strand, cast(chunk_idx % 50 + 9 as int)), '-', substr(strand, cast(chunk_idx % 50 + 11 as int), 20), 'A', substr(strand, cast(chunk_idx % 50 + 32 as int)))")
    return channel.error_model(rows.select(F.col("strand").alias("ref"), read.alias("read")), 4).select("kmer", "alt", "n", F.round("share", 9).alias("share"))


@query("WITH d AS (SELECT ps AS ref_name, n FROM (SELECT l_suppkey AS ps, count(*) AS n FROM lineitem WHERE l_returnflag != 'R' GROUP BY 1)) SELECT round(avg(n), 6) AS mean, round(var_pop(n), 6) AS variance, min(n) AS least, max(n) AS most FROM d")
def depth_of_origins(spark, sf_dir):
    reads = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ref_name"), F.when(F.col("l_returnflag") == "R", "junk").otherwise("good").alias("kind"))
    return channel.depth_summary(reads).withColumns({c: F.round(c, 6) for c in ("mean", "variance")})


# ---- statistics


@query(f"""WITH r AS (SELECT o_orderkey, sp, {_four('o_orderkey', 8)} AS ident, {_four('o_orderkey * 7919 % 4294967296', 16)} AS payload FROM orders, range(4) t(sp)),
m AS (SELECT sp AS spacing, array_to_string(list_transform(generate_series(1, 8), lambda i: substr(ident, i, 1) || substr(payload, (i - 1) * sp + 1, sp)), '') || substr(payload, 8 * sp + 1) AS strand FROM r),
e AS (SELECT spacing, CAST({_TOTAL} AS DOUBLE) AS p FROM m) SELECT spacing, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS sd, count(*) FILTER (p < 1.0) AS n_under FROM e GROUP BY 1""")
def spacing_statistics(spark, sf_dir):
    """Errors of packets whose identifier is spread over the payload, by how far."""
    k, out = F.col("o_orderkey"), None
    for spacing in range(4):
        strand = B.spaced(B.base_four(k, 8), B.base_four(k * 7919 % 4294967296, 16), spacing)
        rows = _table(spark, sf_dir, "orders").select(F.lit(spacing).cast("long").alias("spacing"), strand.alias("strand"))
        out = rows if out is None else out.unionAll(rows)
    rows = out.select("spacing", R.default_rules(F.col("strand")).alias("error_prob"))
    return experiments.error_statistics(rows, "spacing").withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


@query("""WITH RECURSIVE f AS (SELECT 1 AS len, 1 AS run, CAST(4 AS HUGEINT) AS n UNION ALL
SELECT f.len + 1, t.run, sum(CASE WHEN t.run = 1 THEN 3 * f.n WHEN t.run = f.run + 1 THEN f.n ELSE 0 END) FROM f, (VALUES (1), (2), (3)) t(run) WHERE f.len < 16 GROUP BY f.len, t.run)
SELECT CAST(4294967296 AS BIGINT) AS n, CAST(4294967296 - sum(n) AS BIGINT) AS impossible FROM f WHERE len = 16""")
def impossible_seeds_32(spark, sf_dir):
    """Seeds of 32 bits with a run over three: halves of 16 bits by their first and last runs, put together."""
    return fountain.impossible_seeds(spark)


@query("SELECT user_id % 5 AS overhead, count(*) AS n FROM events GROUP BY 1")
def overhead_counts(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("overhead")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT event_type, count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h FROM events GROUP BY 1)
SELECT event_type, x, round(sum(exp(-(x - value) * (x - value) / (2 * h * h))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density FROM events JOIN s USING (event_type), (SELECT unnest([0.0, 25.0, 50.0, 100.0, 200.0]::DOUBLE[]) AS x) GROUP BY 1, 2""")
def density_of_values(spark, sf_dir):
    return experiments.density_curve(_table(spark, sf_dir, "events"), "event_type", "value", [0, 25, 50, 100, 200]).withColumn("density", F.round("density", 9))


@query("SELECT s // 86400 AS days, s // 3600 % 24 AS hours, s // 60 % 60 AS minutes, s % 60 AS seconds FROM (SELECT CAST(floor(sum(p_size * 1000 + 7)) AS BIGINT) AS s FROM part)")
def elapsed_time(spark, sf_dir):
    return _table(spark, sf_dir, "part").agg(F.sum(F.col("p_size") * 1000 + 7).alias("s")).select(B.elapsed(F.col("s")).alias("e")).select("e.*")


@query("WITH s AS (SELECT p_size, p_brand, sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS c FROM part GROUP BY 1, 2) SELECT p_size, CAST((2 * sum(c) + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS mean, round(stddev_pop(c / 100.0), 2) AS sd FROM s GROUP BY 1")
def run_statistics(spark, sf_dir):
    """Prices are summed as decimals: sums of doubles depend on their order, and means that end in half a cent with them."""
    rows = _table(spark, sf_dir, "part").withColumn("p_retailprice", F.col("p_retailprice").cast("decimal(18,2)"))
    return experiments.run_statistics(rows, "p_size", "p_brand", "p_retailprice").withColumn("mean", F.col("mean").cast("double"))


_BLACKMAN = [0.42 - 0.5 * math.cos(2 * math.pi * i / 14) + 0.08 * math.cos(4 * math.pi * i / 14) for i in range(15)]


@query("SELECT user_id, event_id, round(m, 6) AS mean FROM (SELECT user_id, event_id, (" + " + ".join(f"{'lag' if i < 8 else 'lead'}(value, {abs(7 - i)}) OVER w * {w!r}" for i, w in enumerate(_BLACKMAN)) + f") / {sum(_BLACKMAN)!r} AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE m IS NOT NULL")
def weighted_mean(spark, sf_dir):
    return experiments.blackman_mean(_table(spark, sf_dir, "events"), "user_id", "event_id", "value").withColumn("mean", F.round("mean", 6))


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM events), b AS (SELECT least(19, CAST(floor((value - lo) / ((hi - lo) / 20)) AS BIGINT)) AS bin, (hi - lo) / 20 AS w, n FROM events, e) SELECT bin, count(*) AS n, round(count(*) / any_value(n) / any_value(w), 9) AS pdf, round(sum(count(*)) OVER (ORDER BY bin) / any_value(n), 9) AS cdf FROM b GROUP BY bin")
def value_histogram(spark, sf_dir):
    return experiments.histogram(_table(spark, sf_dir, "events"), "value").withColumns({c: F.round(c, 9) for c in ("pdf", "cdf")})


@query("SELECT degree, round(p - coalesce(lag(p) OVER (ORDER BY degree), 0), 12) AS step, round(p, 12) AS p FROM (SELECT degree, CASE WHEN degree = 1 THEN 1 / 60.0 ELSE 1.0 / (degree * (degree - 1)) END AS p FROM range(1, 60) t(degree))")
def distribution_steps(spark, sf_dir):
    """A distribution as differences, and back."""
    steps = fountain.differences(fountain.ideal_soliton(spark, 60))
    back = fountain.accumulated(steps)
    return steps.select("degree", F.round("p", 12).alias("step")).join(back.select("degree", F.round("p", 12).alias("p")), "degree")


@query("WITH r AS (SELECT CAST(l_quantity AS BIGINT) AS n FROM lineitem), c AS (SELECT n, sum(sum(n)) OVER (ORDER BY n DESC) AS run, sum(sum(n)) OVER () AS every FROM r GROUP BY n) SELECT max(n) AS n50 FROM c WHERE run >= 0.5 * every")
def half_of_bases(spark, sf_dir):
    return experiments.half_of_bases(_table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("n")))


@query("WITH r AS (SELECT CAST(l_quantity * 40 AS BIGINT) AS len FROM lineitem), c AS (SELECT 'c' || n_nationkey AS name, 1.0 + n_nationkey AS depth, 100 + n_nationkey * 90 AS n FROM nation) SELECT name, round(depth * sum(len) / sum(least(len, n)), 9) AS depth FROM c, r GROUP BY name, depth")
def adjusted_depths(spark, sf_dir):
    contigs = _table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), "n_nationkey").alias("name"), (1.0 + F.col("n_nationkey")).alias("depth"), (100 + F.col("n_nationkey") * 90).alias("n"))
    out = experiments.adjusted_depths(contigs, _table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 40).cast("long").alias("n")))
    return out.withColumn("depth", F.round("depth", 9))


@query("SELECT p_name AS name, p_size * length(p_name || p_brand) * 1.0 AS weight FROM part")
def contig_weights(spark, sf_dir):
    return channel.contig_weights(_table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("depth"), F.concat("p_name", "p_brand").alias("seq")))


# ---- functions


@query("SELECT o_orderkey, xor(o_orderkey, 4190334876) AS i, xor(o_orderkey % 65536, 63939) AS h, xor(o_orderkey, -449392817811001444) AS q, o_orderkey AS back FROM orders")
def masked_headers(spark, sf_dir):
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_orderkey", B.xor_mask(k, "I").alias("i"), B.xor_mask(k % 65536, "H").alias("h"), B.xor_mask(k, "Q").alias("q"), B.xor_mask(B.xor_mask(k, "I"), "I").alias("back"))


_T8, _T16 = ([int(x) for x in correction._crc_table(letter)] for letter in "BH")
_T32 = []
for _i in range(256):
    for _ in range(8):
        _i = _i >> 1 ^ (0xEDB88320 if _i & 1 else 0)
    _T32.append(_i)
_NAME_BYTES = "list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) AS BIGINT))"


@query(f"""SELECT c_custkey, list_reduce(list_prepend(CAST(0 AS BIGINT), b), lambda c, x: CAST({_T8}[xor(c, x) + 1] AS BIGINT)) AS b, list_reduce(list_prepend(CAST(0 AS BIGINT), b), lambda c, x: CAST(xor(c * 256 % 65536, {_T16}[xor(c // 256, x) + 1]) AS BIGINT)) AS h,
xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: CAST(xor(c // 256, {_T32}[xor(c % 256, x) + 1]) AS BIGINT))) AS l FROM (SELECT c_custkey, {_NAME_BYTES} AS b FROM customer)""")
def checksums(spark, sf_dir):
    """Checksums of 8, 16 and 32 bits."""
    data = F.col("c_name").cast("binary")
    return _table(spark, sf_dir, "customer").select("c_custkey", *[fields.crc(data, letter).alias(letter.lower()) for letter in "BHL"])


@query(f"{_S} SELECT doc_id, chunk_idx, array_to_string(list_transform(regexp_extract_all(left(strand, 40), 'A+|C+|G+|T+'), lambda r: left(r, 1) || length(r)), '') AS runs FROM s")
def run_lengths(spark, sf_dir):
    r = F.array_join(F.transform(B.runs(F.left("strand", F.lit(40))), lambda x: F.concat(x["base"], x["n"])), "")
    return _strands(spark, sf_dir).select("doc_id", "chunk_idx", r.alias("runs"))


@query("SELECT n, round(sum(length(d)) / n, 9) AS digits FROM (SELECT n, CASE WHEN i < 8 THEN '' ELSE CAST(i // 8 % 8 AS VARCHAR) END || CASE WHEN i < 64 THEN '' ELSE CAST(i // 64 % 8 AS VARCHAR) END || CASE WHEN i < 512 THEN '' ELSE 'x' END || i % 8 AS d FROM (SELECT unnest([1, 7, 8, 9, 64, 65, 500, 600, 4000]) AS n), range(4000) t(i) WHERE i < n) GROUP BY n")
def octal_digits(spark, sf_dir):
    rows = spark.createDataFrame([(n,) for n in (1, 7, 8, 9, 64, 65, 500, 600, 4000)], "n int")
    return rows.select("n", F.round(jpeg._octal_digits(F.col("n")), 9).alias("digits"))


@query("""WITH r AS (SELECT i AS x FROM range(2, 1001) t(i)), p AS (SELECT x FROM r WHERE NOT EXISTS (SELECT 1 FROM range(2, 32) d(j) WHERE j * j <= x AND x % j = 0) UNION ALL SELECT 1009)
SELECT x, x IN (SELECT x FROM p) AS is_prime, (SELECT min(p.x) FROM p WHERE p.x >= r.x) AS prime_from, CASE WHEN x <= 20 THEN CAST(factorial(CAST(x AS INTEGER)) / (factorial(CAST(x // 2 AS INTEGER)) * factorial(CAST(x - x // 2 AS INTEGER))) AS BIGINT) ELSE 0 END AS center FROM r WHERE x <= 1000""")
def number_theory(spark, sf_dir):
    return fountain.number_theory(spark, 1000).withColumn("center", F.when(F.col("x") <= 20, F.col("center")).otherwise(0))


def _digest_bases(n: int) -> str:
    text = "sha256('7:' || c_custkey || ':0') || sha256('7:' || c_custkey || ':1')"
    return f"left({''.join('replace(' for _ in S.HEX)}{text}{''.join(f''', '{c}', '{S.pair(i)}')''' for i, c in enumerate(S.HEX))}, {n})"


@query(f"WITH s AS (SELECT c_custkey, {_digest_bases(150)} AS strand FROM customer) SELECT c_custkey, strand, round(CAST({_TOTAL} AS DOUBLE), 6) AS error FROM s")
def random_strands(spark, sf_dir):
    """Strands by chance, the same ones each time, and their errors."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", experiments.random_strand(F.col("c_custkey"), 150, 7).alias("strand"))
    return rows.withColumn("error", F.round(R.default_rules(F.col("strand")), 6))


@query("SELECT p_partkey, 5 * round_even(p_retailprice / 5, 0) AS five FROM part")
def rounded_to_five(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", B.round_to(F.col("p_retailprice"), 5).alias("five"))


_CORNERS = "list_transform(string_split({0}, ''), lambda c: CASE WHEN c IN {1} THEN 5000.0 ELSE 0.0 END)"


@query(f"""WITH r AS (SELECT o_orderkey, {_four('o_orderkey', 10)} AS s FROM orders) SELECT o_orderkey, round(list_reduce({_CORNERS.format('s', "('T', 'C')")}, lambda a, b: (a + b) / 2), 9) AS x, round(list_reduce({_CORNERS.format('s', "('G', 'C')")}, lambda a, b: (a + b) / 2), 9) AS y FROM r""")
def chaos_points(spark, sf_dir):
    last = F.element_at(B.chaos_game(B.base_four(F.col("o_orderkey"), 10)), -1)
    return _table(spark, sf_dir, "orders").select("o_orderkey", last.alias("p")).select("o_orderkey", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))


@query("SELECT p_partkey, round(2.0 * p_size / (p_size + 6), 9) AS density, round(pow(10, -p_size / 10.0), 12) AS error FROM part")
def code_density(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(B.density(F.col("p_size"), 4, 2), 9).alias("density"), F.round(B.phred(F.col("p_size")), 12).alias("error"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ''), lambda c: lpad(bin(ascii(c)), 8, '0')), '') AS bits, p_name AS name FROM part")
def bit_strings(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", B.bits_of(F.col("p_name").cast("binary")).alias("bits"))
    return rows.withColumn("name", F.decode(B.bytes_of(F.col("bits")), "utf-8"))


@query(f"SELECT o_orderkey, translate(left(s, n), 'ACGT', 'CATG') || substr(s, n + 1) AS strand FROM (SELECT o_orderkey, {_four('o_orderkey', 16)} AS s, CAST(ceil(o_custkey % 9 / 8.0 * 16) AS BIGINT) AS n FROM orders)")
def flipped_bases(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", B.flipped(B.base_four(F.col("o_orderkey"), 16), F.col("o_custkey") % 9 / 8).alias("strand"))


@query(f"SELECT p_partkey, p_name, ident, payload FROM (SELECT p_partkey, p_name, {_four('p_partkey', 8)} AS ident, {_four('p_partkey * 7919', 16)} AS payload FROM part)")
def spaced_identifiers(spark, sf_dir):
    """Identifiers spread over payloads, and taken out again."""
    k = F.col("p_partkey")
    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_name", B.unspaced(B.spaced(B.base_four(k, 8), B.base_four(k * 7919, 16), 2), 8, 2).alias("u"))
    return rows.select("p_partkey", "p_name", "u.ident", "u.payload")


# ---- distributions and rules


@query(f"""WITH s AS (SELECT 0.025 * sqrt(200) * pow(ln(200 / 0.001), 2) AS s), r AS (SELECT degree, CASE WHEN degree = 1 THEN 1 / 200.0 ELSE 1.0 / (degree * (degree - 1)) END + CASE WHEN degree < round(200 / s) THEN s / (200 * degree) WHEN degree = round(200 / s) THEN s * ln(s / 0.001) / 200 ELSE 0 END AS p FROM range(1, 200) t(degree), s)
SELECT degree, round(p / sum(p) OVER (), 9) AS p FROM r""")
def spiked_soliton(spark, sf_dir):
    return fountain.spiked_soliton(spark, 200).withColumn("p", F.round("p", 9))


@query("SELECT p_size AS degree, round(sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part), 9) AS p FROM part GROUP BY 1")
def adaptable_distribution(spark, sf_dir):
    weights = _table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("degree")).agg(F.sum("p_retailprice").alias("weight"))
    return fountain.adaptable(weights).withColumn("p", F.round("p", 9))


_UNIT = "greatest(0.0, least(1.0, {}))"
_P = _GC.format("strand")


@query(f"""{_S}, g AS (SELECT doc_id, chunk_idx, CAST({_P} AS DOUBLE) AS p, strand FROM s) SELECT doc_id, chunk_idx, 0.02 AS constant, 0.0 AS illegal, CASE WHEN p NOT BETWEEN 40 AND 60 THEN 1.0 ELSE 0.0 END AS forties,
round({_UNIT.format("(100 + 175 * p / 6 - 121 * p * p / 72 + p * p * p / 36 - p * p * p * p / 7200) / 100")}, 6) AS quartic, round({_UNIT.format("(100 + 49970.8 * p - 2582 * p * p + 41.6458 * p * p * p - 0.208229 * p * p * p * p) / 100")}, 6) AS strict FROM g""")
def gc_penalties(spark, sf_dir):
    s = F.col("strand")
    p, known = S.gc_percent(s), B.rule_functions()
    return _strands(spark, sf_dir).select("doc_id", "chunk_idx", known["constant"](s).alias("constant"), R.illegal_symbols(s).alias("illegal"), R.gc_band(p, 40, 60).alias("forties"), F.round(R.gc_quartic(p), 6).alias("quartic"), F.round(R.gc_strict(p), 6).alias("strict"))


_SIMPLE = ["ACGTAC", "GGATCC", "TTAGGC"]
_TURN = str.maketrans("ACGT", "TGCA")


@query(f"{_S} SELECT doc_id, chunk_idx, CASE WHEN {' OR '.join(f'''contains(strand, '{m}')''' for m in _SIMPLE + [m.translate(_TURN) for m in _SIMPLE])} THEN 1.0 ELSE 0.0 END AS p FROM s")
def any_motif(spark, sf_dir):
    """Any of some motifs or their complements."""
    return _strands(spark, sf_dir).select("doc_id", "chunk_idx", B.any_motif(F.col("strand"), B.with_complements(_SIMPLE)).alias("p"))


@query(f"{_S}, m AS (SELECT doc_id, chunk_idx, unnest(list_transform(generate_series(1, length(strand) - 18), lambda i: substr(strand, i, 19))) AS mer FROM s WHERE length(strand) >= 19), n AS (SELECT mer FROM m GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, chunk_idx, count(*) AS n FROM m JOIN n USING (mer) GROUP BY 1, 2")
def repeated_mers(spark, sf_dir):
    """Packets whose 19-mers come again, in them or in others."""
    return kmers.shared_mers(_strands(spark, sf_dir), ["doc_id", "chunk_idx"], "strand", 19)


_EZ = sorted({x for m, _ in R.MOTIFS for x in (m, m[::-1], m[::-1].translate(_TURN))})


@query(f"{_S} SELECT doc_id, chunk_idx, CASE WHEN {_RUN} > 3 OR {_P} NOT BETWEEN 45 AND 55 OR {' OR '.join(f'''contains(strand, '{m}')''' for m in _EZ)} THEN 1.0 ELSE 0.0 END AS p FROM s")
def oligo_rule(spark, sf_dir):
    return _strands(spark, sf_dir).select("doc_id", "chunk_idx", B.oligo_rule(F.col("strand")).alias("p"))


@query(f"{_S} SELECT doc_id, chunk_idx, CASE WHEN {_RUN} >= 4 THEN 1.0 ELSE 0.0 END + CASE WHEN {_P} NOT BETWEEN 40 AND 60 THEN 1.0 ELSE 0.0 END AS p FROM s")
def chosen_rules(spark, sf_dir):
    """A rule list of one's own: another homopolymer table and another band."""
    rules = [lambda s: R.homopolymer(s, "three_strict"), lambda s: R.gc_band(S.gc_percent(s), 40, 60)]
    return _strands(spark, sf_dir).select("doc_id", "chunk_idx", R.rule_sum(F.col("strand"), rules).alias("p"))


# ---- codecs


@query("SELECT o_orderkey, t || repeat('0', 60) || lpad('202', 20, '0') AS framed FROM (SELECT o_orderkey, " + " || ".join(f"CAST(o_orderkey // {3**i} % 3 AS VARCHAR)" for i in reversed(range(20))) + " AS t FROM orders)")
def framed_trits(spark, sf_dir):
    """Twenty trits framed: at least a window long, their number in twenty trits at the end, and back."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(F.conv(F.col("o_orderkey").cast("string"), 10, 3), 20, "0").alias("t"))
    return rows.select("o_orderkey", ternary.framed(F.col("t")).alias("framed"), "t").where(ternary.unframed(F.col("framed")) == F.col("t")).drop("t")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'X' || substr(c_name, 2) ELSE c_name END AS plain, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS checked, c_name AS repaired FROM customer")
def corrected(spark, sf_dir):
    """Names protected in three ways, of which every third is spoiled, and what comes back."""
    ways = {"plain": (lambda d: d, lambda d: d), "checked": (fields.crc_bytes, fields.crc_checked), "repaired": (fields.rs_encoded, fields.rs_repaired)}
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").cast("binary").alias("data"))
    for out, (protect, restore) in ways.items():
        rows = rows.withColumn(out, protect(F.col("data")))
        rows = rows.withColumn(out, F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("X").cast("binary"), F.substring(out, 2, 1 << 20))).otherwise(F.col(out)))
        rows = rows.withColumn(out, F.decode(restore(F.col(out)), "utf-8"))
    return rows.drop("data")


_CODED4 = "upper(" + "".join("replace(" for _ in fields.WORDS) + "strand" + "".join(f", '{b}', '{w.lower()}')" for b, w in fields.WORDS.items()) + ")"
_NEAR4 = ", ".join(f"('{''.join(w)}', '{b}')" for w in itertools.product("ACGT", repeat=3) for b, c in fields.WORDS.items() if sum(x != y for x, y in zip(w, c)) <= 1)


@query(f"""{_S}, k AS (SELECT doc_id, chunk_idx, {_CODED4} AS coded FROM s), e AS (SELECT doc_id, chunk_idx, CASE WHEN chunk_idx % 3 = 0 THEN coded ELSE substr(coded, 1, 3) || translate(substr(coded, 4, 1), 'ACGT', 'CGTA') || CASE WHEN chunk_idx % 3 = 2 THEN translate(substr(coded, 5, 1), 'ACGT', 'GTAC') ELSE substr(coded, 5, 1) END || substr(coded, 6) END AS coded FROM k),
w AS (SELECT doc_id, chunk_idx, i, substr(coded, i * 3 + 1, 3) AS w FROM (SELECT *, unnest(range(length(coded) // 3)) AS i FROM e)), n AS (SELECT * FROM (VALUES {_NEAR4}) t(w, b))
SELECT doc_id, chunk_idx, CASE WHEN count(b) = count(*) THEN string_agg(b, '' ORDER BY i) END AS strand FROM w LEFT JOIN n USING (w) GROUP BY ALL""")
def strand_words(spark, sf_dir):
    """Strands over GF(4), a third of them with one wrong base and a third with two in one word: set right, or null, or another base."""
    coded = fields.strand_encoded(F.col("strand"))
    rows = _strands(spark, sf_dir).select("doc_id", "chunk_idx", coded.alias("c"))
    piece = lambda a, n: F.substring("c", a, n)
    third = F.when(F.col("chunk_idx") % 3 == 2, F.translate(piece(5, 1), "ACGT", "GTAC")).otherwise(piece(5, 1))
    spoiled = F.when(F.col("chunk_idx") % 3 == 0, F.col("c")).otherwise(F.concat(piece(1, 3), F.translate(piece(4, 1), "ACGT", "CGTA"), third, piece(6, 1 << 20)))
    return rows.select("doc_id", "chunk_idx", fields.strand_repaired(spoiled).alias("strand"))


@query("SELECT doc_id, md5(encode(text)) AS digest FROM documents WHERE length(text) > 0")
def rs_files(spark, sf_dir):
    """Documents as Reed-Solomon chunks with their numbers, those of every twentieth with their first bases flipped, and put together again."""
    coded, strand = correction.rs_file_strands(_table(spark, sf_dir, "documents"), "doc_id", "text", 60, 0.2), F.col("strand")
    sent = coded.select("doc_id", F.when(F.col("doc_id") % 20 == 0, B.flipped(strand, F.lit(0.03))).otherwise(strand).alias("strand"))
    back = correction.rs_strand_data(sent, "doc_id", 60, 0.2)
    return back.select("doc_id", F.md5("data").alias("digest"))


@query("SELECT n_nationkey, replace(r_name || n_name || r_name, n_name, '<b>' || n_name || '</b>') AS html, true AS found FROM nation JOIN region ON n_regionkey = r_regionkey")
def match_report(spark, sf_dir):
    """Assemblies with the strands that they hold set in bold."""
    rows = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    wholes = rows.select(F.col("n_nationkey").cast("long").alias("whole_id"), F.concat("r_name", "n_name", "r_name").alias("seq"))
    parts = rows.select(F.col("n_nationkey").cast("long").alias("part_id"), F.col("n_name").alias("seq"))
    met = wholes.join(parts.withColumnRenamed("seq", "part"), F.expr("whole_id = part_id"))
    return matching.report(met).select(F.col("whole_id").cast("int").alias("n_nationkey"), "html", "found")


@query("""WITH h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE length(text) > 0 ), b AS (SELECT doc_id AS file_id, x, unnest(generate_series(0, (length(x) - 1) // 6016)) AS block FROM h) SELECT file_id, block, md5(unhex(substr(x, block * 6016 + 1, 6016))) AS digest FROM b""")
def streamed_blocks(spark, sf_dir):
    """Packets that come in three files of a stream, every tenth lost, decoded as soon as a block's rank is full."""
    from helixframe.streaming.incremental import decode_stream

    docs, size, block = _table(spark, sf_dir, "documents"), 47, 64
    sent = packets.encode(docs, "doc_id", "text", size, block, 0.6, "raptor", "none").where("seed % 10 != 3").select("file_id", "block", "k", "seed", F.substring("packed", 5, size).alias("payload"))
    path, out = scratch(spark, "stream"), scratch(spark, "solved")
    sent.repartition(3, "seed").write.parquet(path)
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = decode_stream(stream, "raptor").writeStream.format("parquet").option("checkpointLocation", scratch(spark, "state")).option("path", out).trigger(availableNow=True).start()
    run.awaitTermination()
    sizes = packets.source_blocks(docs, "doc_id", "text", size, block).select("file_id", "block", F.octet_length("data").alias("n_bytes"))
    sizes = sizes.withColumn("k", F.greatest(F.lit(4), F.ceil(F.col("n_bytes") / size).cast("int")))
    return packets.assemble(spark.read.schema("file_id long, block long, chunk_idx int, data binary").parquet(out), sizes).select("file_id", "block", F.md5("data").alias("digest"))


_CHANGED = f"WITH RECURSIVE {_B}, p AS (SELECT item_id * 1000 + chunk_idx AS strand_id, strand FROM s), r AS (SELECT strand_id AS id, strand AS seq FROM p UNION ALL SELECT strand_id + 1000000, left(strand, 30) || 'ACG' || substr(strand, 36) FROM p)"


def _changed(spark, sf_dir):
    """All strands of `benchmark`, and each of them changed a little."""
    pool = _pool(spark, sf_dir).select(F.col("strand_id").alias("id"), F.col("strand").alias("seq"))
    return pool.unionByName(pool.select((F.col("id") + 10**6).alias("id"), F.concat(F.left("seq", F.lit(30)), F.lit("ACG"), F.expr("substr(seq, 36)")).alias("seq")))


def _lcs_sql(words: int = 4) -> str:
    """Longest common subsequences of pairs u (a, b, x, y) over masks of 62 places: a step for each letter of y, all pairs at once."""
    full, w = (1 << 62) - 1, range(words)
    masks = ", ".join(f"coalesce(sum(1 << (i % 62)) FILTER (i // 62 = {j}), 0)::BIGINT AS m{j}" for j in w)
    start = ", ".join(f"{full}::BIGINT AS v{j}" for j in w)
    hits = ", ".join(f"coalesce(m{j}, 0) AS m{j}, v{j} & coalesce(m{j}, 0) AS h{j}" for j in w)
    sums, out = "", []
    for j in w:
        sums += f"{', ' if j else ''}v{j} + h{j}{f' + (t{j - 1} >> 62)' if j else ''} AS t{j}"
        out.append(f"((t{j} & {full}) | xor(v{j}, h{j})) AS v{j}")
    return f"""places AS (SELECT a, unnest(generate_series(0, length(x) - 1)) AS i, x FROM (SELECT DISTINCT a, x FROM u)), masks AS (SELECT a, substr(x, i + 1, 1) AS ch, {masks} FROM places GROUP BY ALL),
steps AS (SELECT a, b, x, y, 0 AS i, {start} FROM u UNION ALL SELECT a, b, x, y, i + 1, {', '.join(out)} FROM (SELECT *, {sums} FROM (SELECT steps.a, b, x, y, i, {', '.join(f'v{j}' for j in w)}, {hits} FROM steps LEFT JOIN masks ON masks.a = steps.a AND ch = substr(y, i + 1, 1) WHERE i < length(y)))),
lcs AS (SELECT a, b, x, y, {62 * words} - {' - '.join(f'bit_count(v{j})' for j in w)} AS n FROM steps WHERE i = length(y))"""


@query(f"""{_CHANGED}, u AS (SELECT a.id AS a, b.id AS b, a.seq AS x, b.seq AS y FROM r a JOIN r b ON a.id < b.id AND levenshtein(a.seq, b.seq) < 0.15 * (length(a.seq) + length(b.seq))), {_lcs_sql()},
z AS (SELECT a, b, CAST(2 * n AS DOUBLE) / (length(x) + length(y)) AS score FROM lcs) SELECT b AS read_id, a AS first, round(score, 9) AS score FROM z WHERE score > 0.85 QUALIFY row_number() OVER (PARTITION BY b ORDER BY a) = 1""")
def near_duplicate_reads(spark, sf_dir):
    """Strands of `benchmark` and changed ones: which of them resemble a smaller one.  (No more insertions and deletions than edits, doubled.)"""
    return matching.near_duplicates(_changed(spark, sf_dir).withColumnRenamed("id", "read_id")).withColumn("score", F.round("score", 9))


@query(f"{_CHANGED} SELECT a.id AS a, b.id AS b, CAST(levenshtein(a.seq, b.seq) AS INTEGER) AS distance FROM r a, r b WHERE abs(length(a.seq) - length(b.seq)) <= 12 AND levenshtein(a.seq, b.seq) <= 12")
def edit_distance_pairs(spark, sf_dir):
    """All pairs of strands, changed ones too, within twelve edits, by segments that stay whole; short strands by tiles."""
    rows = _changed(spark, sf_dir)
    return near.edit_join(rows, rows, 12)


@query(f"{_CHANGED}, h AS (SELECT * FROM r WHERE id % 4 = 0), o AS (SELECT id, seq, false AS turned FROM r UNION ALL SELECT id, {_TURNED.format('seq')}, true FROM r) SELECT o.id AS read_id, h.id AS head_id, turned, CAST(levenshtein(o.seq, h.seq) AS INTEGER) AS distance FROM o, h WHERE levenshtein(o.seq, h.seq) <= 40")
def reads_within_heads(spark, sf_dir):
    """Reads against cluster heads, forward and turned: all pairs within forty edits."""
    rows = _changed(spark, sf_dir)
    heads = rows.where("id % 4 = 0")
    one = lambda t, turned: near.within_distance(t, heads, 40).select(F.col("a").alias("read_id"), F.col("b").alias("head_id"), F.lit(turned).alias("turned"), "distance")
    return one(rows, False).unionByName(one(rows.select("id", S.reverse_complement(F.col("seq")).alias("seq")), True))


@query(f"""{_CHANGED}, o AS (SELECT id, CASE WHEN id % 3 = 0 THEN {_TURNED.format('seq')} ELSE seq END AS seq, row_number() OVER (ORDER BY id) AS i FROM r),
near AS (SELECT h.i AS hi, o.i AS i, levenshtein(h.seq, o.seq) > 40 AS turned FROM o JOIN o h ON h.i < o.i AND (levenshtein(h.seq, o.seq) <= 40 OR levenshtein(h.seq, {_TURNED.format('o.seq')}) <= 40)),
n AS (SELECT i, list(hi) AS his FROM near GROUP BY i),
heads AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS hs UNION ALL SELECT heads.i + 1, CASE WHEN list_has_any(hs, coalesce(his, [])) THEN hs ELSE list_append(hs, heads.i + 1) END FROM heads LEFT JOIN n ON n.i = heads.i + 1 WHERE heads.i < (SELECT max(i) FROM o)),
final AS (SELECT unnest(hs) AS hi FROM heads WHERE i = (SELECT max(i) FROM o)), m AS (SELECT near.i, near.hi, turned FROM near JOIN final USING (hi) WHERE near.i NOT IN (SELECT hi FROM final) QUALIFY row_number() OVER (PARTITION BY near.i ORDER BY near.hi) = 1)
SELECT h.id AS cluster_id, o.id AS read_id, turned AS is_reversed, false AS is_head FROM m JOIN o USING (i) JOIN o h ON h.i = m.hi UNION ALL SELECT id, id, false, true FROM o JOIN final ON o.i = final.hi""")
def leader_clusters(spark, sf_dir):
    """Strands and changed ones, every third one turned, clustered by the first-fit rule."""
    rows = _changed(spark, sf_dir)
    seq = F.when(F.col("id") % 3 == 0, S.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return clusters.leaders(rows.select(F.col("id").alias("read_id"), seq.alias("seq")), 40)


@rows_only
def close_matches(spark, sf_dir):
    pool = _pool(spark, sf_dir).where(F.length("strand") > 40)
    known = pool.select(F.col("strand_id").alias("known_id"), F.col("strand").alias("seq"))
    return matching.close_matches(pool.select(F.col("strand_id").alias("id"), F.concat(F.lit("ACG"), F.expr("substr(strand, 8)")).alias("seq")), known, 0.6, 16)


@query(f"SELECT o_orderkey, o_custkey % 50 AS part, {_four('o_orderkey', 12)} AS strand FROM orders")
def parts_by_index(spark, sf_dir):
    """Strands that carry the number of their part, and are dealt by it again."""
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", files.part_of(files.with_part(B.base_four(k, 12), F.col("o_custkey") % 50, 50), 50).alias("p"))
    return rows.select("o_orderkey", "p.part", "p.strand")


_LONG = 4 * CHUNK + 4


@query(f"""{_S.replace('WITH', 'WITH RECURSIVE', 1)}, q AS (SELECT doc_id AS id, string_agg(left('ACGTTGCATGACCATG', CAST((chunk_idx * 7 + doc_id) % 15 AS BIGINT)) || strand || {_CHECK_BASES}, '' ORDER BY chunk_idx) AS seq FROM s GROUP BY doc_id),
x AS (SELECT id, unnest(string_split(seq, '')) AS ch, unnest(generate_series(0, length(seq) - 1)) AS start FROM q WHERE length(seq) > 0), y AS (SELECT id, start, instr('ACGT', ch) AS v, {' AND '.join(f'coalesce(ch = lead(ch, {i}) OVER o, false)' for i in range(1, 5))} AS run FROM x WINDOW o AS (PARTITION BY id ORDER BY start)),
z AS (SELECT id, start, sum(v) OVER (o ROWS BETWEEN CURRENT ROW AND {_LONG - 5} FOLLOWING) % 256 AS total, {' + '.join(f'(lead(v, {_LONG - 4 + i}) OVER o - 1) * {4 ** (3 - i)}' for i in range(4))} AS told, sum(CAST(v IN (2, 3) AS INTEGER)) OVER (o ROWS BETWEEN CURRENT ROW AND {_LONG - 1} FOLLOWING) AS gc, sum(CAST(run AS INTEGER)) OVER (o ROWS BETWEEN CURRENT ROW AND {_LONG - 5} FOLLOWING) AS runs FROM y WINDOW o AS (PARTITION BY id ORDER BY start)),
g AS MATERIALIZED (SELECT id, start, substr(seq, start + 1, {_LONG}) AS coded FROM z JOIN q USING (id) WHERE total = told AND runs = 0 AND 100.0 * gc / {_LONG} BETWEEN 30 AND 70),
t AS (SELECT id, min(start) AS start FROM g GROUP BY id UNION ALL SELECT t.id, min(g.start) FROM t JOIN g ON g.id = t.id AND g.start >= t.start + {_LONG} GROUP BY t.id)
SELECT id, start, coded AS strand, CAST(xor({' + '.join(f"(instr('ACGT', substr(coded, {i + 1}, 1)) - 1) * {4 ** (7 - i)}" for i in range(8))}, {packet_table.SEED_MASK}) AS INTEGER) AS seed FROM g JOIN t USING (id, start)""")
def found_packets(spark, sf_dir):
    """Each document's strands with checksums as one sequence, with other bases between them: what is found from the left."""
    whole = windows.spaced_packets(_table(spark, sf_dir, "documents"), "doc_id", "text", CHUNK, "ACGTTGCATGACCATG", 7, 15)
    return windows.found_packets(whole, _LONG)


@rows_only
def decoding_curve(spark, sf_dir):
    """How many blocks of documents are solved with so many packets over their chunks."""
    curve = files.rank_curves(packets.block_seeds(_table(spark, sf_dir, "documents"), "doc_id", "text", CHUNK, 64, 0.3))
    return curve.groupBy((F.col("n") - F.col("k")).alias("over")).agg(F.count("*").alias("n"), F.count_if(F.col("solved") == F.col("k")).alias("n_solved"))
