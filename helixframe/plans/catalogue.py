"""Queries over the driver's tables and the SQL that must agree with them."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import rules as R
from helixframe.functions import strand as S
from helixframe.operators import fountain
from helixframe.operators.chunks import chunks, strands, xor_lanes
from helixframe.operators.kmers import block_bases, kmer_counts as kmer_counts_of
from helixframe.shipping import ship
from helixframe.sources.tables import read

CHUNK = 47
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _with_package(f):
    """The query, whose workers can import this package."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(ship(spark), sf_dir)

    return run


def query(sql: str):
    def add(f):
        SQL[f.__name__] = sql
        return rows_only(f)

    return add


def rows_only(f):
    """A query that SQL can't express; it is tested against other means."""
    QUERIES[f.__name__] = _with_package(f)
    return QUERIES[f.__name__]


def _hexed(table: str, key: str) -> str:
    digits = "h"
    for i, c in enumerate(S.HEX):
        digits = f"replace({digits}, '{c}', '{S.pair(i)}')"
    return f"""h0 AS (SELECT {key}, lower(hex(encode(text))) AS x FROM {table} WHERE length(text) > 0),
h1 AS (SELECT {key}, x, unnest(generate_series(0, CAST(ceil(length(x) / {2 * CHUNK}.0) AS BIGINT) - 1)) AS chunk_idx FROM h0),
c AS (SELECT {key}, chunk_idx, substr(x, chunk_idx * {2 * CHUNK} + 1, {2 * CHUNK}) AS h FROM h1),
s AS (SELECT {key}, chunk_idx, h, {digits} AS strand FROM c)"""


_S = "WITH " + _hexed("documents", "doc_id")
_GC = "100.0 * (length({0}) - length(translate({0}, 'GC', ''))) / length({0})"
_RUN = "coalesce(list_max(list_transform(regexp_extract_all(strand, 'A+|C+|G+|T+'), lambda x: length(x))), 0)"
_KMERS = "list_transform(generate_series(1, length(strand) - {0} + 1), lambda i: substr(strand, i, {0}))"
_CHECK = "((length(strand) - length(replace(strand, 'A', ''))) + 2 * (length(strand) - length(replace(strand, 'C', ''))) + 3 * (length(strand) - length(replace(strand, 'G', ''))) + 4 * (length(strand) - length(replace(strand, 'T', '')))) % 256"
_CHECK_BASES = " || ".join(f"substr('ACGT', CAST(({_CHECK}) // {4**i} % 4 + 1 AS BIGINT), 1)" for i in (3, 2, 1, 0))


def _strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strands(read(spark, sf_dir, "documents"), "doc_id", "text", CHUNK)


@query(f"{_S} SELECT doc_id, chunk_idx, strand FROM s")
def strand_encode(spark, sf_dir):
    return _strands(spark, sf_dir)


@query(f"{_S} SELECT doc_id, chunk_idx, h AS chunk_hex FROM s")
def strand_decode_roundtrip(spark, sf_dir):
    return _strands(spark, sf_dir).select("doc_id", "chunk_idx", F.lower(F.hex(S.from_strand(F.col("strand")))).alias("chunk_hex"))


@query(f"{_S} SELECT doc_id, chunk_idx, reverse(translate(strand, 'ACGT', 'TGCA')) AS strand FROM s")
def reverse_complement(spark, sf_dir):
    return _strands(spark, sf_dir).withColumn("strand", S.reverse_complement(F.col("strand")))


@query(f"{_S} SELECT doc_id, {', '.join(f'''CAST(sum(length(strand) - length(replace(strand, '{b}', ''))) AS BIGINT) AS n_{b.lower()}''' for b in 'ACGT')} FROM s GROUP BY doc_id")
def base_counts(spark, sf_dir):
    return _strands(spark, sf_dir).groupBy("doc_id").agg(*[F.sum(S.count_of(F.col("strand"), b)).alias(f"n_{b.lower()}") for b in "ACGT"])


@query(f"{_S} SELECT doc_id, chunk_idx, round({_GC.format('strand')}, 6) AS gc FROM s")
def gc_content(spark, sf_dir):
    return _strands(spark, sf_dir).select("doc_id", "chunk_idx", F.round(S.gc_percent(F.col("strand")), 6).alias("gc"))


@query(f"{_S} SELECT doc_id, chunk_idx, CAST({_RUN} AS BIGINT) AS run, CASE WHEN {_RUN} >= 5 THEN 1.0 ELSE 0.0 END AS p FROM s")
def homopolymer_run(spark, sf_dir):
    s = F.col("strand")
    return _strands(spark, sf_dir).select("doc_id", "chunk_idx", S.longest_run(s).alias("run"), R.homopolymer(s).alias("p"))


def _unit_sql(unit: int) -> str:
    return f"""{_S}, u AS (SELECT doc_id, chunk_idx, unnest(generate_series(0, length(strand) // {unit} - 1)) AS i, strand FROM s),
v AS (SELECT doc_id, chunk_idx, i, substr(strand, i * {unit} + 1, {unit}) AS w FROM u),
g AS (SELECT doc_id, chunk_idx, w, i - row_number() OVER (PARTITION BY doc_id, chunk_idx, w ORDER BY i) AS isle FROM v),
r AS (SELECT doc_id, chunk_idx, count(*) AS n FROM g GROUP BY doc_id, chunk_idx, w, isle)
SELECT doc_id, chunk_idx, max(n) AS run, round(greatest(0.0, least(1.0, 0.00002 * max(n) * max(n) - 0.0001 * max(n))), 9) AS p FROM r GROUP BY doc_id, chunk_idx"""


@query(_unit_sql(2))
def microsatellite_2(spark, sf_dir):
    s = F.col("strand")
    return _strands(spark, sf_dir).select("doc_id", "chunk_idx", S.unit_run(s, 2).alias("run"), F.round(R.unit_runs(s, 2), 9).alias("p"))


@query(_unit_sql(3))
def microsatellite_3(spark, sf_dir):
    s = F.col("strand")
    return _strands(spark, sf_dir).select("doc_id", "chunk_idx", S.unit_run(s, 3).alias("run"), F.round(R.unit_runs(s, 3), 9).alias("p"))


_WINDOW = f"list_max(list_transform(generate_series(0, length(strand) - 1, 50), lambda i: CASE WHEN {_GC.format('substr(strand, i + 1, 50)')} NOT BETWEEN 30 AND 70 THEN 1.0 ELSE 0.0 END))"


@query(f"{_S} SELECT doc_id, chunk_idx, CAST({_WINDOW} AS DOUBLE) AS p FROM s")
def windowed_gc(spark, sf_dir):
    return _strands(spark, sf_dir).select("doc_id", "chunk_idx", R.windowed_gc(F.col("strand")).alias("p"))


_MOTIFS = "least(1.0, " + " + ".join(f"CASE WHEN contains(strand, '{m}') THEN {p} ELSE 0 END" for m, p in R.MOTIFS) + ")"
_IUPAC = "least(1.0, " + " + ".join(f"CASE WHEN regexp_matches(strand, '{R.iupac_pattern(m)}') THEN {p} ELSE 0 END" for m, p in R.IUPAC_MOTIFS) + ")"


@query(f"{_S} SELECT doc_id, chunk_idx, round(CAST({_MOTIFS} AS DOUBLE), 6) AS p_motif, round(CAST({_IUPAC} AS DOUBLE), 6) AS p_iupac FROM s")
def motif_search(spark, sf_dir):
    s = F.col("strand")
    return _strands(spark, sf_dir).select("doc_id", "chunk_idx", F.round(R.motifs(s), 6).alias("p_motif"), F.round(R.iupac_motifs(s), 6).alias("p_iupac"))


@query(f"""{_S}, k AS (SELECT doc_id, chunk_idx, length(strand) AS n, {_KMERS.format(20)} AS k20, {_KMERS.format(9)} AS k9 FROM s)
SELECT doc_id, chunk_idx, CASE WHEN len(k20) > len(list_distinct(k20)) THEN 1.0 ELSE 0.0 END AS p_region,
round(CASE WHEN 9.0 * (1 + len(k9) - len(list_distinct(k9))) / n > 0.44 THEN 1.0 ELSE 9.0 * (1 + len(k9) - len(list_distinct(k9))) / n * 0.5 END, 6) AS p_small FROM k""")
def repeat_regions(spark, sf_dir):
    s = F.col("strand")
    return _strands(spark, sf_dir).select("doc_id", "chunk_idx", R.repeat_region(s).alias("p_region"), F.round(R.small_repeats(s), 6).alias("p_small"))


@query(f"""{_S} SELECT doc_id, chunk_idx, {', '.join(f"round(least({10 * p}, floor((length(strand) - length(replace(strand, '{b}', ''))) / 20.0) * {p}), 6) AS p_{b.lower()}" for b, p in zip('ACGT', (0.001, 0.002, 0.002, 0.001)))},
round(CASE WHEN length(strand) >= 117 THEN least(0.2, 0.00144363 * exp(0.0140971 * length(strand))) ELSE 0 END, 6) AS p_long FROM s""")
def base_permutation(spark, sf_dir):
    s = F.col("strand")
    return _strands(spark, sf_dir).select("doc_id", "chunk_idx", *[F.round(R.permutation(s, b), 6).alias(f"p_{b.lower()}") for b in "ACGT"], F.round(R.long_strand(s), 6).alias("p_long"))


_TOTAL = f"CASE WHEN {_RUN} >= 5 THEN 1.0 ELSE 0.0 END + CASE WHEN {_GC.format('strand')} NOT BETWEEN 30 AND 70 THEN 1.0 ELSE 0.0 END + {_WINDOW} + {_MOTIFS}"


@query(f"{_S} SELECT doc_id, chunk_idx, round(CAST({_TOTAL} AS DOUBLE), 6) AS error_prob FROM s ORDER BY error_prob, doc_id, chunk_idx LIMIT 100")
def rule_sum_topk(spark, sf_dir):
    rows = _strands(spark, sf_dir).select("doc_id", "chunk_idx", F.round(R.default_rules(F.col("strand")), 6).alias("error_prob"))
    return rows.orderBy("error_prob", "doc_id", "chunk_idx").limit(100)


@query(f"{_S} SELECT doc_id, chunk_idx, strand || {_CHECK_BASES} AS strand FROM s")
def checksum_encode(spark, sf_dir):
    return _strands(spark, sf_dir).withColumn("strand", S.with_checksum(F.col("strand")))


@query(f"{_S} SELECT chunk_idx % 2 AS spoiled, count(*) AS n, CAST(count(*) FILTER (length(strand) = {4 * CHUNK} AND (chunk_idx % 2 = 0 OR left(strand, 1) = 'A')) AS BIGINT) AS n_ok FROM s GROUP BY 1")
def checksum_verify(spark, sf_dir):
    """Strands with a checksum, of which every other one has its first base changed to A."""
    coded = F.col("coded")
    rows = _strands(spark, sf_dir).select((F.col("chunk_idx") % 2).alias("spoiled"), S.with_checksum(F.col("strand")).alias("coded"))
    rows = rows.select("spoiled", F.when(F.col("spoiled") == 1, F.concat(F.lit("A"), F.substring(coded, 2, 1 << 20))).otherwise(coded).alias("coded"))
    return rows.groupBy("spoiled").agg(F.count("*").alias("n"), F.count_if(S.checksum_ok(F.col("coded"), 4 * CHUNK)).alias("n_ok"))


@query(f"{_S} SELECT kmer, count(*) AS n FROM (SELECT unnest({_KMERS.format(6)}) AS kmer FROM s) GROUP BY kmer")
def kmer_counts(spark, sf_dir):
    return kmer_counts_of(_strands(spark, sf_dir), "strand", 6)


@query(f"""{_S}, b AS (SELECT chunk_idx, unnest(generate_series(0, (length(strand) - 1) // 32)) AS block, strand FROM s), p AS (SELECT block, substr(strand, block * 32 + 1, 32) AS w FROM b)
SELECT block, {', '.join(f"round(sum(length(w) - length(replace(w, '{c}', ''))) / sum(length(w)), 9) AS {c.lower()}" for c in 'ACGT')} FROM p GROUP BY block""")
def base_density_blocks(spark, sf_dir):
    rows = block_bases(_strands(spark, sf_dir), "strand", 32)
    return rows.select("block", *[F.round(F.col(c) / F.col("n"), 9).alias(c) for c in "acgt"])


@query(f"{_S} SELECT doc_id, chunk_idx FROM s WHERE length(strand) > {4 * CHUNK} - 5 AND length(strand) < {4 * CHUNK} + 50")
def length_band_filter(spark, sf_dir):
    n = F.length("strand")
    return _strands(spark, sf_dir).where((n > 4 * CHUNK - 5) & (n < 4 * CHUNK + 50)).select("doc_id", "chunk_idx")


@query(f"{_S} SELECT s.doc_id, count(*) AS n_shared FROM s WHERE EXISTS (SELECT 1 FROM s t WHERE t.strand = s.strand AND t.doc_id != s.doc_id) GROUP BY s.doc_id")
def exact_matches(spark, sf_dir):
    """Strands that other documents have too: a semi-join on the strand, by counting documents instead of pairs."""
    rows = _strands(spark, sf_dir).select("doc_id", F.unhex(F.md5("strand")).alias("digest"))  # what is shuffled: 16 bytes, not the strand
    rows = rows.repartition("digest")  # once, for the counts and for the join
    shared = rows.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo != hi").select("digest")
    return rows.join(shared, "digest", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_shared"))


@query(f"""{_S}, l AS (SELECT doc_id, unnest(generate_series(0, (length(h) + 7) // 8 - 1)) AS lane, h FROM c),
v AS (SELECT doc_id, lane, CAST('0x' || rpad(substr(h, lane * 8 + 1, 8), 8, '0') AS BIGINT) AS v FROM l) SELECT doc_id, lane, bit_xor(v) AS value FROM v GROUP BY doc_id, lane""")
def xor_symbols(spark, sf_dir):
    return xor_lanes(chunks(read(spark, sf_dir, "documents"), "doc_id", "text", CHUNK), "doc_id")


@query("SELECT byte, count(*) AS n FROM (SELECT substr(x, 2 * i + 1, 2) AS byte FROM (SELECT x, unnest(generate_series(0, length(x) // 2 - 1)) AS i FROM (SELECT hex(encode(text)) AS x FROM documents WHERE length(text) > 0))) GROUP BY byte")
def huffman_frequencies(spark, sf_dir):
    data = read(spark, sf_dir, "documents").select(F.hex(F.col("text").cast("binary")).alias("x")).where("length(x) > 0")
    return data.select(F.explode(F.regexp_extract_all("x", F.lit("(..)"), F.lit(1))).alias("byte")).groupBy("byte").agg(F.count("*").alias("n"))


_K = 120
_LDPC, _HALF = fountain.symbol_counts(_K)
_LDPC_SQL = f"SELECT (i % {_LDPC} + j * (1 + i // {_LDPC} % {_LDPC - 1})) % {_LDPC} AS symbol_idx, i AS source_idx FROM range({_K}) t(i), range(3) u(j) GROUP BY 1, 2 HAVING count(*) % 2 = 1"
_WEIGHT = (_HALF + 1) // 2
_GRAY_SQL = f"SELECT row_number() OVER (ORDER BY i) - 1 AS idx, code FROM (SELECT i, xor(i, i >> 1) AS code FROM range(4096) t(i)) WHERE bit_count(code) = {_WEIGHT} QUALIFY idx < {_K + _LDPC}"


@query(_LDPC_SQL)
def ldpc_edges(spark, sf_dir):
    return fountain.ldpc_edges(spark, _K)


@query(_GRAY_SQL)
def gray_sequence(spark, sf_dir):
    return fountain.gray_sequence(spark, _K + _LDPC, _WEIGHT)


@query(f"SELECT j AS symbol_idx, idx AS source_idx FROM ({_GRAY_SQL}), range({_HALF}) u(j) WHERE (code >> j) & 1 = 1")
def half_edges(spark, sf_dir):
    return fountain.half_edges(spark, _K)


@query(f"""WITH used AS (SELECT DISTINCT o_orderkey AS packet_id, (o_orderkey * 7919 + j * (1 + o_custkey % 97)) % {_K + _LDPC} AS symbol_idx FROM orders, range(6) u(j)),
e AS ({_LDPC_SQL}), x AS (SELECT * FROM used WHERE symbol_idx < {_K} UNION ALL SELECT packet_id, source_idx FROM used JOIN e ON used.symbol_idx = e.symbol_idx + {_K})
SELECT packet_id, symbol_idx FROM x GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def aux_cancellation(spark, sf_dir):
    """Packets with arithmetic seeds from `orders`: auxiliary symbols replaced by their sources."""
    packet, step = F.col("o_orderkey"), 1 + F.col("o_custkey") % 97
    used = F.array(*[(packet * 7919 + j * step) % (_K + _LDPC) for j in range(6)])
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(packet.alias("packet_id"), used.alias("symbols"))
    return fountain.cancelled_sets(rows, fountain.ldpc_edges(spark, _K), _K, _K + _LDPC)


@query("SELECT degree, round(CASE WHEN degree = 1 THEN 1 / 100.0 ELSE 1.0 / (degree * (degree - 1)) END, 12) AS p FROM range(1, 100) t(degree)")
def ideal_soliton(spark, sf_dir):
    return fountain.ideal_soliton(spark, 100).withColumn("p", F.round("p", 12))


@query(f"""WITH r AS (SELECT degree, CASE WHEN degree = 1 THEN 1 / 100.0 ELSE 1.0 / (degree * (degree - 1)) END + CASE WHEN degree < 8 THEN 1.0 / (degree * 8) WHEN degree = 8 THEN {math.log(100 / 8 / 0.5) / 8!r} ELSE 0 END AS p FROM range(1, 100) t(degree))
SELECT degree, round(p / sum(p) OVER (), 9) AS p FROM r""")
def robust_soliton(spark, sf_dir):
    return fountain.robust_soliton(spark, 100, 8, 0.5).withColumn("p", F.round("p", 9))


@query("""WITH c AS (SELECT ceil(ln(0.1 * 0.1 / 4) / ln(1 - 0.05)) AS s), q AS (SELECT s, 1 - (1 + 1 / s) / 1.1 AS p1 FROM c),
r AS (SELECT degree, CASE WHEN degree = 1 THEN p1 ELSE (1 - p1) * s / ((s - 1) * degree * (degree - 1)) END AS p FROM q, range(1, 118) t(degree)) SELECT degree, round(p / sum(p) OVER (), 9) AS p FROM r""")
def online_distribution(spark, sf_dir):
    return fountain.online_distribution(spark, 0.1).withColumn("p", F.round("p", 9))


@query(f"""WITH s AS (SELECT {''.join('replace(' for _ in S.HEX)}printf('%02x%02x', i % 256, i // 256){''.join(f", '{c}', '{S.pair(i)}')" for i, c in enumerate(S.HEX))} AS strand FROM range(65536) t(i))
SELECT count(*) AS n, count(*) FILTER (regexp_matches(strand, 'AAAA|CCCC|GGGG|TTTT')) AS impossible FROM s""")
def impossible_seeds_16(spark, sf_dir):
    """Seeds of 16 bits, low byte first, whose bases have a run over three."""
    digits = F.concat(F.lpad(F.hex(F.col("id") % 256), 2, "0"), F.lpad(F.hex(F.shiftright("id", 8)), 2, "0"))
    run = S.longest_run(S.hex_to_strand(F.lower(digits)))
    return spark.range(1 << 16).agg(F.count("*").alias("n"), F.count_if(run > 3).alias("impossible"))


@query("SELECT user_id, event_id, round(m, 6) AS mean FROM (SELECT user_id, event_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5")
def sliding_mean(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(0, 4)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.avg("value").over(w).alias("m"), F.count("*").over(w).alias("n"))
    return rows.where("n = 5").select("user_id", "event_id", F.round("m", 6).alias("mean"))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY event_type")
def log_quartiles(spark, sf_dir):
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), q.alias("q"))
    return rows.select("event_type", "n", *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)])
