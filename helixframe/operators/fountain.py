"""Fountain codes as relations: intermediate symbols as edges, degree distributions as tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.strand import BASES, hex_to_strand


def prime_from(x: int) -> int:
    """The smallest prime that is not below x."""
    while x < 2 or any(x % d == 0 for d in range(2, math.isqrt(x) + 1)):
        x += 1
    return x


def symbol_counts(k: int) -> tuple[int, int]:
    """Numbers of LDPC and of Half symbols for k source symbols (RFC 5053, 5.4.2.3)."""
    x = next(i for i in range(1, 2 * k + 3) if i * (i - 1) >= 2 * k)
    s = prime_from(math.ceil(k / 100) + x)
    h = next(i for i in range(1, 64) if math.comb(i, (i + 1) // 2) >= k + s)
    return s, h


def ldpc_edges(spark: SparkSession, k: int) -> DataFrame:
    """(symbol_idx, source_idx): each source symbol is in three LDPC symbols; an edge that comes twice cancels."""
    s, _ = symbol_counts(k)
    rows = spark.range(k).withColumn("a", 1 + F.floor(F.col("id") / s) % (s - 1)).withColumn("b", F.col("id") % s)
    rows = rows.select(F.col("id").alias("source_idx"), F.explode(F.array(*[(F.col("b") + i * F.col("a")) % s for i in range(3)])).alias("symbol_idx"))
    return rows.groupBy("symbol_idx", "source_idx").count().where("count % 2 = 1").select("symbol_idx", "source_idx")


def gray_sequence(spark: SparkSession, length: int, weight: int) -> DataFrame:
    """(idx, code): the first Gray codes with `weight` bits set."""
    size = 1 << next(b for b in range(weight, 64) if math.comb(b, weight) >= length)
    code = spark.range(size).select("id", F.col("id").bitwiseXOR(F.shiftright("id", 1)).alias("code")).where(F.bit_count("code") == weight)
    return code.select((F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("idx"), "code").where(F.col("idx") < length)


def half_edges(spark: SparkSession, k: int) -> DataFrame:
    """(symbol_idx, source_idx): Half symbol i holds those of the k + s symbols before it whose Gray code has bit i."""
    s, h = symbol_counts(k)
    bits = gray_sequence(spark, k + s, (h + 1) // 2).select(F.col("idx").alias("source_idx"), "code", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("symbol_idx"))
    return bits.where("shiftright(code, symbol_idx) & 1 = 1").select(F.col("symbol_idx").cast("long").alias("symbol_idx"), "source_idx")


def cancelled(used: DataFrame, edges: DataFrame, first: int) -> DataFrame:
    """Replace auxiliary symbols (index `first` and on) by their sources; what comes an even number of times cancels.

    used: (packet_id, symbol_idx); edges: (symbol_idx, source_idx) with symbol_idx from 0.  Returns (packet_id, symbol_idx).
    """
    plain = used.where(F.col("symbol_idx") < first)
    known = edges.withColumn("symbol_idx", F.col("symbol_idx") + first)
    other = used.where(F.col("symbol_idx") >= first).join(known, "symbol_idx").select("packet_id", F.col("source_idx").alias("symbol_idx"))
    return plain.unionByName(other).groupBy("packet_id", "symbol_idx").count().where("count % 2 = 1").select("packet_id", "symbol_idx")


def masks(symbols: Column, width: int) -> Column:
    """Whole numbers up to `width` as the bits of as many longs as it takes, _m0 and on; a number that comes twice is one bit."""
    nothing = F.lit(0).cast("long")

    def word(i):
        bit = lambda x: F.when((x >= 64 * i) & (x < 64 * i + 64), F.call_function("shiftleft", F.lit(1).cast("long"), (x - 64 * i).cast("int"))).otherwise(nothing)
        return F.aggregate(symbols, nothing, lambda m, x: m.bitwiseOR(bit(x)))

    return F.struct(*[word(i).alias(f"_m{i}") for i in range(-(-width // 64))])


def cancelled_sets(used: DataFrame, edges: DataFrame, first: int, width: int) -> DataFrame:
    """cancelled() of (packet_id, symbols), sets of symbols below `width`; the sets of a packet that comes again are one.

    A packet is a row of bits from the shuffle on, and its symbols are rows only when they are done.  Packets are dealt before they are
    aggregated, so that no task holds those of a whole file.
    """
    rows = [(r["symbol_idx"], r["source_idx"]) for r in edges.collect()]  # the code's edges, whatever the data
    change = np.zeros((width - first, first), np.float32)
    for aux, source in rows:
        change[aux, source] += 1
    words = [f"_m{i}" for i in range(-(-width // 64))]
    kind = used.schema["packet_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1 << 14):
                part = batch.slice(at, 1 << 14)
                held = np.stack([part.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(words))], axis=1).astype("<i8")
                bits = np.unpackbits(held.view(np.uint8), axis=1, bitorder="little")
                odd = (bits[:, :first] + (bits[:, first:width].astype(np.float32) @ change).astype(np.int64)) % 2
                row, symbol = np.nonzero(odd)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(symbol)], ["packet_id", "symbol_idx"])

    dealt = used.repartition("packet_id").select("packet_id", masks(F.col("symbols"), width).alias("_m")).select("packet_id", "_m.*")
    return dealt.groupBy("packet_id").agg(*[F.bit_or(c).alias(c) for c in words]).mapInArrow(run, f"packet_id {kind}, symbol_idx long")


def _normalised(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy()))


def ideal_soliton(spark: SparkSession, n: int) -> DataFrame:
    """(degree, p)."""
    d = F.col("id")
    return spark.range(1, n).select(d.alias("degree"), F.when(d == 1, 1 / n).otherwise(1 / (d * (d - 1))).alias("p"))


def robust_soliton(spark: SparkSession, n: int, k: int, delta: float) -> DataFrame:
    """The ideal one with a spike at degree k, normalised."""
    d = F.col("degree")
    extra = F.when(d < k, 1 / (d * k)).when(d == k, math.log(n / k / delta) / k).otherwise(0.0)
    return _normalised(ideal_soliton(spark, n).select("degree", (F.col("p") + extra).alias("p")))


def spiked_soliton(spark: SparkSession, k: int, c: float = 0.025, delta: float = 0.001) -> DataFrame:
    """The robust soliton distribution with its spike at round(k / s), s = c sqrt(k) ln(k / delta) ** 2; degrees below k, normalised."""
    s = c * math.sqrt(k) * math.log(k / delta) ** 2
    spike, d = round(k / s), F.col("degree")
    extra = F.when(d < spike, s / (k * d)).when(d == max(spike, 1), s * math.log(s / delta) / k).otherwise(0.0)
    return _normalised(ideal_soliton(spark, k).select("degree", (F.col("p") + extra).alias("p")))


def adaptable(weights: DataFrame) -> DataFrame:
    """(degree, p) of any weights (degree, weight)."""
    return _normalised(weights.select("degree", F.col("weight").alias("p")))


def differences(rows: DataFrame, at: str = "degree", x: str = "p") -> DataFrame:
    """A distribution's first differences, by which it is crossed and changed; the first entry stays."""
    return rows.select(at, (F.col(x) - F.coalesce(F.lag(x).over(Window.orderBy(at)), F.lit(0.0))).alias(x))


def accumulated(rows: DataFrame, at: str = "degree", x: str = "p") -> DataFrame:
    """The inverse of differences()."""
    return rows.select(at, F.sum(x).over(Window.orderBy(at)).alias(x))


def number_theory(spark: SparkSession, most: int) -> DataFrame:
    """(x, is_prime, prime_from, center): for x up to `most`, whether it is prime, the smallest prime not below it, and x over floor(x / 2) for x up to 60."""
    rows = spark.range(2, 2 * most + 4)
    divided = rows.alias("a").join(spark.range(2, math.isqrt(2 * most + 4) + 1).alias("b"), F.expr("b.id * b.id <= a.id AND a.id % b.id = 0")).select("a.id").distinct()
    primes = rows.join(divided, "id", "left_anti").select(F.col("id").alias("prime"))
    upwards = F.min("prime").over(Window.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0))
    every = rows.join(primes, F.expr("id = prime"), "left").select(F.col("id").alias("x"), "prime").select("x", F.col("prime").isNotNull().alias("is_prime"), upwards.alias("prime_from"))
    center = F.when(F.col("x") <= 60, F.element_at(F.array(*[F.lit(math.comb(i, i // 2)) for i in range(1, 61)]), F.least(F.col("x"), F.lit(60)).cast("int")))
    return every.where(f"x <= {most}").select("x", "is_prime", "prime_from", center.cast("long").alias("center"))


def impossible_seeds(spark: SparkSession, longest: int = 3) -> DataFrame:
    """(n, impossible) over all seeds of 32 bits: how many have a run over `longest` as bases.

    Halves of 16 bits are counted by whether they have such a run, and by their first and last run; pairs of these few kinds are put together.
    """
    digits = F.lower(F.lpad(F.hex("id"), 4, "0"))
    s = F.col("s")
    halves = spark.range(1 << 16).select(hex_to_strand(digits).alias("s"))
    over = s.rlike("|".join(f"{b}{{{longest + 1}}}" for b in BASES))
    first, last = F.regexp_extract(s, "^(A+|C+|G+|T+)", 1), F.regexp_extract(s, "(A+|C+|G+|T+)$", 1)
    kinds = halves.groupBy(over.alias("over"), first.alias("first"), last.alias("last")).agg(F.count("*").alias("c"))
    a, b = kinds.toDF("over_a", "_f", "tail", "n_a"), kinds.toDF("over_b", "head", "_l", "n_b")
    met = (F.left("tail", F.lit(1)) == F.left("head", F.lit(1))) & (F.length("tail") + F.length("head") > longest)
    pairs = a.crossJoin(b)  # kinds of halves: a few hundred by a few hundred, whatever the data
    bad = F.col("over_a") | F.col("over_b") | met
    n = F.col("n_a") * F.col("n_b")
    return pairs.agg(F.sum(n).alias("n"), F.sum(F.when(bad, n).otherwise(0)).alias("impossible"))


def online_distribution(spark: SparkSession, eps: float) -> DataFrame:
    """(degree, p) of the online code."""
    s = math.ceil(math.log(eps * eps / 4) / math.log(1 - eps / 2))
    p1 = 1 - (1 + 1 / s) / (1 + eps)
    d = F.col("id")
    return _normalised(spark.range(1, s + 1).select(d.alias("degree"), F.when(d == 1, p1).otherwise((1 - p1) * s / ((s - 1) * d * (d - 1))).alias("p")))
