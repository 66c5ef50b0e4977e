"""Statistics of experiments, random strands, subsets and parts of files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.strand import hex_to_strand


def error_statistics(rows: DataFrame, by: str, error: str = "error_prob", limit: float = 1.0) -> DataFrame:
    """(by, mean, sd of the population, n_under): errors by a parameter, and how many are below the limit."""
    e = F.col(error)
    return rows.groupBy(by).agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("sd"), F.count_if(e < limit).alias("n_under"))


def run_statistics(rows: DataFrame, by: str, run: str, value: str, digits: int = 2) -> DataFrame:
    """Means of the runs' sums: (by, mean, sd of the population), rounded."""
    sums = rows.groupBy(by, run).agg(F.sum(value).alias("v"))
    return sums.groupBy(by).agg(F.round(F.avg("v"), digits).alias("mean"), F.round(F.stddev_pop("v"), digits).alias("sd"))


def density_curve(rows: DataFrame, by: str, value: str, grid: list[float]) -> DataFrame:
    """(by, x, density): a Gaussian kernel estimate at the given points, its width by Scott's rule.  Each point is one sum, so groups are never gathered."""
    stats = rows.groupBy(by).agg(F.count(value).alias("_n"), F.stddev_samp(value).alias("_sd")).withColumn("_h", F.col("_sd") * F.pow("_n", F.lit(-0.2)))
    # two passes: one small row for each group comes back to its values
    z = lambda g: (F.lit(float(g)) - F.col(value)) / F.col("_h")
    sums = rows.join(stats, by).groupBy(by).agg(*[F.sum(F.exp(-z(g) * z(g) / 2)).alias(f"_{i}") for i, g in enumerate(grid)], F.first("_n").alias("_n"), F.first("_h").alias("_h"))
    scale = F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi)
    points = F.array(*[F.struct(F.lit(float(g)).alias("x"), (F.col(f"_{i}") / scale).alias("density")) for i, g in enumerate(grid)])
    return sums.select(by, F.inline(points))


def blackman_mean(rows: DataFrame, key: str, at: str, value: str, width: int = 15) -> DataFrame:
    """(key, at, mean): the centred mean over `width` rows, weighted by a Blackman window; none where the window hangs over an end."""
    weight = [0.42 - 0.5 * math.cos(2 * math.pi * i / (width - 1)) + 0.08 * math.cos(4 * math.pi * i / (width - 1)) for i in range(width)]
    half, by = width // 2, Window.partitionBy(key).orderBy(at)
    parts = [F.lag(value, half - i).over(by) * w for i, w in enumerate(weight)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return rows.select(key, at, (total / sum(weight)).alias("mean")).where("mean IS NOT NULL")


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, n, pdf, cdf) of equally wide bins from the least to the greatest value, which is in the last."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width))
    counts = rows.join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.first(width).alias("_w"))  # one row of ends
    every = Window.partitionBy()
    share = F.col("n") / F.sum("n").over(every)
    return counts.select("bin", "n", (share / F.col("_w")).alias("pdf"), (F.sum("n").over(Window.orderBy("bin")) / F.sum("n").over(every)).alias("cdf"))


def half_of_bases(rows: DataFrame, length: str = "n", share: float = 0.5) -> DataFrame:
    """(n50): the greatest length such that strands of it and longer ones hold the share of all bases.  Equal lengths are counted first."""
    counts = rows.groupBy(F.col(length).alias("n")).agg(F.sum(length).alias("bases"))
    run = F.sum("bases").over(Window.orderBy(F.desc("n")))
    return counts.select("n", run.alias("run"), F.sum("bases").over(Window.partitionBy()).alias("all")).where(F.col("run") >= share * F.col("all")).agg(F.max("n").alias("n50"))


def adjusted_depths(contigs: DataFrame, lengths: DataFrame) -> DataFrame:
    """(name, depth): depths of contigs (name, depth, n) raised where reads (n) are cut at a contig's end, so that bases come out in proportion.

    Lengths are counted first; the few contigs meet the counts of lengths, which are no more than the longest read.
    """
    counts = lengths.groupBy(F.col("n").alias("len")).agg(F.count("*").alias("times"))
    total = F.sum(F.col("len") * F.col("times"))
    got = contigs.join(counts).groupBy("name", "depth").agg((total / F.sum(F.least("len", "n") * F.col("times"))).alias("ratio"))
    return got.select("name", (F.col("depth") * F.col("ratio")).alias("depth"))


def random_strand(ident: Column, n: int, seed: int = 0) -> Column:
    """n bases that depend on the identifier and the seed alone: digests written as bases."""
    blocks = [F.sha2(F.concat_ws(":", F.lit(str(seed)), ident.cast("string"), F.lit(str(i))), 256) for i in range(-(-n // 128))]
    return F.left(hex_to_strand(F.concat(*blocks)), F.lit(n))


def sampled(rows: DataFrame, keys: list[str], n: int, salt: int = 0) -> DataFrame:
    """n of all rows, or all if there are fewer, by the digest of their keys: the same ones each time."""
    return rows.withColumn("_o", F.md5(F.concat_ws(":", F.lit(str(salt)), *keys))).orderBy("_o", *keys).limit(n).drop("_o")


def resampled(rows: DataFrame, keys: list[str], share: float, salt: int = 0) -> DataFrame:
    """A sample with replacement of about `share` of the rows: each row comes as often as a Poisson number from the digest of its keys says."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(salt)), *keys)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times, p, total = F.lit(0), math.exp(-share), 0.0
    for k in range(16):
        total += p
        times = times + (draw >= total).cast("int")
        p *= share / (k + 1)
    return rows.withColumn("_t", times).where("_t > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_t")))).drop("_t")


def parts_of(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """Rows with `part`: n nearly equal parts in order, the first ones longer by one.  Rows are counted by ranges, not sorted into one task."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    counts = ranges.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    at = ranges.withColumn("_i", within).join(F.broadcast(before), "_p")  # a row for each range
    i, size, more = F.col("_i") + F.col("_b"), F.floor(F.col("_n") / n), F.col("_n") % n
    late = more + F.floor((i - more * (size + 1)) / F.greatest(size, F.lit(1)))
    return at.withColumn("part", F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(late)).drop("_p", "_i", "_b", "_n")


def merged_parts(parts: DataFrame, name: str = "name", data: str = "data") -> DataFrame:
    """(file, data, n_parts, missing): files put together from parts `file_i` in order of i; missing: the numbers up to the last that aren't there."""
    number = F.regexp_extract(name, r"_(\d+)$", 1).try_cast("int")
    rows = parts.select(F.regexp_replace(name, r"_\d+$", "").alias("file"), number.alias("i"), F.hex(data).alias("h")).where("i IS NOT NULL")
    whole = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("p"))
    numbers = F.transform("p", lambda x: x["i"])
    return whole.select("file", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("data"), F.size("p").alias("n_parts"), F.array_except(F.sequence(F.lit(0), F.array_max(numbers)), numbers).alias("missing"))


def prefixed(tables: dict[str, DataFrame], name: str = "name") -> DataFrame:
    """Folders of packets as one, names prefixed by their folder's."""
    out = None
    for prefix, table in tables.items():
        rows = table.withColumn(name, F.concat(F.lit(prefix + "_"), F.col(name)))
        out = rows if out is None else out.unionByName(rows)
    return out


def channel_of(used: Column, degree: Column, n_chunks: int, channels: int, method: str = "window", width: int = 30, stride: int = 20) -> Column:
    """The channels that a packet may go to, an array.

    even, odd: all channels if its chunks all have even (odd) numbers, none otherwise.  window: channels are windows of `width` chunks at
    every `stride`-th; a packet may go where all its chunks are.  secure: public channel 0 takes packets of even degree, the others those
    of odd degree.
    """
    every, none = F.sequence(F.lit(0), F.lit(channels - 1)), F.array().cast("array<int>")
    if method in ("even", "odd"):
        return F.when(F.forall(used, lambda i: i % 2 == int(method == "odd")), every).otherwise(none)
    if method == "window":
        return F.filter(every, lambda c: F.forall(used, lambda i: (i >= c * stride) & (i < c * stride + width)))
    if method == "secure":
        return F.when(degree % 2 == 0, F.array(F.lit(0))).otherwise(F.filter(every, lambda c: c > 0))
    raise ValueError(f"no method is called {method!r}")


def unused_chunks(packets: DataFrame, n_chunks: int, channels: DataFrame) -> DataFrame:
    """(channel, chunk_idx): the chunks that no packet (channel, used) of a channel holds."""
    have = packets.select("channel", F.explode("used").alias("chunk_idx")).distinct()
    return channels.select("channel", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk_idx")).join(have, ["channel", "chunk_idx"], "left_anti")
