"""A sequencing channel: fragments, errors, qualities and the models learned from alignments.

Each read depends on (seed, read_id) alone, so a lost task gives the same reads again, and reads are made wherever there is room.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.operators.align import edit_script, kmer_alignment
from helixframe.sources.tables import dealt

READS = "read_id long, ref_name string, kind string, is_reversed boolean, start long, identity double, seq string, qual string"
_TURN = str.maketrans("ACGT", "TGCA")


@dataclass
class Channel:
    """Parameters of the simulator; shares and rates in percent."""

    mean_length: float = 15000
    sd_length: float = 13000
    identity: tuple[float, float, float] = (95.0, 99.0, 2.5)  # mean, most, standard deviation
    junk: float = 1.0
    random: float = 1.0
    chimeras: float = 1.0
    start_adapter: str = "AATGTACTTCGTTCAGTTACGTATTGCT"
    end_adapter: str = "GCAATACGTAACTGAACGAAGT"
    start_rate: tuple[float, float] = (90.0, 60.0)  # how often, how much of it
    end_rate: tuple[float, float] = (50.0, 20.0)
    glitches: tuple[float, float, float] = (10000.0, 25.0, 25.0)  # distance, size, skip
    errors: dict[str, list[tuple[str, float]]] = field(default_factory=dict)  # an error model, alternatives of k-mers; without one changes are random
    scores: dict[str, tuple] | None = None  # a score model; without one the ideal one
    seed: int = 0


def gamma_parameters(mean: float, sd: float) -> tuple[float, float]:
    """Shape and scale."""
    return mean * mean / (sd * sd), sd * sd / mean


def beta_parameters(mean: float, sd: float, most: float) -> tuple[float, float]:
    u, s = mean / most, sd / most
    n = u * (1 - u) / (s * s) - 1
    if n <= 0:
        raise ValueError("the deviation is too large for this mean")
    return u * n, (1 - u) * n


def random_bases(rng: np.random.Generator, n: int) -> str:
    return "".join(np.array(list("ACGT"))[rng.integers(0, 4, n)])


def _length(rng, c: Channel) -> int:
    if c.sd_length <= 0:
        return max(1, round(c.mean_length))
    return max(1, round(rng.gamma(*gamma_parameters(c.mean_length, c.sd_length))))


def _identity(rng, c: Channel) -> float:
    mean, most, sd = c.identity
    if sd <= 0 or mean >= most:
        return mean / 100
    a, b = beta_parameters(mean, sd, most)
    return most / 100 * rng.beta(a, b)


def _adapter(rng, adapter: str, rate: tuple[float, float], head: bool) -> str:
    often, amount = rate[0] / 100, rate[1] / 100
    if not adapter or rng.random() >= often:
        return ""
    n = len(adapter) if amount >= 1 else 0 if amount <= 0 else round(len(adapter) * rng.beta(2 * amount, 2 - 2 * amount))
    return adapter[len(adapter) - n :] if head else adapter[:n]


def _fragment(rng, c: Channel, contigs: list[tuple], chance: np.ndarray) -> tuple[str | None, str, bool, int, str]:
    """ref_name, kind, is_reversed, start, bases."""
    draw, n = rng.random() * 100, _length(rng, c)
    if draw < c.junk:
        unit = random_bases(rng, int(rng.integers(1, 6)))
        return None, "junk", False, 0, (unit * (n // len(unit) + 1))[:n]
    if draw < c.junk + c.random:
        return None, "random", False, 0, random_bases(rng, n)
    name, seq, _, circular = contigs[int(rng.choice(len(contigs), p=chance))]
    turned = bool(rng.random() < 0.5)
    if circular:
        n, at = min(n, len(seq)), int(rng.integers(0, len(seq)))
        piece = (seq + seq)[at : at + n]
    elif n >= len(seq):
        at, piece = 0, seq
    else:  # a window that may hang over either end and is cut there
        left = int(rng.integers(-n + 1, len(seq)))
        at, piece = max(left, 0), seq[max(left, 0) : left + n]
    return name, "good", turned, at, piece[::-1].translate(_TURN) if turned else piece


def _steps(rng, mean: float, n: int) -> np.ndarray:
    """n lengths of at least 1 with the given mean, or all 0 for none."""
    return rng.geometric(min(1.0, 1 / mean), n) if mean > 0 else np.zeros(n, np.int64)


def _glitched(rng, c: Channel, seq: str) -> str:
    """Random bases put in and bases left out at places that are `distance` apart on average.

    All places, sizes and skips are drawn at once; a place that falls into bases which an earlier glitch leaves out is no glitch.
    """
    distance, size, skip = c.glitches
    if distance <= 0 or not seq:
        return seq
    places = np.cumsum(_steps(rng, distance, int(len(seq) / max(distance, 1)) * 2 + 16))
    places = places[places < len(seq)]
    sizes, skips = _steps(rng, size, len(places)), _steps(rng, skip, len(places))
    reach = np.maximum.accumulate(np.concatenate([[0], places + skips]))[:-1] if len(places) else places
    real = places >= reach
    starts = np.concatenate([[0], (places + skips)[real]])
    ends = np.concatenate([places[real], [len(seq)]])
    new = random_bases(rng, int(sizes[real].sum()))
    cut = np.concatenate([[0], np.cumsum(sizes[real])])
    pieces = [seq[a:b] for a, b in zip(starts, ends)]
    return "".join(p + new[cut[i] : cut[i + 1]] if i + 1 < len(cut) else p for i, p in enumerate(pieces))


_OTHERS = {b: [x for x in "ACGT" if x != b] for b in "ACGT"}


def _random_changes(rng, bases: str) -> list[str]:
    """For each base what stands in its place: another base, none, or itself with a base before or behind it, a third of them each."""
    kind, which, side = rng.integers(0, 3, len(bases)), rng.integers(0, 12, len(bases)), rng.random(len(bases)) < 0.5
    return ["" if k == 0 else _OTHERS[b][w % 3] if k == 1 else "ACGT"[w % 4] + b if s else b + "ACGT"[w % 4] for b, k, w, s in zip(bases, kind, which, side)]


def _model_change(rng, kmer: str, model: dict) -> list[str]:
    """What stands for each base of a k-mer: one of the model's alternatives by its share, for the rest a random change of the middle base."""
    draw = rng.random()
    for alt, share in model.get(kmer, ()):
        draw -= share
        if draw < 0:
            return kmer_alignment(kmer, alt)
    out = list(kmer)
    out[len(kmer) // 2] = _random_changes(rng, kmer[len(kmer) // 2])[0]
    return out


def measured_identity(a: str, b: list[str], window: int = 1000, windows: int = 4) -> float:
    """Matches over alignment columns of a strand and what stands for its bases; of a long one, over some windows that are spread evenly."""
    n = max(1, -(-len(a) // window))
    at = range(n) if n <= windows else np.linspace(0, n - 1, windows).astype(int)
    scripts = "".join(edit_script(a[i * window : (i + 1) * window], "".join(b[i * window : (i + 1) * window])) for i in at)
    return scripts.count("=") / max(len(scripts), 1)


def add_errors(rng, seq: str, identity: float, model: dict | None = None, rounds: int = 30) -> str:
    """A read of a strand at an identity.

    Changes are made in rounds: as many at once as should be missing, at random places.  The nearer the target, the fewer: how far the
    read has come is measured by aligning it.  A change counts for less the lower the identity is (its power of 1.5), since places are hit
    again and changes side by side align better than they were made; and for what changes brought in the round before, since a model's
    alternative often is the k-mer itself.
    """
    if not seq or identity >= 1:
        return seq
    held, k, now, gain = list(seq), len(next(iter(model))) if model else 1, 1.0, 1.0  # gain: errors that a change made, as measured
    places = len(seq) - k + 1
    if places <= 0:
        return seq
    for _ in range(rounds):
        missing = (now - identity) * len(seq)
        if missing < 0.5:
            break
        n = max(1, min(places, math.ceil(0.8 * missing / max(now, 0.1) ** 1.5 / gain)))
        at, before = rng.choice(places, n, replace=False), now
        if model:
            for i in at:
                new = _model_change(rng, seq[i : i + k], model)
                if new != list(seq[i : i + k]) and (held[i : i + k] == list(seq[i : i + k]) or rng.random() < 0.5):
                    held[i : i + k] = new
        else:
            for i, x in zip(at, _random_changes(rng, "".join(seq[i] for i in at))):
                held[i] = x
        now = measured_identity(seq, held)
        gain = min(1.0, max((before - now) * len(seq) / n, 0.05)) if model else 1.0
    return "".join(held)


# Ranges of scores, by the alignment around a base.
RANDOM_SCORES = {"=": (1, 20), "X": (1, 20), "I": (1, 20)}
IDEAL_SCORES = {"X": (1, 3), "I": (1, 3), "=": (4, 7), "=" * 3: (8, 20), "=" * 5: (21, 30), "=" * 7: (31, 40), "=" * 9: (41, 50)}


def uniform_scores(ranges: dict[str, tuple[int, int]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """A score model (context to scores and their shares) with all scores of a range alike."""
    return {c: (np.arange(low, high + 1), np.full(high - low + 1, 1 / (high - low + 1))) for c, (low, high) in ranges.items()}


def score_model(rows: list[tuple[str, int, float]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """A score model of rows (context, score, share), such as quality_model learns; it must know =, X and I."""
    out: dict[str, list] = {}
    for context, score, share in rows:
        if context != "overall":
            out.setdefault(context, []).append((score, share))
    if missing := {"=", "X", "I"} - set(out):
        raise ValueError(f"the model does not know {sorted(missing)}")
    return {c: (np.array([q for q, _ in x]), np.array([p for _, p in x]) / sum(p for _, p in x)) for c, x in out.items()}


def qualities(rng, script: str, model: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> str:
    """Phred marks of a read's bases by their alignment.

    A base's context is the alignment of as many bases around it as the model's longest context has, centred; near the ends fewer.  Where
    the model does not know a context, a base is trimmed from either end, until it does.
    """
    model = model or uniform_scores(IDEAL_SCORES)
    half = max(len(c.replace("D", "")) for c in model) // 2
    bases = [i for i, op in enumerate(script) if op != "D"]
    by_context: dict[str, list[int]] = {}
    known: dict[str, str] = {}
    for n in range(len(bases)):
        reach = min(half, n, len(bases) - 1 - n)
        context = script[bases[n - reach] : bases[n + reach] + 1]
        if context not in known:
            short = context
            while short not in model:
                short = short[1:-1].strip("D")
            known[context] = short
        by_context.setdefault(known[context], []).append(n)
    out = np.zeros(len(bases), np.int64)
    for context, at in by_context.items():
        out[at] = rng.choice(model[context][0], len(at), p=model[context][1])
    return "".join(map(chr, np.clip(out, 0, 93) + 33))


def one_read(c: Channel, contigs: list[tuple], chance: np.ndarray, read_id: int) -> tuple:
    rng = np.random.default_rng([c.seed, read_id])
    name, kind, turned, at, seq = _fragment(rng, c, contigs, chance)
    seq = _adapter(rng, c.start_adapter, c.start_rate, True) + seq
    while rng.random() * 100 < c.chimeras:
        kind = "chimera"
        seq += _fragment(rng, c, contigs, chance)[4]
    seq = _glitched(rng, c, seq + _adapter(rng, c.end_adapter, c.end_rate, False))
    identity = _identity(rng, c)
    read = add_errors(rng, seq, identity, c.errors)
    return read_id, name, kind, turned, at, identity, read, qualities(rng, long_script(seq, read), c.scores)


def long_script(a: str, b: str, window: int = 1000) -> str:
    """The edit script of two strands, a window of both after the other; each window ends where a good part of it is aligned."""
    out, i, j = [], 0, 0
    while len(a) - i > 2 * window and len(b) - j > 2 * window:
        script = edit_script(a[i : i + 2 * window], b[j : j + 2 * window])
        columns = 0
        used_a = used_b = 0
        for op in script:
            if used_a >= window:
                break
            used_a, used_b, columns = used_a + (op != "I"), used_b + (op != "D"), columns + 1
        out.append(script[:columns])
        i, j = i + used_a, j + used_b
    return "".join(out) + edit_script(a[i:], b[j:])


def contig_weights(contigs: DataFrame) -> DataFrame:
    return contigs.select("name", (F.col("depth") * F.length("seq")).alias("weight"))


def target_bases(quantity: str, reference: int) -> int:
    """`25x` times the reference, `250M`, `k` and `g` bases, or a plain number."""
    unit = {"k": 10**3, "m": 10**6, "g": 10**9}
    text = quantity.strip().lower()
    if text.endswith("x"):
        return round(float(text[:-1]) * reference)
    return round(float(text[:-1]) * unit[text[-1]]) if text[-1:] in unit else int(text)


def simulate_strands(strands: DataFrame, copies: int, channel: Channel, key: str = "strand_id", seq: str = "seq") -> DataFrame:
    """(strand_id, and a read's columns): `copies` reads of every whole strand; nothing is gathered, so pools of any size will do."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, s, read in zip(frame["k"], frame["s"], frame["read_id"]):
                rng = np.random.default_rng([channel.seed, int(read) & (1 << 63) - 1])
                turned, identity = bool(rng.random() < 0.5), _identity(rng, channel)
                source = s[::-1].translate(_TURN) if turned else s
                source = _adapter(rng, channel.start_adapter, channel.start_rate, True) + source + _adapter(rng, channel.end_adapter, channel.end_rate, False)
                got = add_errors(rng, source, identity, channel.errors)
                rows.append((k, int(read), turned, identity, got, qualities(rng, edit_script(source, got), channel.scores)))
            yield pd.DataFrame(rows, columns=["strand_id", "read_id", "is_reversed", "identity", "seq", "qual"])

    many = strands.where(F.length(seq) > 0).select(F.col(key).cast("long").alias("k"), F.col(seq).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("n"))
    many = many.select("k", "s", (F.col("k") * copies + F.col("n")).alias("read_id"))
    many = many.repartition(dealt(strands.sparkSession), "read_id")  # small rows, but each costs alignments: a table of one file is one task otherwise
    return many.mapInPandas(run, "strand_id long, read_id long, is_reversed boolean, identity double, seq string, qual string")


def simulate(spark: SparkSession, contigs: list[tuple[str, str, float, bool]], bases: int, channel: Channel) -> DataFrame:
    """Reads of a reference (name, seq, depth, circular) until `bases` are reached.

    The reference goes to every task, so it must fit one; of pools of strands use simulate_strands.  Twice the reads expected are numbered,
    and running totals over blocks of 1024 reads, then in the block, cut them.
    """
    weight = np.array([d * len(s) for _, s, d, _ in contigs], float)
    chance, held = weight / weight.sum(), spark.sparkContext.broadcast(contigs)
    mean = min(channel.mean_length, max(len(s) for _, s, _, _ in contigs))
    count = max(16, math.ceil(4 * bases / mean))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([one_read(channel, held.value, chance, int(i)) for i in frame["id"]], columns=[c.split()[0] for c in READS.split(", ")])

    reads = spark.range(count).mapInPandas(run, READS).where("length(seq) > 0").withColumn("_b", F.floor(F.col("read_id") / 1024))
    totals = reads.groupBy("_b").agg(F.sum(F.length("seq")).alias("t"))
    before = totals.select("_b", (F.sum("t").over(Window.orderBy("_b")) - F.col("t")).alias("before"))
    inside = F.sum(F.length("seq")).over(Window.partitionBy("_b").orderBy("read_id")) - F.length("seq")
    return reads.join(before, "_b").where("before < %d" % bases).withColumn("_at", inside + F.col("before")).where(F.col("_at") < bases).drop("_b", "before", "_at")


def depth_summary(reads: DataFrame) -> DataFrame:
    """Mean, population variance, least and most reads of an origin, junk and random reads left out."""
    per = reads.where("kind NOT IN ('junk', 'random')").groupBy("ref_name").agg(F.count("*").alias("n"))
    return per.agg(F.avg("n").alias("mean"), F.var_pop("n").alias("variance"), F.min("n").alias("least"), F.max("n").alias("most"))


def error_model(pairs: DataFrame, k: int = 4, most: int = 25) -> DataFrame:
    """(kmer, alt, n, share, rank): what reads hold for each k-mer of the reference, of gapped pairs (ref, read) of equal length.

    Walks stay in one row; counts are combined before they are shuffled.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen: dict[tuple[str, str], int] = {}
            for ref, read in zip(frame["ref"], frame["read"]):
                at = [i for i, c in enumerate(ref) if c != "-"]
                for i in range(len(at) - k + 1):
                    kmer, alt = "".join(ref[j] for j in at[i : i + k]), read[at[i] : at[i + k - 1] + 1].replace("-", "")
                    if alt and kmer[0] == alt[0] and kmer[-1] == alt[-1] and not set(kmer + alt) - set("ACGT"):
                        seen[kmer, alt] = seen.get((kmer, alt), 0) + 1
            yield pd.DataFrame([(a, b, n) for (a, b), n in seen.items()], columns=["kmer", "alt", "n"])

    counts = pairs.where("ref IS NOT NULL AND read IS NOT NULL").select("ref", "read").mapInPandas(run, "kmer string, alt string, n long").groupBy("kmer", "alt").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("kmer")
    rows = counts.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("alt") != F.col("kmer"), F.desc("n"), "alt")))
    return rows.where(F.col("rank") <= most)


def quality_model(rows: DataFrame, least: int = 100, most: int = 10000) -> DataFrame:
    """(cigar, n, q, share) of (cigar, q), `overall` (null cigar in the cube) first among them; rare contexts are left out."""
    counts = rows.rollup("q", "cigar").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).where("g IN (0, 1)")
    counts = counts.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("cigar")).alias("cigar"), "q", "n")
    totals = counts.groupBy("cigar").agg(F.sum("n").alias("total")).where(f"total >= {least} OR cigar = 'overall'").orderBy(F.col("cigar") != "overall", F.desc("total"), "cigar").limit(most)
    return counts.join(totals, "cigar").select("cigar", F.col("total").alias("n"), "q", (F.col("n") / F.col("total")).alias("share"))
