"""Strands matched to each other: best matches in either orientation, near duplicates, references that must exist, model look-ups."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import strand as S
from helixframe.operators.clusters import best_match
from helixframe.operators.near import over_ratio


def joined_summary(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, n, mean, sd, least, most) of the given columns over the rows that both tables have and that have no null."""
    rows = left.join(right, key).na.drop()
    stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most")) for c in columns]
    return rows.agg(F.array(*stats).alias("all")).select(F.inline("all"))


def oriented_best_match(candidates: DataFrame, references: DataFrame, metric: str = "identity") -> DataFrame:
    """(cand_id, ref_id, score, is_reversed): the best reference of each candidate or its reverse complement; forward wins ties."""
    turned = candidates.select("cand_id", S.reverse_complement(F.col("seq")).alias("seq"))
    both = best_match(candidates, references, metric).withColumn("is_reversed", F.lit(False)).unionByName(best_match(turned, references, metric).withColumn("is_reversed", F.lit(True)))
    best = F.max_by(F.struct("ref_id", "score", "is_reversed"), F.struct("score", ~F.col("is_reversed"), -F.col("ref_id"))).alias("b")
    return both.groupBy("cand_id").agg(best).select("cand_id", "b.*")


def near_duplicates(reads: DataFrame, ratio: float = 0.85) -> DataFrame:
    """(read_id, first, score): reads whose indel similarity to a smaller read is over `ratio`, with the smallest such read.

    Equal strands are compared once: a strand's smallest read stands for it, and later ones of its reads resemble that one, or one before it.
    """
    rows = reads.where("seq IS NOT NULL").select("read_id", "seq")
    once = rows.groupBy("seq").agg(F.min("read_id").alias("id"))
    found = over_ratio(once, once, ratio).groupBy("b").agg(F.min_by(F.struct(F.col("a").alias("first"), "score"), "a").alias("m")).select(F.col("b").alias("id"), "m.*")
    near = rows.join(once, "seq").join(found, "id", "left")
    own = F.struct(F.col("id").alias("first"), F.lit(1.0).alias("score"))
    other = F.struct("first", "score")
    both = F.when(F.col("first").isNull(), own).when(F.col("id") < F.col("first"), own).otherwise(other)
    return near.withColumn("m", both).where("m.first < read_id").select("read_id", "m.first", "m.score")


def without_near_duplicates(reads: DataFrame, **options) -> DataFrame:
    """Reads that resemble no smaller one."""
    return reads.join(near_duplicates(reads, **options), "read_id", "left_anti")


def _common(a: str, b: str, places: dict[str, int]) -> int:
    """The length of the longest common subsequence, by bits (Hyyroe); places: those of a's letters."""
    full = v = (1 << len(a)) - 1
    for c in b:
        hit = v & places.get(c, 0)
        v = (v + hit | v - hit) & full
    return len(a) - v.bit_count()


def close_matches(rows: DataFrame, known: DataFrame, cutoff: float = 0.6, k: int = 6) -> DataFrame:
    """(id, match, score): the nearest known strand of each by matching blocks (difflib), if over the cutoff; candidates share a k-mer.

    Matching blocks are a common subsequence, so the longest one bounds the score: candidates are looked at by their bounds, greatest first, as
    long as one can still be the best.  An id's candidates come sorted to one task and are never held together.
    """
    mers = lambda t, key: t.select(key, F.explode(F.array_distinct(S.kmers(F.col("seq"), k))).alias("mer"))
    pairs = mers(rows, "id").join(mers(known, "known_id"), "mer").select("id", "known_id").distinct()
    both = pairs.join(rows.select("id", F.col("seq").alias("a")), "id").join(known.select("known_id", F.col("seq").alias("match")), "known_id")

    @F.pandas_udf("double")
    def bound(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, places = [], None, {}
        for x, y in zip(a, b):
            if x != last:
                last, places = x, {}
                for i, c in enumerate(x):
                    places[c] = places.get(c, 0) | 1 << i
            out.append(2.0 * _common(x, y, places) / (len(x) + len(y)))
        return pd.Series(out)

    def nearest(frames):
        held, best = None, None
        for frame in frames:
            out = []
            for ident, a, match, most in zip(frame["id"], frame["a"], frame["match"], frame["most"]):
                if ident != held:
                    if best is not None:
                        out.append((held, best[1], best[0]))
                    held, best = ident, None
                if most >= cutoff and (best is None or most >= best[0]):
                    score = difflib.SequenceMatcher(None, match, a).ratio()
                    if score >= cutoff:
                        best = max(best or (score, match), (score, match))
            yield pd.DataFrame(out, columns=["id", "match", "score"])
        if best is not None:
            yield pd.DataFrame([(held, best[1], best[0])], columns=["id", "match", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    found = both.select("id", "a", "match", bound("a", "match").alias("most")).where(F.col("most") >= cutoff)
    return found.repartition("id").sortWithinPartitions("id", F.desc("most")).mapInPandas(nearest, f"id {kind}, match string, score double")


def dangling(alignments: DataFrame, reads: DataFrame, references: DataFrame) -> DataFrame:
    """(read_name, ref_name, missing) of alignments whose read or reference isn't there; none if all is well."""
    no_read = alignments.join(reads, "read_name", "left_anti").select("read_name", "ref_name", F.lit("read").alias("missing"))
    no_ref = alignments.join(references, "ref_name", "left_anti").select("read_name", "ref_name", F.lit("reference").alias("missing"))
    return no_read.unionByName(no_ref)


def shorter_contexts(cigar: Column, most: int = 9) -> Column:
    """A context and what is left of it when a column is trimmed from either end, again and again; deletions at the ends go too."""
    bare = lambda x: F.regexp_replace(x, "^D+|D+$", "")
    forms, x = [cigar], cigar
    for _ in range(most):
        x = bare(F.substring(x, F.lit(2), F.greatest(F.length(x) - 2, F.lit(0))))
        forms.append(x)
    return F.filter(F.array(*forms), lambda f: f != "")


def backed_off(contexts: DataFrame, model: DataFrame, most: int = 9) -> DataFrame:
    """contexts (id, cigar) with the longest form of theirs that the model (cigar, and others) has: (id, found, and the model's others)."""
    keys = contexts.select("id", F.posexplode(shorter_contexts(F.col("cigar"), most)).alias("trimmed", "cigar"))
    best = keys.join(model.select("cigar").distinct(), "cigar").groupBy("id").agg(F.min_by("cigar", "trimmed").alias("found"))
    return best.join(model.withColumnRenamed("cigar", "found"), "found")


def checked_against(rows: DataFrame, truth: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows with is_correct: whether the truth has their strand."""
    known = truth.select(seq).distinct().withColumn("is_correct", F.lit(True))
    return rows.join(known, seq, "left").withColumn("is_correct", F.coalesce("is_correct", F.lit(False)))


def report(pairs: DataFrame) -> DataFrame:
    """(whole_id, part_id, html, found) of pairs (whole_id, seq, part_id, part): the whole with each place of the part in bold."""
    bold = F.replace("seq", F.col("part"), F.concat(F.lit("<b>"), F.col("part"), F.lit("</b>")))
    found = F.contains("seq", "part") & (F.col("part") != "")
    return pairs.select("whole_id", "part_id", F.when(found, bold).otherwise(F.col("seq")).alias("html"), found.alias("found"))
