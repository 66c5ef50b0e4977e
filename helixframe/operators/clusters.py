"""Reads to clusters to consensus strands to candidates.

`leaders` is the exact first-fit rule for pools of any size: a block of heads at a time, against all reads that are left.
`clusters` joins all near reads, and chains of them are one cluster.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import strand as S
from helixframe.operators.align import edit_distance, gapped
from helixframe.operators.near import best_of, edit_distances, edit_join
from helixframe.sources.tables import dealt

# Fixed value: the adapter in front of simulated strands.
ADAPTER = "AATGTACTTCGTTCAGTTACGTATTGCT"


def length_band(reads: DataFrame, length: int, below: int = 5, above: int = 50, seq: str = "seq") -> DataFrame:
    n = F.length(seq)
    return reads.where((n > length - below) & (n < length + above))


def adapter_end(head: Column, adapter: str = ADAPTER, shortest: int = 3) -> Column:
    """Where the longest piece of the adapter in a read's head ends (leftmost of equal ones); 0 if none of `shortest` bases is there."""
    ends = []
    for k in range(len(adapter), shortest - 1, -1):
        found = [F.instr(head, adapter[i : i + k]) for i in range(len(adapter) - k + 1)]
        first = F.array_min(F.filter(F.array(*found), lambda x: x > 0))
        ends.append(first + k - 1)
    return F.coalesce(*ends, F.lit(0))


def trim_adapters(reads: DataFrame, length: int, adapter: str = ADAPTER, seq: str = "seq") -> DataFrame:
    """Reads over `length` by more than two adapters go; of those over by more than five bases the adapter is cut."""
    over = F.length(seq) - length
    cut = F.substring(F.col(seq), adapter_end(F.left(F.col(seq), F.lit(len(adapter) + 5)), adapter) + 1, F.length(seq))
    return reads.where(over <= 2 * len(adapter)).withColumn(seq, F.when(over > 5, cut).otherwise(F.col(seq)))


_TURN = str.maketrans("ACGT", "TGCA")


def turned_strand(seq: str) -> str:
    return seq[::-1].translate(_TURN)


#: Bases of the k-mers by which a read's head is guessed, and how often a wrong guess is mended before all pairs are compared.
GUESS, MENDED = 12, 8


def _guessed_heads(seqs: list[str], distance: int, barred: set[int], known: dict[tuple[int, int, bool], bool]) -> list[int]:
    """Strands that aren't near the head, of those before them, that shares most k-mers with them; `barred` ones are no heads."""
    heads: list[int] = []
    index: dict[str, list[tuple[int, bool]]] = {}
    for i, s in enumerate(seqs):
        if i in barred:
            continue
        shared = Counter(x for j in range(len(s) - GUESS + 1) for x in index.get(s[j : j + GUESS], ()))
        for (h, turned), _ in shared.most_common(1):
            if (h, i, turned) not in known:
                known[h, i, turned] = edit_distance(seqs[h], turned_strand(s) if turned else s) <= distance
            if known[h, i, turned]:
                break
        else:
            heads.append(i)
            for turned, x in ((False, s), (True, turned_strand(s))):
                for kmer in {x[j : j + GUESS] for j in range(len(x) - GUESS + 1)}:
                    index.setdefault(kmer, []).append((i, turned))
    return heads


def first_heads(reads: list[tuple[int, str]], distance: int) -> list[tuple[int, str]]:
    """Those of a bounded list of reads, in order, that no head before them is near to, in either orientation.

    A read that is near to one head is none, so most are told by the head that shares k-mers with them.  The rest are compared with each other:
    if none is near to another, they are the heads; the first that is near to one before it is none, and those after it are looked at again.
    """
    seqs = [s for _, s in reads]
    barred: set[int] = set()
    known: dict[tuple[int, int, bool], bool] = {}
    for turn in range(MENDED + 1):
        heads = _guessed_heads(seqs, distance, barred, known) if turn < MENDED else list(range(len(seqs)))
        some = [seqs[i] for i in heads]
        near = np.minimum(edit_distances(some, some), edit_distances(some, [turned_strand(s) for s in some])) <= distance  # row: head, column: read
        wrong = np.flatnonzero(np.triu(near, 1).any(0))
        if not len(wrong):
            return [reads[i] for i in heads]
        barred.add(heads[wrong[0]])
    kept: list[int] = []
    for i in range(len(reads)):
        if not near[kept, i].any():
            kept.append(i)
    return [reads[i] for i in kept]


def leaders(reads: DataFrame, distance: int = 40, block: int = 512) -> DataFrame:
    """(cluster_id, read_id, is_reversed, is_head) by the first-fit rule: in order of read_id, each read joins the oldest head within the
    distance, forward before turned, or becomes a head.  A cluster's id is its head's.

    Rounds: the heads among the first `block` strands that are left are found by themselves, as all older heads have been compared with them;
    then all strands that are left are compared with these heads, in parallel.  What joins none goes to the next round, so no two reads are
    compared that are not heads.  Equal strands are compared once.  The driver sees `block` strands a round.  Nulls are left out; of a read_id
    on several strands each is a read of its own.
    """
    spark = reads.sparkSession
    rows = reads.where("seq IS NOT NULL").select(F.col("read_id").cast("long").alias("read_id"), "seq")
    left = _save(spark, rows.groupBy("seq").agg(F.min("read_id").alias("id")).select("id", "seq"))
    settled = None
    while first := left.orderBy("id", "seq").limit(block).collect():
        heads = first_heads([(r["id"], r["seq"]) for r in first], distance)
        held = spark.sparkContext.broadcast(heads)

        def join(batches):
            heads = held.value
            ids, seqs = np.array([i for i, _ in heads]), [s for _, s in heads]
            for batch in batches:
                texts = batch.column("seq").to_pylist()
                order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
                head, turn = np.full(len(texts), -1), np.zeros(len(texts), bool)
                for a in range(0, len(order), 64):
                    some = order[a : a + 64]
                    straight = edit_distances(seqs, [texts[i] for i in some]) <= distance
                    other = edit_distances(seqs, [turned_strand(texts[i]) for i in some]) <= distance
                    found = straight | other
                    first = found.argmax(0)
                    good = found[first, np.arange(len(some))]
                    head[some] = np.where(good, first, -1)
                    turn[some] = good & ~straight[first, np.arange(len(some))]
                joined = head >= 0
                cluster, of = pa.array(ids[np.maximum(head, 0)], mask=~joined), pa.array([seqs[h] if h >= 0 else None for h in head.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("seq"), cluster, of, pa.array(turn)], ["id", "seq", "cluster_id", "head", "is_reversed"])

        done = _save(spark, left.repartition(dealt(spark)).mapInArrow(join, "id long, seq string, cluster_id long, head string, is_reversed boolean"))
        part = done.where("cluster_id IS NOT NULL").drop("id")
        settled = part if settled is None else settled.unionByName(part)
        left = done.where("cluster_id IS NULL").select("id", "seq")
    if settled is None:
        return spark.createDataFrame([], "cluster_id long, read_id long, is_reversed boolean, is_head boolean")
    is_head = (F.col("read_id") == F.col("cluster_id")) & (F.col("seq") == F.col("head"))
    return rows.join(settled, "seq").select("cluster_id", "read_id", "is_reversed", is_head.alias("is_head"))


def near_pairs(reads: DataFrame, distance: int = 40) -> DataFrame:
    """(a, b, turned), a < b: all pairs of different reads (read_id, seq), one row for each, that are within the distance in an orientation."""
    once = reads.select(F.col("read_id").alias("id"), "seq")
    turned = once.select("id", S.reverse_complement(F.col("seq")).alias("seq"))
    pairs = edit_join(once, once, distance).withColumn("turned", F.lit(False)).unionByName(edit_join(once, turned, distance).withColumn("turned", F.lit(True)))
    return pairs.where("a < b").select("a", "b", "turned")


def _save(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Cut the lineage at a checkpoint in the folder that the session names."""
    return rows.checkpoint()


def components(spark: SparkSession, pairs: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, root): the smallest id reachable, by neighbours' smallest labels and pointer jumping, until nothing changes."""
    edges = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
    edges = _save(spark, edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = _save(spark, edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root")).withColumnRenamed("x", "id"))
    for _ in range(rounds):
        heard = edges.join(label.toDF("y", "root"), "y").groupBy("x").agg(F.min("root").alias("heard"))
        new = label.join(heard.withColumnRenamed("x", "id"), "id").select("id", F.least("root", "heard").alias("root"), F.col("root").alias("was"))
        far = new.select(F.col("id").alias("root"), F.col("root").alias("far"))
        new = _save(spark, new.join(far, "root", "left").select("id", F.least("root", F.coalesce("far", "root")).alias("root"), "was"))
        label = new.select("id", "root")
        if new.where("root != was").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def clusters(reads: DataFrame, distance: int = 40) -> DataFrame:
    """(cluster_id, read_id, is_reversed, is_head): components of near sequences, turned towards their head.

    Copies are compared once.  The head is the component's smallest read_id.
    """
    spark = reads.sparkSession
    rows = reads.where("seq IS NOT NULL").select("read_id", "seq")
    once = rows.groupBy("seq").agg(F.min("read_id").alias("read_id"))
    pairs = _save(spark, near_pairs(once, distance))
    root = components(spark, pairs)
    first = once.join(root.withColumnRenamed("id", "read_id"), "read_id", "left").select("seq", F.coalesce("root", "read_id").alias("cluster_id"))
    heads = once.select(F.col("read_id").alias("cluster_id"), F.col("seq").alias("head"))
    rows = rows.join(first, "seq").join(heads, "cluster_id")
    turned = F.levenshtein("seq", "head") > F.levenshtein(S.reverse_complement(F.col("seq")), F.col("head"))
    return rows.select("cluster_id", "read_id", turned.alias("is_reversed"), (F.col("read_id") == F.col("cluster_id")).alias("is_head"))


def oriented(members: DataFrame, reads: DataFrame) -> DataFrame:
    """(cluster_id, read_id, seq) with turned reads turned back."""
    rows = members.join(reads.select("read_id", "seq"), "read_id")
    return rows.select("cluster_id", "read_id", F.when(F.col("is_reversed"), S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


def cut_candidates(rows: DataFrame, length: int, seq: str = "seq") -> DataFrame:
    """Candidates of `length` bases: longer ones cut, shorter ones gone, equal rows once."""
    return rows.where(F.length(seq) >= length).withColumn(seq, F.left(seq, F.lit(length))).distinct()


def largest(members: DataFrame, n: int) -> DataFrame:
    """(cluster_id, n) of the n largest clusters; the smaller id first among equals."""
    return members.groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(n)


def centroids(rows: DataFrame, part: int = 512) -> DataFrame:
    """(cluster_id, read_id, cost): the read of each cluster with the least sum of edit distances to the others, the smaller id of equals.

    rows: (cluster_id, read_id, seq).  The work grows with the square of a cluster, in tiles of two parts of it: a large cluster is many
    tasks, and a row leaves a tile for each read, not for each pair.
    """
    rows = rows.where("seq IS NOT NULL").select("cluster_id", "read_id", "seq")
    parts = rows.groupBy("cluster_id").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    placed = rows.join(parts, "cluster_id").withColumn("mine", F.pmod(F.xxhash64("read_id", "seq"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = placed.select("cluster_id", "read_id", "seq", F.col("mine").alias("p"), every.alias("q"))
    b = placed.select(F.col("cluster_id").alias("c"), F.col("seq").alias("other"), every.alias("p"), F.col("mine").alias("q"))

    def meet(x, y):
        ids, seqs, others = x.column("read_id").to_pylist(), x.column("seq").to_pylist(), y.column("other").to_pylist()
        cost = np.zeros(len(seqs), np.int64)
        for i in range(0, len(seqs), 256):
            for j in range(0, len(others), 128):
                cost[i : i + 256] += edit_distances(seqs[i : i + 256], others[j : j + 128]).sum(1)
        return pa.table({"cluster_id": x.column("cluster_id"), "read_id": pa.array(ids, pa.int64()), "seq": x.column("seq"), "cost": pa.array(cost)})

    costs = a.groupBy("cluster_id", "p", "q").cogroup(b.groupBy("c", "p", "q")).applyInArrow(meet, "cluster_id long, read_id long, seq string, cost long")
    costs = costs.groupBy("cluster_id", "read_id", "seq").agg(F.sum("cost").alias("cost"))
    return costs.groupBy("cluster_id").agg(F.min_by("read_id", F.struct("cost", "read_id")).alias("read_id"), F.min("cost").alias("cost"))


def sample_members(rows: DataFrame, n: int = 5, salt: int = 0) -> DataFrame:
    """Up to n reads of each cluster, the same ones each time.

    A third of all reads may be in one cluster, so each of 256 slots of a cluster is cut to n first.
    """
    rows = rows.withColumn("_o", F.md5(F.concat_ws(":", F.lit(str(salt)), "read_id"))).withColumn("_slot", F.left("_o", F.lit(2)))
    for keys in (["cluster_id", "_slot"], ["cluster_id"]):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_o", "read_id"))).where(F.col("_n") <= n)
    return rows.select("cluster_id", "read_id", "seq")


# Fixed value: the order in which letters win ties.
VOTES = "ACGT-N"


def vote(rows: list[str], gap_weight: float = 0.4) -> str:
    """Majority of each column; gaps weigh less, and where they win nothing is written."""
    out = []
    for i in range(max(map(len, rows), default=0)):
        seen = [r[i] for r in rows if i < len(r)]
        best = max(VOTES, key=lambda c: seen.count(c) * (gap_weight if c == "-" else 1))
        out.append("" if best == "-" else best)
    return "".join(out)


def star(rows: list[str], centre: int) -> list[str]:
    """Multiple alignment: all rows aligned to one of them, gaps of the centre kept for all."""
    head = rows[centre]
    slots: list[list[str]] = []
    for r in rows:
        pieces = [""] * (2 * len(head) + 1)  # odd: a place of the head, even: what comes before it
        i = 0
        for x, y in zip(*gapped(head, r)):
            if x == "-":
                pieces[2 * i] += y
            else:
                pieces[2 * i + 1] = y
                i += 1
        slots.append(pieces)
    width = [max(len(p[i]) for p in slots) for i in range(2 * len(head) + 1)]
    return ["".join(piece.ljust(w, "-") for piece, w in zip(p, width)) for p in slots]


def medoid(rows: list[str]) -> int:
    """The row with the least sum of edit distances to the others; the first of equal ones."""
    cost = [[0] * len(rows) for _ in rows]
    for i, a in enumerate(rows):
        for j in range(i):
            cost[i][j] = cost[j][i] = edit_distance(a, rows[j])
    return min(range(len(rows)), key=lambda i: sum(cost[i]))


def consensus(rows: DataFrame, sample: int = 5, salt: int = 0) -> DataFrame:
    """(cluster_id, n, seq): up to `sample` reads of each cluster aligned to their medoid and put to the vote."""
    few = sample_members(rows, sample, salt).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("read_id", "seq"))).alias("m"))
    few = few.repartition(dealt(rows.sparkSession), "cluster_id")  # small rows, but each costs an alignment: not to be put together by their size

    @F.pandas_udf("string")
    def merge(reads: pd.Series) -> pd.Series:
        return pd.Series([vote(star(list(r), medoid(list(r)))) for r in reads])

    return few.select("cluster_id", F.size("m").alias("n"), merge(F.transform("m", lambda x: x["seq"])).alias("seq"))


def guesses(rows: DataFrame, sample: int = 4, n: int = 8) -> DataFrame:
    """(cluster_id, seq): the different consensus strands of n samples of each cluster.  A checksum tells which of them are right.

    A base that two reads of a few insert at one place outvotes gaps; samples that lack one of them are without it.
    """
    each = rows.select("cluster_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("guess"), "read_id", "seq")
    each = each.select(F.struct("cluster_id", "guess").alias("cluster_id"), "read_id", "seq").withColumn("read_id", F.concat_ws(":", F.col("cluster_id.guess").cast("string"), F.col("read_id").cast("string")))  # another sample each time
    return consensus(each, sample).select(F.col("cluster_id.cluster_id").alias("cluster_id"), "seq").distinct()


def majority(rows: DataFrame, gap_weight: float = 0.4) -> DataFrame:
    """(cluster_id, seq) of rows that are aligned already: votes are counted by place, so no cluster is gathered."""
    at = F.posexplode(F.split("seq", "")).alias("pos", "c")
    votes = rows.select("cluster_id", at).where("c != ''").groupBy("cluster_id", "pos", "c").agg(F.count("*").alias("n"))
    weight = F.when(F.col("c") == "-", F.col("n") * gap_weight).otherwise(F.col("n"))
    best = votes.groupBy("cluster_id", "pos").agg(F.max_by("c", F.struct(weight, -F.instr(F.lit(VOTES), F.col("c")))).alias("c"))
    return best.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "c"))), lambda x: F.when(x["c"] == "-", "").otherwise(x["c"])), "").alias("seq"))


def checked_candidates(rows: DataFrame, length: int) -> DataFrame:
    """Distinct strands, in either orientation, whose checksum holds, without it: (cluster_id, seq)."""
    both = rows.select("cluster_id", F.explode(F.array("seq", S.reverse_complement(F.col("seq")))).alias("coded"))
    return both.where(S.checksum_ok(F.col("coded"), length)).select("cluster_id", F.substring("coded", 1, length).alias("seq")).distinct()


def best_match(candidates: DataFrame, references: DataFrame, metric: str = "identity") -> DataFrame:
    """(cand_id, ref_id, score): each candidate's best reference of all; ties go to the smaller ref_id.  Equal strands score 1.

    candidates: (cand_id, seq), references: (ref_id, seq).  metric: "identity" (equal letters at equal places over the reference's length) or
    "ratio" (indel similarity).  A candidate without a strand has no row.
    """
    found = best_of(candidates.select(F.col("cand_id").alias("id"), "seq"), references.select(F.col("ref_id").alias("id"), "seq"), metric)
    return found.select(F.col("a").alias("cand_id"), F.col("b").alias("ref_id"), "score")


def recovery(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """One row: n_refs, n_found (references that are a candidate) and all_found."""
    found = references.join(candidates.select("seq").distinct(), "seq", "left_semi").agg(F.count("*").alias("n_found"))
    return references.agg(F.count("*").alias("n_refs")).join(found).select("n_refs", "n_found", (F.col("n_refs") == F.col("n_found")).alias("all_found"))
