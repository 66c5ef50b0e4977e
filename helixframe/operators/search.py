"""Searches: packets of the least error, packets that cover all chunks, and degree distributions of the best packets."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import rules as R
from helixframe.operators.codes import _draw
from helixframe.operators.packets import packet_strand


def scored(packets: DataFrame) -> DataFrame:
    """Adds strand and error_prob by the default rules."""
    rows = packets.withColumn("strand", packet_strand(F.col("packed")))
    return rows.withColumn("error_prob", F.round(R.default_rules(F.col("strand")), 9))


def best_packets(packets: DataFrame, n: int) -> DataFrame:
    """The n packets of the least error; ties by file, block and seed.  Of packets of one seed in a block the one of the least error counts.

    A task gives on its own best n only, so that no other packet is moved.
    """
    key = ["file_id", "block", "seed"]
    order = [(c, "ascending") for c in ("error_prob", *key)]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = part if held is None else pa.concat_tables([held, part])
            part = part.take(pc.sort_indices(part, order)).append_column("_at", pa.array(range(len(part)), pa.int64()))
            first = part.group_by(key).aggregate([("_at", "min")])["_at_min"]
            held = part.drop_columns("_at").take(first.take(pc.sort_indices(first))[:n])
        if held is not None:
            yield from held.combine_chunks().to_batches()

    found = packets.mapInArrow(best, packets.schema) if n > 0 else packets
    found = found.groupBy(*key).agg(F.min_by(F.struct(*[c for c in packets.columns if c not in key]), "error_prob").alias("_p")).select(*key, "_p.*")
    return found.select(packets.columns).orderBy("error_prob", *key).limit(n)


def merge_best(parts: list[DataFrame], n: int) -> DataFrame:
    """The best n of several searches."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return best_packets(rows, n)


def under_mean(packets: DataFrame, factor: float) -> DataFrame:
    """Packets whose error is at most the mean and `factor` of it more."""
    mean = packets.agg(F.avg("error_prob").alias("_mean"))
    return packets.join(F.broadcast(mean)).where(F.col("error_prob") <= F.col("_mean") * (1 + factor)).drop("_mean")  # one row


def chunk_usage(packets: DataFrame) -> DataFrame:
    return packets.select("file_id", "block", F.explode("used").alias("chunk_idx")).groupBy("file_id", "block", "chunk_idx").agg(F.count("*").alias("n"))


def degree_errors(packets: DataFrame) -> DataFrame:
    return packets.groupBy("degree").agg(F.count("*").alias("n"), F.avg("error_prob").alias("mean"))


def chunk_errors(packets: DataFrame) -> DataFrame:
    """(file_id, block, chunk_idx, n, mean): the errors of the packets that hold a chunk."""
    return packets.select("file_id", "block", F.explode("used").alias("chunk_idx"), "error_prob").groupBy("file_id", "block", "chunk_idx").agg(F.count("*").alias("n"), F.avg("error_prob").alias("mean"))


def holding_rare(packets: DataFrame, least: int) -> DataFrame:
    """(file_id, block, seed) of packets that hold a chunk which fewer than `least` packets of its block hold."""
    rare = chunk_usage(packets).where(F.col("n") < least)
    used = packets.select("file_id", "block", "seed", F.explode("used").alias("chunk_idx"))
    return used.join(rare, ["file_id", "block", "chunk_idx"], "left_semi").select("file_id", "block", "seed").distinct()


def _taken(used: list[np.ndarray], share: float) -> list[int]:
    """The packets of a block that cover() takes, of packets in order."""
    k, n = 1 + max((int(u.max()) for u in used if len(u)), default=-1), len(used)
    row = np.repeat(np.arange(n), [len(u) for u in used])
    flat = np.concatenate(used).astype(np.int64) if n else np.zeros(0, np.int64)
    total = np.bincount(flat, minlength=k)
    wanted = np.minimum(share * len(flat) / max(np.count_nonzero(total), 1), total)
    holds = np.bincount(row * k + flat, minlength=n * k).reshape(n, k) if k else np.zeros((n, 0), np.int64)
    some, have, wants, taken = holds > 0, np.zeros(k, np.int64), wanted > 0, []
    for i in range(n):
        if (some[i] & wants).any():
            taken.append(i)
            have += holds[i]
            wants = have < wanted
            if not wants.any():
                break
    return taken


def cover(packets: DataFrame, share: float = 0.9) -> DataFrame:
    """(file_id, block, seed): packets taken by error, as long as they hold a chunk that has fewer than `share` of its block's mean use.

    Blocks are bounded, so that each is a row; a batch of them is one call.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, whole = batch.column(2), batch.column(2).flatten()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            seeds, used = whole.field("seed").to_numpy(), whole.field("used")
            flat, cut = used.flatten().to_numpy(), np.concatenate([[0], np.cumsum(used.value_lengths().to_numpy())])
            rows, found = [], []
            for row in range(len(lists)):
                at = range(ends[row], ends[row + 1])
                taken = _taken([flat[cut[i] : cut[i + 1]] for i in at], share)
                rows += [row] * len(taken)
                found += [at[i] for i in taken]
            keys = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keys), batch.column(1).take(keys), pa.array(seeds[found] if found else np.zeros(0, np.int64))], ["file_id", "block", "seed"])

    rows = packets.select(F.col("file_id").cast("long").alias("file_id"), F.col("block").cast("long").alias("block"), F.col("seed").cast("long").alias("seed"), "used", "error_prob").where("used IS NOT NULL")
    blocks = rows.groupBy("file_id", "block").agg(F.sort_array(F.collect_list(F.struct("error_prob", "seed", "used"))).alias("p"))
    return blocks.select("file_id", "block", F.transform("p", lambda x: F.struct(x["seed"].alias("seed"), x["used"].alias("used"))).alias("p")).mapInArrow(run, "file_id long, block long, seed long")


Fitness = Callable[[list[list[float]]], list[float]]


def normalised(weights: list[float]) -> list[float]:
    total = sum(max(w, 0.0) for w in weights)
    return [max(w, 0.0) / total for w in weights] if total else [1 / len(weights)] * len(weights)


def overhead_fitness(spark: SparkSession, k: int = 60, runs: int = 4, limit: float = 3.0) -> Fitness:
    """Mean packets over k until k chunks are solved, minus one; every (candidate, run) is a row of its own, so a population is spread."""

    def run(frames):
        from helixframe.operators.codes import insert

        for frame in frames:
            out = []
            for i, salt, weights in zip(frame["i"], frame["salt"], frame["w"]):
                pivots: dict = {}
                rng, n = random.Random(int(salt)), 0
                while len(pivots) < k and n < limit * k:
                    degree = rng.choices(range(1, len(weights) + 1), list(weights))[0]
                    insert(pivots, sum(1 << j for j in _draw(rng.randrange(2**32), degree, k)), 0)
                    n += 1
                out.append((int(i), n / k - 1 + (k - len(pivots)) / k))
            yield pd.DataFrame(out, columns=["i", "cost"])

    def fitness(population: list[list[float]]) -> list[float]:
        rows = spark.createDataFrame([(i, s, normalised(w)) for i, w in enumerate(population) for s in range(runs)], "i int, salt int, w array<double>")
        got = {r["i"]: r["cost"] for r in rows.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "i int, cost double").groupBy("i").agg(F.avg("cost").alias("cost")).collect()}
        return [got[i] for i in range(len(population))]

    return fitness


def evolve(fitness: Fitness, start: list[list[float]], rounds: int = 10, keep: float = 0.4, rate: float = 0.1, seed: int = 0) -> tuple[list[float], float]:
    """The best share (two at least) stays; the rest are crossed from two of them and changed at random."""
    rng, population = random.Random(seed), [normalised(w) for w in start]
    costs = fitness(population)
    for _ in range(rounds):
        order = sorted(range(len(population)), key=costs.__getitem__)[: max(2, int(len(population) * keep))]
        best = [population[i] for i in order]
        young = []
        while len(best) + len(young) < len(population):
            a, b = rng.sample(best, 2)
            child = [rng.choice(p) for p in zip(a, b)]
            young.append(normalised([w * rng.uniform(0, 2) if rng.random() < rate else w for w in child]))
        population, costs = best + young, [costs[i] for i in order] + fitness(young)
    i = min(range(len(population)), key=costs.__getitem__)
    return population[i], costs[i]


def differential_evolution(fitness: Fitness, start: list[list[float]], rounds: int = 10, weight: float = 0.8, cross: float = 0.7, seed: int = 0) -> tuple[list[float], float]:
    rng, population = random.Random(seed), [normalised(w) for w in start]
    costs = fitness(population)
    for _ in range(rounds):
        trials = []
        for i, x in enumerate(population):
            a, b, c = (population[j] for j in rng.sample([j for j in range(len(population)) if j != i], 3))
            fixed = rng.randrange(len(x))
            trials.append(normalised([a[d] + weight * (b[d] - c[d]) if d == fixed or rng.random() < cross else x[d] for d in range(len(x))]))
        for i, cost in enumerate(fitness(trials)):
            if cost <= costs[i]:
                population[i], costs[i] = trials[i], cost
    i = min(range(len(population)), key=costs.__getitem__)
    return population[i], costs[i]


def descend(fitness: Fitness, start: list[float], rounds: int = 10, step: float = 0.1, decay: float = 0.8) -> tuple[list[float], float]:
    """Finite differences along every degree at once, with a step that shrinks where nothing improves."""
    at = normalised(start)
    cost = fitness([at])[0]
    for _ in range(rounds):
        tries = [normalised([w + (step if i == d else 0) for i, w in enumerate(at)]) for d in range(len(at))]
        slope = [c - cost for c in fitness(tries)]
        size = max(map(abs, slope)) or 1.0
        new = normalised([w - step * s / size for w, s in zip(at, slope)])
        choices = [*tries, new]
        costs = [c + cost for c in slope] + fitness([new])
        i = min(range(len(choices)), key=costs.__getitem__)
        if costs[i] < cost:
            at, cost = choices[i], costs[i]
        else:
            step *= decay
    return at, cost


def nelder_mead(fitness: Fitness, start: list[float], rounds: int = 40, size: float = 0.1) -> tuple[list[float], float]:
    """The simplex method on weights; the first simplex and shrinks are evaluated at once."""
    points = [start] + [[w + (size if i == d else 0) for i, w in enumerate(start)] for d in range(len(start))]
    costs = fitness(points)
    for _ in range(rounds):
        order = sorted(range(len(points)), key=costs.__getitem__)
        points, costs = [points[i] for i in order], [costs[i] for i in order]
        centre = [sum(c) / (len(points) - 1) for c in zip(*points[:-1])]
        moves = [[c + t * (c - w) for c, w in zip(centre, points[-1])] for t in (1, 2, 0.5, -0.5)]
        got = fitness(moves)  # reflected, expanded, contracted outside and inside: one job
        i = min(range(4), key=got.__getitem__)
        if got[i] < costs[-1]:
            points[-1], costs[-1] = moves[i], got[i]
        else:
            points = [points[0]] + [[(a + b) / 2 for a, b in zip(points[0], p)] for p in points[1:]]
            costs = [costs[0], *fitness(points[1:])]
    i = min(range(len(points)), key=costs.__getitem__)
    return normalised(points[i]), costs[i]
