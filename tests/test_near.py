"""Joins by distance and similarity, first-fit clusters and best matches, against all pairs worked out one by one."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from helixframe.operators import channel, clusters, kmers, matching, near
from helixframe.operators.align import edit_distance, edit_script, lcs_length, similarity

TURN = str.maketrans("ACGT", "TGCA")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def strand(r, n):
    return "".join(r.choices("ACGT", k=n))


def changed(r, s, n):
    s = list(s)
    for _ in range(n):
        at = r.randrange(len(s) + 1)
        kind = r.randrange(3)
        if kind == 0:
            s.insert(at, r.choice("ACGT"))
        elif s and at < len(s):
            s[at] = r.choice("ACGT")
            if kind == 2:
                del s[at]
    return "".join(s)


def pool(seed, families=6, copies=6, n=90, most=9):
    r = random.Random(seed)
    out = ["", "A", "ACGT", "ACGA", "N" * 70, strand(r, 300)]
    for _ in range(families):
        head = strand(r, n + r.randrange(-8, 9))
        out += [changed(r, head, r.randint(0, most)) for _ in range(copies)] + [head[::-1].translate(TURN)]
    return out


def table(spark, strings, key="id"):
    return spark.createDataFrame([*enumerate(strings), (10**6, None)], f"{key} long, seq string")


def test_kernels():
    r = random.Random(1)
    a = [strand(r, n) for n in (0, 1, 5, 63, 64, 65, 128, 129, 200)] + ["ACGTé\U0001f600N", "N" * 64]
    b = [changed(r, s, r.randint(0, 30)) for s in a] + [strand(r, n) for n in (0, 64, 190)]
    got, common, places = near.edit_distances(a, b), near.common_lengths(a, b), near.equal_places(a, b)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            assert got[i, j] == distance(x, y) and common[i, j] == lcs_length(x, y) and places[i, j] == sum(p == q for p, q in zip(x, y))
    assert near.indel_ratios(["", "AC"], ["", "AG"]).tolist() == [[1.0, 0.0], [0.0, 0.5]]


@pytest.mark.parametrize("limit", [0, 3, 8, 40])
def test_edit_join(spark, limit):
    strings = pool(2)
    want = {(i, j, d) for i, a in enumerate(strings) for j, b in enumerate(strings) if abs(len(a) - len(b)) <= limit and (d := distance(a, b)) <= limit}
    rows = table(spark, strings)
    got = [tuple(r) for r in near.edit_join(rows, rows, limit).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    got = [tuple(r) for r in near.within_distance(rows, rows, limit, part=7, small=0).collect()]  # in tiles
    assert len(got) == len(set(got)) and set(got) == want


def test_hot_segments_are_split_and_lose_nothing(spark):
    r = random.Random(3)
    head = strand(r, 80)
    strings = sorted({changed(r, head, 2) for _ in range(60)})
    rows = table(spark, strings).where("seq IS NOT NULL")
    want = {(i, j) for i, a in enumerate(strings) for j, b in enumerate(strings) if distance(a, b) <= 2}
    assert {tuple(x) for x in near.segment_pairs(rows, rows, 2, hot=5).join(rows.toDF("a", "x"), "a").join(rows.toDF("b", "y"), "b").where(F.levenshtein("x", "y") <= 2).select("a", "b").collect()} == want


def sequential(reads, limit):
    heads, out = [], []
    for i, s in sorted(reads):
        turned = s[::-1].translate(TURN)
        for h, head in heads:
            if distance(head, s) <= limit or distance(head, turned) <= limit:
                out.append((h, i, distance(head, s) > limit, False))
                break
        else:
            heads.append((i, s))
            out.append((i, i, False, True))
    return out


@pytest.mark.parametrize(("limit", "block"), [(12, 4), (12, 512), (40, 7)])
def test_leaders_are_those_of_the_sequential_rule(spark, limit, block):
    r = random.Random(4)
    strings = [s for s in pool(5, families=7) if s]
    strings += strings[:9]  # copies
    r.shuffle(strings)
    reads = [(3 * i + 1, s) for i, s in enumerate(strings)]
    found = clusters.leaders(spark.createDataFrame([*reads, (0, None)], "read_id long, seq string"), limit, block)
    assert sorted(map(tuple, found.collect())) == sorted(sequential(reads, limit))


def test_leaders_of_nothing(spark):
    assert clusters.leaders(spark.createDataFrame([(1, None)], "read_id long, seq string")).count() == 0


def test_near_pairs_and_clusters(spark):
    strings = sorted({s for s in pool(6) if len(s) > 60})
    rows = spark.createDataFrame(list(enumerate(strings)), "read_id long, seq string")
    want = {(i, j, t) for i, a in enumerate(strings) for j, b in enumerate(strings) if i < j for t in (False, True) if distance(a, b[::-1].translate(TURN) if t else b) <= 10}
    assert {tuple(r) for r in clusters.near_pairs(rows, 10).collect()} == want


@pytest.mark.parametrize("metric", ["identity", "ratio"])
def test_best_match_has_every_candidate(spark, metric):
    r = random.Random(7)
    refs = [strand(r, r.randint(0, 90)) for _ in range(40)] + ["", "ACGT", "ACGT"]
    cands = [changed(r, refs[i], 6) for i in range(40)] + ["", "TTTT", strand(r, 12)]
    score = (lambda c, f: sum(x == y for x, y in zip(c, f)) / len(f) if f else 0.0) if metric == "identity" else similarity
    want = {(i, *max(((j, score(c, f)) for j, f in enumerate(refs)), key=lambda x: (x[1], -x[0]))) for i, c in enumerate(cands)}
    got = clusters.best_match(table(spark, cands, "cand_id"), table(spark, refs, "ref_id"), metric)
    assert {tuple(x) for x in got.collect()} == want
    tiles = near.best_of(table(spark, cands), table(spark, refs), metric, part=5, small=0)
    assert {tuple(x) for x in tiles.collect()} == want


def test_near_duplicates(spark):
    strings = pool(8, most=12)
    strings += strings[4:20]
    got = matching.near_duplicates(table(spark, strings, "read_id")).collect()
    want = {}
    for j, b in enumerate(strings):
        for i, a in enumerate(strings[:j]):
            if similarity(a, b) > 0.85:
                want[j] = (i, similarity(a, b))
                break
    assert {r["read_id"]: (r["first"], r["score"]) for r in got} == want
    assert matching.without_near_duplicates(table(spark, strings, "read_id").where("seq IS NOT NULL")).count() == len(strings) - len(want)


def test_centroids_of_large_clusters(spark):
    r = random.Random(9)
    rows = [(c, c * 1000 + i, changed(r, head, 6)) for c, (head, n) in enumerate([(strand(r, 50), 40), (strand(r, 40), 1), (strand(r, 30), 9)]) for i in range(n)]
    want = {}
    for c in range(3):
        mine = [(i, s) for k, i, s in rows if k == c]
        want[c] = min((sum(distance(s, t) for _, t in mine), i) for i, s in mine)
    got = clusters.centroids(spark.createDataFrame([*rows, (0, 5, None)], "cluster_id long, read_id long, seq string"), part=7)
    assert {r["cluster_id"]: (r["cost"], r["read_id"]) for r in got.collect()} == want


def test_distances_of_wide_tiles():
    r = np.random.default_rng(10)
    a = ["".join(np.array(list("ACGT"))[r.integers(0, 4, 150)]) for _ in range(20)]
    assert (near.edit_distances(a, a) == near.edit_distances(a, a).T).all() and (np.diag(near.edit_distances(a, a)) == 0).all()


def test_guesses_are_consensus_strands_of_samples(spark):
    """Two of six reads have a base more at one place, which outvotes the gaps of the others; samples that lack one of them are right."""
    r = random.Random(11)
    head = strand(r, 80)
    reads = [(7, i, head[:40] + "ACGT"[(i + "ACGT".index(head[40])) % 4] + head[40:] if i in (1, 3) else head) for i in range(6)]
    reads = [(c, i, s if i not in (3,) else reads[1][2]) for c, i, s in reads]
    rows = spark.createDataFrame(reads, "cluster_id long, read_id long, seq string")
    assert clusters.consensus(rows, 6).first()["seq"] != head
    assert head in [x["seq"] for x in clusters.guesses(rows).where("cluster_id = 7").collect()]


def test_close_matches_are_those_of_all_candidates(spark):
    """Finding F10: the same as looking at every candidate, but few are."""
    import difflib

    from helixframe.operators.matching import close_matches

    r = random.Random(10)
    known = ["".join(r.choices("ACGT", k=r.choice([60, 100, 188, 220]))) for _ in range(30)]
    rows = [x[:10] + "ACG" + x[14:] for x in known[:20]] + ["".join(r.choices("ACGT", k=80)) for _ in range(5)] + [known[0], "ACGTACG"]
    a, b = (spark.createDataFrame(list(enumerate(t)), f"{c} long, seq string") for t, c in ((rows, "id"), (known + known[:3], "known_id")))
    got = {x["id"]: (x["score"], x["match"]) for x in close_matches(a, b, 0.6, 6).collect()}
    mers = lambda s: {s[i : i + 6] for i in range(len(s) - 5)}
    want = {}
    for i, x in enumerate(rows):
        scores = [(difflib.SequenceMatcher(None, y, x).ratio(), y) for y in known if mers(x) & mers(y)]
        if scores and max(scores)[0] >= 0.6:
            want[i] = max(scores)
    assert got == want
    assert len(want) > 10
    plan = close_matches(a, b, 0.6, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan  # no score for each pair


def test_strands_in_others(spark):
    r = random.Random(5)
    whole = [(i % 50, strand(r, r.choice([0, 5, 40, 400])) + r.choice(["", "N", "é"]) + strand(r, 30)) for i in range(60)]  # ten ids come twice
    part = [(i, w[a : a + r.choice([1, 3, 15, 16, 17, 40])]) for i, (_, w) in enumerate(whole) for a in [r.randrange(len(w))]] + [(100, ""), (101, strand(r, 40)), (102, None), (0, whole[0][1][:20])]
    wholes = spark.createDataFrame([*whole, (99, None)], "whole_id long, seq string").repartition(3)
    parts = spark.createDataFrame(part, "part_id int, seq string")
    found = kmers.contained(parts, wholes)
    assert sorted(map(tuple, found.collect())) == sorted((p, w) for p, x in part for w, y in whole if x and x in y)
    assert found.columns == ["part_id", "whole_id"]


def test_no_k_mers_move_that_no_part_begins_with(spark):
    r = random.Random(6)
    wholes = spark.createDataFrame([(i, strand(r, 2000)) for i in range(50)], "whole_id long, seq string")
    parts = spark.createDataFrame([(0, strand(r, 60)), (1, wholes.first()["seq"][100:160])], "part_id long, seq string")
    found = kmers.contained(parts, wholes)
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert kmers.places(parts, wholes).count() <= 3
    assert [tuple(x) for x in found.collect()] == [(1, 0)]


def test_pair_distances(spark):
    """Finding F29: distances of pairs within a limit by the batch, as Spark's levenshtein has them, at the borders of the band too."""
    r, rows = random.Random(7), []
    bases = lambda n: "".join(r.choices("ACGT", k=n))
    for n in (0, 1, 3, 64, 65, 188, 188):
        for limit in (0, 1, 7, 40, 62):
            a = bases(n)
            rows += [(limit, a, b) for b in (a, a[limit:], a[limit + 1 :], bases(limit) + a, bases(limit + 1) + a, a[limit // 2 :] + bases(limit // 2), bases(n), "".join(c if r.random() < 0.8 else r.choice(["", "T", "é", c + "G"]) for c in a))]
    rows += [(limit, b, a) for limit, a, b in rows] + [(40, None, "A"), (40, "A", None), (40, None, None), (40, "A" * 100, "字" * 30)]
    df = spark.createDataFrame(rows, "n int, a string, b string")
    for limit in (0, 1, 7, 40, 62):
        some = [(a, b) for n, a, b in rows if n == limit]
        want = [x[0] for x in df.where(f"n = {limit}").coalesce(1).select(F.coalesce(F.levenshtein("a", "b", limit), F.lit(-1))).collect()]
        got = near.pair_distances(*(pa.array(list(x), pa.string()) for x in zip(*some)), limit).tolist()
        assert got == want and len(set(got)) > 1
    query = __spark_entry__.queries()["leader_distance"](spark, "/root/testdata/sf0.001")
    assert "levenshtein" not in query._jdf.queryExecution().optimizedPlan().toString()


def test_first_heads_by_guess(spark, monkeypatch):
    """Finding F32: heads are guessed by k-mers and only these are compared with each other; what is guessed wrong is mended."""
    r, base, sizes = random.Random(12), [], []
    whole = near.edit_distances
    monkeypatch.setattr(clusters, "edit_distances", lambda a, b: (sizes.append(len(a) * len(b)), whole(a, b))[1])

    def rule(reads, distance):
        heads = []
        for i, s in reads:
            if not heads or not (np.minimum(whole([h for _, h in heads], [s]), whole([h for _, h in heads], [s.translate(TURN)[::-1]])) <= distance).any():
                heads.append((i, s))
        return heads

    def noisy(s, share):
        s = "".join(c if r.random() >= share else r.choice(["", "A", "G", c + "T"]) for c in s)
        return s.translate(TURN)[::-1] if r.random() < 0.5 else s

    for n, share, distance in ((120, 0.04, 25), (120, 0.25, 40), (60, 0.3, 20), (10, 0.1, 3), (60, 0.02, 0)):
        base = ["".join(r.choices("ACGT", k=n)) for _ in range(6)]
        reads = [(i, noisy(base[i // 8], share)) for i in range(48)]
        sizes.clear()
        assert clusters.first_heads(reads, distance) == rule(reads, distance)
        assert share != 0.04 or sum(sizes) < 48 * 48 / 8
    table = spark.createDataFrame([(i, "ACGT" * 47) for i in range(20)], "strand_id long, seq string").coalesce(1)
    assert channel.simulate_strands(table, 2, channel.Channel()).rdd.getNumPartitions() >= 4  # one task otherwise


def test_scripts_of_bits():
    """Finding F32: edit scripts by columns of bits are those of the whole matrix."""
    r = random.Random(13)
    for n in (0, 1, 5, 63, 64, 65, 130):
        for letters in ("AC", "ACGTé"):
            a = "".join(r.choices(letters, k=n))
            for b in (a, a[1:], "".join(r.choices(letters, k=r.randrange(90))), "".join(c if r.random() > 0.2 else r.choice(["", "A", c + "C"]) for c in a)):
                cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(n + 1)]
                for i, x in enumerate(a, 1):
                    for j, y in enumerate(b, 1):
                        cost[i][j] = min(cost[i - 1][j - 1] + (x != y), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
                i, j, want = n, len(b), ""
                while i or j:
                    if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
                        i, j = i - 1, j - 1
                        want = ("=" if a[i] == b[j] else "X") + want
                    elif i and cost[i][j] == cost[i - 1][j] + 1:
                        i, want = i - 1, "D" + want
                    else:
                        j, want = j - 1, "I" + want
                assert edit_script(a, b) == want and edit_distance(a, b) == cost[n][len(b)]
