import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.functions import bases as B
from helixframe.functions import strand as S
from helixframe.operators import align, channel, clusters, codes, correction, jpeg, near, packets, search, ternary
from helixframe.sources import models


def value(spark, row, schema, f):
    return spark.createDataFrame([row], schema).select(f).first()[0]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("name", ["raptor", "lt", "online"])
def test_solvers(name):
    r, k = random.Random(1), 60
    how, data = codes.code(name, k), [random.Random(i).getrandbits(80) for i in range(60)]
    sent = []
    for seed in range(180):
        x = 0
        for i in codes.bits(how.sources(seed)):
            x ^= data[i]
        sent.append((seed, x))
    got = codes.solve(how, sent)
    assert got == dict(enumerate(data))
    few = codes.solve(how, r.sample(sent, 30))
    assert all(data[i] == d for i, d in few.items())
    peeled = codes.solve(how, sent, "peel")
    assert all(data[i] == d for i, d in peeled.items()) and (name == "raptor" or len(peeled) == k)


def test_correction():
    r = random.Random(2)
    # Published check values of the three polynomials over "123456789".
    assert [correction.crc(b"123456789", c) for c in "BHLQ"] == [0xEA, 0x31C3, 0xCBF43926, 0x6C40DF5F0B497347]
    for parity in (2, 4, 8):
        for _ in range(40):
            data = r.randbytes(r.randint(1, 300))
            word = bytearray(correction.rs_encode(data, parity))
            for at in range(0, len(word), 255):
                n = min(255, len(word) - at)
                for i in r.sample(range(n), min(parity // 2, n)):
                    word[at + i] ^= r.randint(1, 255)
            assert correction.rs_decode(bytes(word), parity) == data
    rows = [r.randbytes(20) for _ in range(9)]
    coded = correction.rs_encode_all(rows, 2)
    assert coded == [correction.rs_encode(x, 2) for x in rows]
    assert correction.rs_decode_all([*coded, None], 2) == [*rows, None] == [*correction.rs_decode_all(coded, 2), None]
    assert correction.crc_decode(correction.crc_encode(b"ab", "Q"), "Q") == b"ab" and correction.crc_decode(b"abc") is None


@pytest.mark.parametrize("parity", [1, 2, 3, 4, 12])
def test_words_of_all_lengths_at_once(parity, monkeypatch):
    """Findings F12 and F20: rows of many lengths and errors give what they give one by one, and few are done one by one."""
    r = random.Random(parity)
    data = [r.randbytes(n) for n in [0, 1, 2, 46, 47, 47, 47, 255 - parity, 256, 600] * 20]
    words = correction.rs_encode_all(data, parity)
    assert words == [correction.rs_encode(d, parity) for d in data]
    for wrong in range(5):
        sent: list = [None]
        for w in words:
            w = bytearray(w)
            for i in r.sample(range(len(w)), min(wrong, len(w))):
                w[i] ^= r.randrange(1, 256)
            sent.append(bytes(w))
        want = [None if w is None else correction.rs_decode(w, parity) for w in sent]
        assert correction.rs_decode_all(sent, parity) == want
        if wrong <= min(parity // 2, 2):
            with monkeypatch.context() as m:
                m.setattr(correction, "rs_decode", lambda *a: pytest.fail("one by one"))
                some = [i for i, w in enumerate(sent) if w is not None and parity < len(w) <= 255]
                assert correction.rs_decode_all([sent[i] for i in some], parity) == [want[i] for i in some]


def test_packets_survive_losses(spark):
    r = random.Random(3)
    data = {1: r.randbytes(3000), 2: b"x", 3: b"", 4: r.randbytes(47 * 16)}
    df = spark.createDataFrame([*((k, bytearray(d)) for k, d in data.items()), (5, None)], "id long, data binary")
    sent = packets.encode(df, "id", "data", 47, 16, 1.0, scramble=True)
    rows = sent.where("seed % 5 != 1").select("file_id", "block", "k", "seed", packets.packet_strand(F.col("packed")).alias("strand"))
    rows = rows.withColumn("strand", F.when(F.col("seed") == 2, F.concat(F.lit("TTTTTTTTTTTT"), F.expr("substr(strand, 13)"))).otherwise(F.col("strand"))).drop("seed")
    got = packets.parse(rows.unionByName(rows), scramble=True)
    assert got.where("status = 'corrupt'").count() > 0
    sizes = sent.select("file_id", "block", "k", "n_bytes").distinct()
    back = {}
    for x in packets.assemble(packets.decode(got), sizes).orderBy("file_id", "block").collect():
        back[x["file_id"]] = back.get(x["file_id"], b"") + bytes(x["data"])
        assert x["n_missing"] == 0
    assert back == {k: d for k, d in data.items() if d}
    none = packets.assemble(packets.decode(got.where("false")), sizes).collect()
    assert all(x["n_missing"] == max(-(-len(x["data"]) // 47), 4) and not any(x["data"]) for x in none)


@pytest.mark.parametrize("name", ["raptor", "lt", "online"])
def test_blocks_of_one_size_are_solved_at_once(spark, name, monkeypatch):
    """A call of the solver for each set of seeds, not for each block; and what it fixes is what each block's own equations fix."""
    r = random.Random(7)
    data = {(f, 0): r.randbytes(47 * k - r.randrange(47)) for f, k in enumerate([5, 5, 5, 9, 9, 1, 2])}
    blocks = spark.createDataFrame([(f, b, bytearray(d)) for (f, b), d in data.items()], "file_id int, block long, data binary").coalesce(1)
    rows = packets.encode_blocks(blocks, 47, 2.0, name).collect()
    for x in rows:
        k, own = x["k"], data[x["file_id"], x["block"]].ljust(47 * x["k"], b"\0")
        value = 0
        for i in x["used"]:
            value ^= int.from_bytes(own[i * 47 : i * 47 + 47], "big")
        plain = packets.masked(x["seed"]).to_bytes(4, "little") + value.to_bytes(47, "big")
        assert bytes(x["packed"]) == correction.rs_encode(plain, 2) and x["degree"] == len(x["used"]) and x["n_bytes"] == len(data[x["file_id"], x["block"]])
        assert list(x["used"]) == codes.used_chunks(codes.code(name, k), x["seed"])
    got = [(x["file_id"], x["block"], x["k"], x["seed"], x["packed"][4:51]) for x in rows if x["seed"] % 10 != 3]
    got += [(0, 0, 5, 0, bytearray(b"x" * 47)), (3, 0, 9, 77, bytearray(b"short")), got[-1]]  # another payload, another length, a copy
    sent = spark.createDataFrame(got, "file_id int, block long, k int, seed long, payload binary").coalesce(1)
    want = {}
    for key in data:
        mine = {(s, bytes(p)) for f, b, _, s, p in got if (f, b) == key and len(p) == 47 and (s, f) != (0, 0)}
        k = max(4, -(-len(data[key]) // 47))
        want |= {(*key, i): d.to_bytes(47, "big") for i, d in codes.gauss([(codes.sources(codes.code(name, k), s), int.from_bytes(p, "big")) for s, p in mine]).items()}
    assert {(x["file_id"], x["block"], x["chunk_idx"]): bytes(x["data"]) for x in packets.decode(sent, name).collect()} == want
    plan = packets.decode(sent, name)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_packets_that_cover_a_block(spark):
    """The same packets as by the rule applied one by one; blocks aren't groups of a task each."""
    r = random.Random(8)
    rows = [(f, b, s, sorted(r.sample(range(9), r.randrange(0, 6))), r.choice([0.0, 0.5, 1.0])) for f in range(4) for b in range(3) for s in range(14)]
    want = []
    for f, b in {x[:2] for x in rows}:
        mine = sorted((x for x in rows if x[:2] == (f, b)), key=lambda x: (x[4], x[2]))
        total = {i: sum(i in x[3] for x in mine) for i in range(9) if any(i in x[3] for x in mine)}
        need, have = 0.9 * sum(total.values()) / len(total), dict.fromkeys(total, 0)
        for _, _, seed, used, _ in mine:
            if any(have[i] < min(need, total[i]) for i in used):
                want.append((f, b, seed))
                have.update({i: have[i] + 1 for i in used})
    found = search.cover(spark.createDataFrame(rows, "file_id long, block long, seed long, used array<int>, error_prob double"))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_task_gives_on_its_best_packets_only(spark):
    r = random.Random(9)
    rows = [(f, 0, s, r.choice([0.0, 0.5, 1.0]), f"{f}-{s}") for f in range(30) for s in range(20)]
    rows += [(f, 0, s, e + 1, "later") for f, _, s, e, _ in rows[:50]] + [(0, 0, 0, -1.0, "first"), (0, 0, 0, 0.0, "second")]
    sent = spark.createDataFrame(r.sample(rows, len(rows)), "file_id long, block long, seed long, error_prob double, strand string").repartition(3)
    best = {}
    for x in sorted(rows, key=lambda x: x[3]):
        best.setdefault(x[:3], x)
    want = sorted(best.values(), key=lambda x: (x[3], *x[:3]))
    for n in (1, 25, 700):
        found = search.best_packets(sent, n)
        assert list(map(tuple, found.collect())) == want[:n]
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert search.best_packets(sent.where("false"), 5).count() == 0


def test_alignment(spark):
    r = random.Random(4)
    for _ in range(150):
        a, b = ("".join(r.choices("ACGT", k=r.randint(0, 25))) for _ in range(2))
        d = edits(a, b)
        script = align.edit_script(a, b)
        assert sum(op != "=" for op in script) == d
        assert near.edit_distances([a], [b])[0, 0] == d
    assert [align.kmer_alignment("ACGT", x) for x in ("ACTT", "AGT", "ACT")] == [list("ACTT"), ["A", "", "G", "T"], ["A", "C", "", "T"]]
    got = [value(spark, (c,), "c string", align.cigar_identity(F.col("c"))) for c in ("10=", "10D", "5=5X", "")]
    assert got == [1.0, 0.0, 0.5, 0.0]
    assert align.similarity("kitten", "sitting") == pytest.approx(8 / 13)


def test_clusters_and_consensus(spark):
    r = random.Random(5)
    heads = ["".join(r.choices("ACGT", k=120)) for _ in range(6)]
    ways = channel.Channel(identity=(97.0, 99.0, 0.5), start_rate=(0, 0), end_rate=(0, 0))
    strands = spark.createDataFrame(list(enumerate(heads)), "strand_id long, strand string")
    reads = channel.simulate_strands(strands, 7, ways, "strand_id", "strand")
    again = channel.simulate_strands(strands.repartition(3), 7, ways, "strand_id", "strand")
    assert reads.exceptAll(again).isEmpty()  # the same whatever the partitions
    reads = reads.select("strand_id", "read_id", "seq").cache()
    for found in (clusters.leaders(reads), clusters.clusters(reads)):
        rows = found.join(reads, "read_id")
        assert rows.groupBy("cluster_id").agg(F.count_distinct("strand_id").alias("n")).where("n != 1").isEmpty()
        assert found.select("cluster_id").distinct().count() == 6 and found.count() == 42
    merged = clusters.consensus(clusters.oriented(found, reads), 7)
    best = clusters.best_match(merged.select(F.col("cluster_id").alias("cand_id"), "seq").unionByName(merged.select((-F.col("cluster_id") - 1).alias("cand_id"), clusters.S.reverse_complement(F.col("seq")).alias("seq"))), strands.select(F.col("strand_id").alias("ref_id"), F.col("strand").alias("seq")), metric="ratio")
    assert best.where("score > 0.97").select("ref_id").distinct().count() == 6
    assert clusters.vote(["AC-T", "AC-T", "A-GT"]) == "ACGT"  # two gaps weigh 0.8


def test_ternary(spark):
    r = random.Random(6)
    text = bytes(r.choices(range(7), [50, 20, 9, 5, 3, 2, 1], k=60))
    codes_ = ternary.huffman_codes({b: text.count(bytes([b])) for b in set(text)})
    assert not any(a != b and b.startswith(a) for a in codes_.values() for b in codes_.values())
    df = spark.createDataFrame([(bytearray(text),)], "d binary").withColumn("s", ternary.rotate(ternary.to_trits(F.col("d"), codes_)))
    row = df.select("s", ternary.from_trits(ternary.unrotate(F.col("s")), codes_).alias("h")).first()
    assert bytes.fromhex(row["h"]) == text and not any(c * 2 in row["s"] for c in "ACGT")
    assert value(spark, ("AACG",), "s string", ternary.unrotate(F.col("s"))) is None
    framed = spark.createDataFrame([("0120",)], "t string").select(ternary.framed(F.col("t")).alias("f")).select("f", ternary.unframed(F.col("f")).alias("t")).first()
    assert len(framed["f"]) == 100 and framed["t"] == "0120"
    strand = "".join(r.choices("ACGT", k=225))
    made = ternary.oligos(spark.createDataFrame([(1, strand)], "k int, strand string"), "k")
    assert ternary.overlay(ternary.read_oligos(made.unionByName(made)), "k").first()["strand"] == strand
    odd = [(1, 0, "TA"), (1, 0, "GA"), (1, 0, "TC"), (1, 2, "GG"), (2, 1, "é"), (3, 0, "")]  # finding F13: ties, gaps and copies, strands side by side
    got = ternary.overlay(spark.createDataFrame(odd + [(4, 0, "AC")], "k int, idx long, piece string"), "k")
    assert {r["k"]: r["strand"] for r in got.collect()} == {1: "TA" + "_" * 48 + "GG", 2: "_" * 25 + "é", 4: "AC"}
    assert not any("Generate" in x for x in [got._jdf.queryExecution().optimizedPlan().toString()])  # no row for each base
    assert ternary.parse_oligo(None) == ternary.parse_oligo("ACGT") == (None, None)


def test_ternary_by_the_batch(spark):
    """Finding F25: slices are coded and read by the batch, as the columns do it, and neighbours of a batch leave it as one row."""
    r = random.Random(9)
    texts = [bytes(r.choices(range(9), [50, 20, 9, 5, 3, 2, 1, 1, 1], k=n)) for n in (0, 1, 49, 50, 51, 100, 7000)] + [None, bytes([0, 77, 0])]
    df = spark.createDataFrame([(i, None if t is None else bytearray(t)) for i, t in enumerate(texts)], "k int, d binary").coalesce(1)
    counts = ternary.byte_frequencies(df.where("k < 8"), "d")
    assert counts == {b: n for b in range(256) if (n := sum(t.count(b) for t in texts[:7]))}
    codes_ = ternary.huffman_codes(counts)
    made = ternary.coded(df, "k", "d", codes_).cache()
    want = packets.source_blocks(df.where("k < 8"), "k", "d", 50, 1).select("file_id", "block", ternary.rotate(ternary.to_trits(F.col("data"), codes_)))
    assert {tuple(x) for x in made.where("k < 8").collect()} == {tuple(x) for x in want.collect()}
    assert [x["strand"] for x in made.where("k = 8").collect()] == [None]  # 77 has no code
    pieces = ternary.decoded(made, "k", codes_)
    assert pieces.count() == 6
    for some in (pieces, ternary.decoded(made.repartition(3), "k", codes_)):
        assert {x["k"]: bytes(x["data"]) for x in ternary.joined(some, "k").collect()} == {i: texts[i] for i in range(1, 7)}
    strands = ["".join(r.choices("ACGT", k=r.randrange(12))) for _ in range(600)] + [None, "", "CAA", "CN", "é", "AC", "A"]
    odd = spark.createDataFrame([(i, s) for i, s in enumerate(strands)], "i int, s string")
    told = {x["i"]: x["h"] for x in odd.select("i", ternary.from_trits(ternary.unrotate(F.col("s")), codes_).alias("h")).collect()}
    got = ternary.coded_bytes(pa.array(strands, pa.string()), codes_).to_pylist()
    assert {i: None if b is None else b.hex() for i, b in enumerate(got)} == told and 20 < sum(b is not None for b in got) < 600
    one = ternary.huffman_codes({5: 3})
    assert ternary.coded_bytes(pa.array(["C", "CG", "A"]), one).to_pylist() == [b"\5", b"\5\5", None]
    plan = ternary.joined(pieces, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Eval" not in plan and "Generate" not in plan


def test_oligos_by_the_batch(spark):
    r = random.Random(8)
    bases = lambda n: "".join(r.choices("ACGT", k=n))
    strands = [(i, bases(n)) for i, n in enumerate([0, 99, 100, 124, 125, 188, 188, 1000])] + [(90, None)]
    want = {(i, j): ternary.make_oligo(s[j * 25 : j * 25 + 100], j, "12") for i, s in strands if s for j in range((len(s) - 100) // 25 + 1)}
    made = ternary.oligos(spark.createDataFrame(strands, "k int, strand string"), "k", file_trits="12")
    assert {(x["k"], x["idx"]): x["oligo"] for x in made.collect()} == want
    other = [bases(117) for _ in range(40)] + [None, "", "é" + bases(116), "N" + bases(116), *want.values()]
    other += [o[:60] + "ACGT"[("ACGT".index(o[60]) + 1) % 4] + o[61:] for o in want.values()] + [o[:-1] for o in want.values()]
    rows = [(i, t, o) for i, o in enumerate(other) for t in (False, True)]
    turn = lambda o: None if o is None else o[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame(rows, "i int, t boolean, o string").where("o IS NULL OR NOT contains(o, 'é') OR NOT t")
    read = ternary.read_oligos(df, "o", F.col("t"))
    expected = {(i, t): ternary.parse_oligo(turn(o) if t else o) for i, t, o in rows if not (t and o and "é" in o)}
    assert {(x["i"], x["t"]): (x["idx"], x["piece"]) for x in read.collect()} == {k: v for k, v in expected.items() if v[0] is not None}
    plan = made._jdf.queryExecution().optimizedPlan().toString() + read._jdf.queryExecution().optimizedPlan().toString()
    assert "Eval" not in plan and "transl" not in plan  # by the batch, not by the row


def test_rule_expressions(spark):
    at = lambda text, s: value(spark, (s,), "s string", B.parse_rules(text, F.col("s")))
    assert at("max(gc(40, 60), homopolymer)", "ACGTACGT") == 0.0
    assert at("sum(constant(0.25), constant(0.5))", "A") == 0.75 and at("min(constant(0.25), illegal)", "AX") == 0.25
    for bad in ("nothing", "max(gc", "gc) x", "sum()"):
        with pytest.raises(ValueError):
            B.parse_rules(bad, F.col("s"))


def test_spaced_identifiers(spark):
    df = spark.createDataFrame([("abcd", "0123456789")], "i string, p string").select(B.spaced(F.col("i"), F.col("p"), 2).alias("w"))
    row = df.select("w", B.unspaced(F.col("w"), 4, 2).alias("u")).first()
    assert row["w"] == "a01b23c45d6789" and tuple(row["u"]) == ("abcd", "0123456789")


def test_numbers_without_room_keep_their_low_digits(spark):
    """Findings F15 to F18: numbers of more digits than the strand has bases."""
    at = lambda n, width: value(spark, (n,), "n long", B.base_four(F.col("n"), width))
    assert at(4**8 + 27, 8) == "AAAAACGT" and at(4**10 * 3 + 1, 10) == "AAAAAAAAAC" and at(7 * 4**12 - 1, 12) == "T" * 12
    assert at(0, 4) == "AAAA" and at(27, 4) == "ACGT" and at(27, 3) == "CGT"


def test_spans_and_intervals(spark):
    flags = spark.createDataFrame([(1, i, i not in (3, 8)) for i in range(12)], "f int, chunk_idx long, ok boolean")
    got = sorted(tuple(x) for x in jpeg.valid_spans(flags, "f", 4).collect())
    assert got == [(1, 0, 2), (1, 4, 7), (1, 9, 11)]
    found = jpeg.markers(spark.createDataFrame([(1, bytearray(b"\xff\xd8a\xff\x00\xff\xd0\xff"))], "f int, d binary"), "f", "d")
    assert sorted(tuple(x) for x in found.collect()) == [(1, 0, "D8"), (1, 5, "D0")]


def test_searches():
    cost = lambda many: [sum((w - t) ** 2 for w, t in zip(search.normalised(x), (0.1, 0.6, 0.3))) for x in many]
    r = random.Random(7)
    start = [[r.random() for _ in range(3)] for _ in range(8)]
    first = min(cost(start))
    assert search.evolve(cost, start, 20)[1] <= first
    assert search.differential_evolution(cost, start, 30)[1] < 0.01
    assert search.descend(cost, start[0], 60)[1] < cost([start[0]])[0]
    assert search.nelder_mead(cost, start[0], 60)[1] < 0.01


def test_models(spark, tmp_path):
    (tmp_path / "m").write_text("ACGT,0.9;AGT,0.06;\nAAAA,0.8;AAA,0.1\n")
    assert [(x["kmer"], x["alt"], x["p"]) for x in models.read_error_model(spark, str(tmp_path / "m")).where("rank = 1").orderBy("kmer").collect()] == [("AAAA", "AAA", 0.1), ("ACGT", "AGT", 0.06)]
    (tmp_path / "a.paf").write_text("r1\t9\t0\t9\t+\tc\t50\t1\t10\t190\t200\t60\tAS:i:5\tcg:Z:9=\nr1\t9\t0\t9\t-\tc\t50\t1\t10\t195\t200\t60\tAS:i:7\tcg:Z:9=\nr2\t9\t0\t9\t+\tc\t50\t1\t10\t9\t10\t60\tAS:i:5\n")
    best = models.best_alignments(models.read_paf(spark, str(tmp_path / "a.paf"))).collect()
    assert [(x["read_name"], x["strand"], x["score"]) for x in best] == [("r1", "-", 7)]
    pairs = spark.createDataFrame([("ACGTA", "ACGTA"), ("ACG-TA", "ACGGTA"), (None, "A")], "ref string, read string")
    got = {(x["kmer"], x["alt"]): x["n"] for x in channel.error_model(pairs).collect()}
    assert got == {("ACGT", "ACGT"): 1, ("CGTA", "CGTA"): 1, ("ACGT", "ACGGT"): 1, ("CGTA", "CGGTA"): 1}


def test_reads_of_a_reference(spark):
    ref = "".join(random.Random(8).choices("ACGT", k=3000))
    reads = channel.simulate(spark, [("one", ref, 1.0, False), ("two", ref[::-1], 2.0, True)], 6000, channel.Channel(400, 100)).collect()
    total = sum(len(x["seq"]) for x in reads)
    assert total >= 6000 and all(len(x["seq"]) == len(x["qual"]) for x in reads)
    assert channel.target_bases("0.5x", 10**6) == 500000 and channel.target_bases("10.01m", 1) == 10010000


def test_decode_stream(spark, tmp_path):
    from helixframe.streaming.incremental import decode_stream

    data = random.Random(9).randbytes(47 * 20)
    sent = packets.encode(spark.createDataFrame([(1, bytearray(data))], "id long, d binary"), "id", "d", 47, 32, 1.0, correction="none")
    sent = sent.select("file_id", "block", "k", "seed", F.expr("substr(packed, 5)").alias("payload"))
    for i in range(3):
        sent.where(f"seed % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = decode_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("chunk_idx").collect()
    assert b"".join(bytes(x["data"]) for x in got) == data


def test_stream_gives_each_block_once_in_many_small_batches(spark, tmp_path):
    """Two packets a batch: a block comes in the batch that fills its rank, and what comes later changes nothing."""
    from helixframe.streaming.incremental import decode_stream

    data = {1: random.Random(1).randbytes(47 * 4), 2: random.Random(2).randbytes(47 * 9), 3: random.Random(3).randbytes(47 * 5)}
    sent = packets.encode(spark.createDataFrame([(k, bytearray(d)) for k, d in data.items()], "id long, d binary"), "id", "d", 47, 32, 2.0, correction="none")
    sent = sent.select("file_id", "block", "k", "seed", F.expr("substr(packed, 5)").alias("payload")).where("file_id != 3 OR seed < 3")  # too few for the third
    rows = sorted(sent.collect(), key=lambda r: (r["seed"], r["file_id"]))
    for i in range(0, len(rows), 6):
        spark.createDataFrame(rows[i : i + 6], sent.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = decode_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("file_id", "chunk_idx").collect()
    for k in (1, 2):
        assert b"".join(bytes(x["data"]) for x in got if x["file_id"] == k) == data[k]
    assert len(got) == 13


def test_blocks_of_neighbours_are_given_apart(spark, tmp_path):
    """Files whose ids share a state, negative ones and one without an id, some packets of which are lost, doubled or of another length."""
    from helixframe.streaming import incremental

    r = random.Random(10)
    data = {f: r.randbytes(47 * r.randrange(5, 20)) for f in (-33, -1, 0, 1, 31, 32, 33, None)}
    table = spark.createDataFrame([(f, bytearray(d)) for f, d in data.items()], "id long, d binary")
    sent = packets.encode(table, "id", "d", 47, 16, 2.0, correction="none").select("file_id", "block", "k", "seed", F.expr("substr(packed, 5)").alias("payload"))
    sent = sent.where("file_id IS NULL OR file_id != 33 OR seed < 3")
    for i in range(3):
        part = sent.where(f"seed % 3 = {i}")
        part.unionByName(part.where("seed % 2 = 0").limit(20)).unionByName(part.limit(5).withColumn("payload", F.lit(b"short"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = incremental.decode_stream(stream)
    run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = {}
    for x in spark.read.parquet(str(tmp_path / "out")).orderBy("file_id", "block", "chunk_idx").collect():
        got[x["file_id"]] = got.get(x["file_id"], b"") + bytes(x["data"])
    assert {f: d[: len(data[f])] for f, d in got.items()} == {f: d for f, d in data.items() if f != 33}
    assert run.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= 10


def test_many_wrong_bytes_are_set_right_at_once(monkeypatch):
    some, cases = random.Random(8), []
    for parity in (1, 2, 3, 5, 12, 13):
        words = []
        for i in range(120):
            w = bytearray(correction.rs_encode(some.randbytes(some.choice([1, 30, 64, 255 - parity])), parity))
            for at in some.sample(range(len(w)), min(len(w), some.randrange(parity // 2 + 3))):
                w[at] ^= some.randrange(1, 256)
            words.append(bytes(w))
        words += [some.randbytes(40) for _ in range(40)] + [None]
        cases.append((parity, words, [None if w is None else correction.rs_decode(w, parity) for w in words]))
    monkeypatch.setattr(correction, "rs_decode", None)  # no word is left to be looked at by itself
    for parity, words, want in cases:
        assert correction.rs_decode_all(words, parity) == want


def test_rs_files_of_odd_chunks(spark):
    """Chunks that are lost, spoiled, repeated, out of order, or of no file; runs of them are moved as one row, once."""
    size, some = 20, random.Random(9)
    files = {1: some.randbytes(20 * 9 + 3), 2: b"x", 3: some.randbytes(400), 4: some.randbytes(20 * 40), None: some.randbytes(70), 6: b"", 7: None}
    table = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in files.items()], "id long, data binary")
    words = [(r["id"], bytes(r["packed"])) for r in correction.rs_file_chunks(table, "id", "data", size, 0.2).collect()]
    assert sorted(words, key=str) == sorted(((i, correction.rs_encode(at.to_bytes(4, "big") + d[at * size : at * size + size], 4)) for i, d in files.items() if d for at in range(-(-len(d) // size))), key=str)
    strands = correction.rs_file_strands(table, "id", "data", size, 0.2)
    assert sorted(((r["id"], bytes(r["b"])) for r in strands.select("id", S.from_strand(F.col("strand")).alias("b")).collect()), key=str) == sorted(words, key=str)
    number = lambda w: int.from_bytes(w[1][:4], "big")
    sent = [w for w in words if (w[0], number(w)) not in {(1, 0), (1, 4), (3, 19), (4, 7), (4, 8)}]
    sent = [(i, bytes([w[0] ^ 1, *w[1:-1], w[-1] ^ 9]) if i == 3 else bytes(x ^ 5 for x in w) if (i, n) == (4, 20) else w) for i, w in sent for n in [number((i, w))]]
    sent += [w for w in words if w[0] == 4][5:12] + [(4, correction.rs_encode((30).to_bytes(4, "big") + bytes(size), 4)), (4, None), (4, b""), (4, b"abc"), (9, bytes(28)[:-1] + b"!")]
    want = {}
    for i, w in sent:
        plain = w and correction.rs_decode(w, 4)
        if plain:
            at = int.from_bytes(plain[:4], "big")
            have = want.setdefault(i, {})
            have[at] = min(plain[4:], have.get(at, plain[4:]))
    want = {i: (b"".join(c.get(at, bytes(size)) for at in range(max(c) + 1)), max(c) + 1 - len(c)) for i, c in want.items()}
    assert want[4][1] == 1 and want[1][1] == 2 and want[None] == (files[None], 0)
    for rows in (sent, some.sample(sent, len(sent))):
        back = correction.rs_file_data(spark.createDataFrame([(i, None if w is None else bytearray(w)) for i, w in rows], "id long, packed binary"), "id", size, 0.2)
        assert {r["id"]: (bytes(r["data"]), r["n_lost"]) for r in back.collect()} == want
    lost = correction.rs_strand_data(strands.unionByName(spark.createDataFrame([(1, "ACGN"), (1, None)], "id long, strand string")), "id", size, 0.2)
    assert {r["id"]: (bytes(r["data"]), r["n_lost"]) for r in lost.collect()} == {i: (d, 0) for i, d in files.items() if d}
    assert lost._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1  # chunks aren't gathered one by one
    long = correction.rs_file_data(correction.rs_file_chunks(table, "id", "data", 300, 0.02), "id", 300, 0.02)
    assert {r["id"]: bytes(r["data"]) for r in long.collect()} == {i: d for i, d in files.items() if d}


def test_windows_move_once(spark):
    """Strands from copies, spoiled and odd windows against votes by hand; agreeing neighbours leave a batch as one row, for one exchange."""
    from helixframe.operators.ternary import STRIDE, WINDOW

    some, rows = random.Random(11), []
    say = lambda n: "".join(some.choices("ACGT", k=n))
    for key in [*range(30), None]:
        strand = say(some.choice([100, 110, 125, 188, 400]))
        for _ in range(some.choice([1, 1, 2, 5])):
            for i in range((len(strand) - WINDOW) // STRIDE + 1):
                piece = strand[i * STRIDE : i * STRIDE + WINDOW]
                if some.random() < 0.2:
                    at = some.randrange(WINDOW)
                    piece = piece[:at] + some.choice(["A", "C", "N", "é", "", "GG"]) + piece[at + 1 :]
                if some.random() < 0.95:
                    rows.append((key, i + (key == 7) * 2, piece))
    rows += [(40, 0, ""), (41, 0, None), (42, 3, "ACG"), (43, 0, "é"), (44, 1, say(100)), (44, 2, say(100))]
    votes = {}
    for key, idx, piece in rows:
        for at, c in enumerate(piece or "", idx * STRIDE):
            votes.setdefault(key, {}).setdefault(at, []).append(c)
    want = {k: "".join(min(set(v[at]), key=lambda c: (-v[at].count(c), c)) if at in v else "_" for at in range(max(v) + 1)) for k, v in votes.items()}
    for few in (rows, some.sample(rows, len(rows))):
        got = ternary.overlay(spark.createDataFrame(few, "`a key` long, idx int, piece string"), "a key")
        assert {r["a key"]: r["strand"] for r in got.collect()} == want
    strand = say(188)
    batch = pa.RecordBatch.from_pydict({"k": [5] * 4, "idx": [0, 1, 2, 3], "piece": [strand[i : i + 100] for i in (0, 25, 50, 75)]})
    assert [(len(a), a[0].as_py()) for a in ternary._windows_joined(batch)[1:3]] == [(1, 0), (1, 4)] and len(ternary._windows_joined(batch)[3][0].as_py()) == 44
    plan = spark.createDataFrame(rows, "k long, idx int, piece string").transform(lambda t: ternary.overlay(t, "k"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_oligos_are_joined_where_they_are_read(spark):
    some = random.Random(15)
    rows = spark.createDataFrame([(i, "".join(some.choices("ACGT", k=some.choice([90, 100, 188, 300])))) for i in range(40)] + [(None, "ACGT" * 40)], "`a key` long, strand string")
    made = ternary.oligos(rows, "a key")
    odd = made.select("a key", F.when(F.col("idx") == 2, F.concat(F.lit("A"), "oligo")).when(F.col("a key") % 7 == 1, S.reverse_complement(F.col("oligo"))).otherwise(F.col("oligo")).alias("oligo"))
    odd = odd.unionByName(made.select("a key", "oligo").where("idx = 0")).unionByName(spark.createDataFrame([(1, None), (2, ""), (60, "ACGT")], "`a key` long, oligo string"))
    want = ternary.overlay(ternary.read_oligos(odd), "a key")
    got = ternary.overlay_oligos(odd, "a key")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and not got.isEmpty()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == want._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") - 1
