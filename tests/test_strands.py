import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.functions import rules as R
from helixframe.functions import strand as S
from helixframe.operators import fountain
from helixframe.operators.chunks import chunks, strands
from helixframe.sources.sequences import read_fasta, read_fastq, write_fasta


def value(spark, strand, f):
    return spark.createDataFrame([(strand,)], "s string").select(f(F.col("s"))).first()[0]


def test_bytes_and_bases(spark):
    data = [(bytes([0b00011011]), "ACGT"), (b"\xff", "TTTT"), (b"\xaa", "GGGG"), (b"", "")]
    for raw, bases in data:
        got = spark.createDataFrame([(raw,)], "b binary").select(S.to_strand(F.col("b"))).first()[0]
        assert got == bases
        assert bytes(value(spark, bases, S.from_strand)) == raw
    assert value(spark, "ACGX", S.from_strand) is None
    assert value(spark, "ACG", S.from_strand) is None
    assert value(spark, "AACG", S.reverse_complement) == "CGTT"


@pytest.mark.parametrize(
    "rule, strand, expected",
    [
        (lambda s: R.homopolymer(s), "AAAA", 0.0),
        (lambda s: R.homopolymer(s), "AAAAA", 1.0),
        (lambda s: R.gc_quartic(S.gc_percent(s)), "AAAAATTTTT", 1.0),
        (lambda s: R.gc_quartic(S.gc_percent(s)), "ATGC", 0.0),
        (lambda s: R.gc_quartic(S.gc_percent(s)), "GCGCGCCATA", 1.0),
        (lambda s: R.repeat_region(s), "ACCAAAAAAAAAAAAAATTAGACCAAAAAAAAAAAAAATTAG", 1.0),
        (lambda s: R.repeat_region(s), "AAAGTAGATAGATAGAAACACACACAGTACACACA", 0.0),
        (lambda s: R.repeat_region(s), "AAA", 0.0),
        (lambda s: R.small_repeats(s), "ACGTGCATACACGTGCATACACGTGCATAC", 1.0),
        (lambda s: R.unit_runs(s, 2), "AC" * 10, 0.001),
        (lambda s: R.unit_runs(s, 2), "AC" * 50, 0.045),
        (lambda s: R.unit_runs(s, 3), "ACG" * 100, 0.19),
        (lambda s: R.permutation(s, "A"), "A" * 100, 0.005),
        (lambda s: R.permutation(s, "C"), "C" * 200, 0.02),
        (lambda s: R.illegal_symbols(s), "ACGACTGACTX", 1.0),
        (lambda s: R.illegal_symbols(s), "AACGACTAGCG", 0.0),
        (lambda s: R.motifs(s), "AAGAAGTGCCATTCCGCCTGACCTAA", 1.0),
    ],
)
def test_rules(spark, rule, strand, expected):
    assert value(spark, strand, rule) == pytest.approx(expected, abs=1e-9)


def test_checksum(spark):
    coded = value(spark, "ACGT" * 5, S.with_checksum)
    assert coded == "ACGT" * 5 + "ATAG"  # 50 = 0302 to base four
    assert value(spark, coded, lambda s: S.checksum_ok(s, 20))
    assert not value(spark, "C" + coded[1:], lambda s: S.checksum_ok(s, 20))


def test_chunks_hold_all_bytes(spark):
    r = random.Random(3)
    rows = [(i, r.randbytes(n)) for i, n in enumerate([0, 1, 46, 47, 48, 500])] + [(9, None)]
    df = spark.createDataFrame(rows, "k long, data binary")
    back = {}
    for x in sorted(chunks(df, "k", "data", 47).collect()):
        back[x["k"]] = back.get(x["k"], b"") + bytes.fromhex(x["chunk_hex"])
    assert back == {k: d for k, d in rows if d}
    assert strands(df, "k", "data").where("length(strand) % 4 != 0").count() == 0


def test_strands_are_cut_where_a_batch_is_cut(spark, monkeypatch):
    """Strands made a piece of a batch at a time are those of the chunks, whatever the key's type."""
    from helixframe.operators import chunks as C

    r = random.Random(5)
    monkeypatch.setattr(C, "PIECE", 100)
    rows = [(f"k{i}", r.randbytes(n)) for i, n in enumerate([0, 1, 46, 47, 48, 500, 99, 100, 101])] + [("n", None)]
    df = spark.createDataFrame(rows, "k string, data binary").coalesce(1)
    want = chunks(df, "k", "data", 47).select("k", "chunk_idx", S.hex_to_strand(F.col("chunk_hex")).alias("strand"))
    assert sorted(map(tuple, strands(df, "k", "data").collect())) == sorted(map(tuple, want.collect())) != []
    assert strands(df.where("k = 'n'"), "k", "data").collect() == []


def test_default_rules_are_their_sum(spark):
    """Findings F8 and F14: the rules of a batch at once are the four columns' sum, and a filter works the strand out once."""
    r = random.Random(7)
    texts = ["", None, "A", "AAAAA", "CAAAAA", "AAAAC", "ACGTé", "NNNNN", "G" * 51] + ["".join(r.choices("ACGT", r.choice([[1, 1, 1, 1], [5, 1, 1, 5], [1, 4, 4, 1]]), k=r.choice([4, 49, 50, 51, 101, 188]))) for _ in range(300)]
    texts += [t[:20] + m + t[20:] for t, (m, _) in zip(texts[20:], R.MOTIFS)]
    s = F.col("s")
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    plain = R.homopolymer(s) + R.gc_band(S.gc_percent(s)) + R.windowed_gc(s) + R.motifs(s)
    assert df.select("s", plain.alias("a"), R.default_rules(s).alias("b")).where("a != b OR isnull(a) OR isnull(b)").collect() == []
    reads = df.where("length(s) > 18").select(s.alias("seq"))
    from helixframe.sources.sequences import fastq_slice

    sliced = fastq_slice(reads, 18, 164, R.gc_band(S.gc_percent(F.col("seq"))))
    plan = sliced._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring(") <= 1, plan
    assert sliced.count() == sum(30 <= 100 * sum(c in "GC" for c in t[18:164]) / len(t[18:164]) <= 70 for t in texts if t and len(t) > 18)


def test_unit_runs(spark):
    """Findings F4 and F23: units are cut from the start, and a rest is none."""
    for text, unit, n in (("ACACAC", 2, 3), ("TACACAC", 2, 2), ("AAAAA", 2, 2), ("", 2, 0), ("A", 2, 0), (None, 2, 0), ("ACGACGACGTT", 3, 3), ("TTACGACG", 3, 1), ("ACGTGTGTAC", 2, 3), ("A\nA\nA\n", 2, 3)):
        assert value(spark, text, lambda s: S.unit_run(s, unit)) == n, text


def test_symbols(spark):
    assert fountain.symbol_counts(120) == (19, 10)
    assert [r["code"] for r in fountain.gray_sequence(spark, 5, 3).orderBy("idx").collect()] == [7, 13, 14, 11, 25]
    used = spark.createDataFrame([(1, 0), (1, 3), (2, 3), (2, 4)], "packet_id long, symbol_idx long")
    edges = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "symbol_idx long, source_idx long")
    got = sorted(tuple(r) for r in fountain.cancelled(used, edges, 3).collect())
    assert got == [(1, 1), (2, 0)]


def test_sequences(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one depth=2.5 circular=true\nacgt\nAC\n\n>two\nGG\n")
    got = {r["name"]: r for r in read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert (got["one"]["seq"], got["one"]["depth"], got["one"]["circular"]) == ("ACGTAC", 2.5, True)
    assert (got["two"]["seq"], got["two"]["depth"], got["two"]["circular"]) == ("GG", 1.0, False)
    (tmp_path / "a.fastq").write_text("@r1 x\nacg\n+\n!!!\n\n@r2\nTT\n+\n##\n")
    assert [(r["name"], r["seq"], r["qual"]) for r in read_fastq(spark, str(tmp_path / "a.fastq")).orderBy("name").collect()] == [("r1", "ACG", "!!!"), ("r2", "TT", "##")]
    write_fasta(read_fasta(spark, str(tmp_path / "a.fasta")), str(tmp_path / "out"))
    assert read_fasta(spark, str(tmp_path / "out")).count() == 2


def test_impossible_seeds(spark):
    from helixframe.plans.catalogue import impossible_seeds_16

    assert tuple(impossible_seeds_16(spark, "").first()) == (65536, 4084)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_queries_agree_with_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from helixframe.plans.catalogue import QUERIES, SQL

    con = duckdb.connect()
    for name in ("documents", "orders", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    for name in ("strand_encode", "base_counts", "windowed_gc", "checksum_verify", "exact_matches", "aux_cancellation"):
        got = QUERIES[name](spark, "/root/testdata/sf0.001")
        cur = con.execute(SQL[name])
        cols = [c[0] for c in cur.description]
        assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, map(tuple, cur.fetchall()))), name


def test_forms_are_judged_by_the_batch(spark):
    """The same by the default rules as by any other ones, in one call of Python workers."""
    from helixframe.functions import rules as R
    from helixframe.operators.screening import screened_strands

    r = random.Random(12)
    texts = [r.randbytes(r.randrange(0, 60)).hex() for _ in range(60)] + ["", None, "00" * 47, "1b" * 40, "f"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, chunk_hex string")
    found = screened_strands(rows, [0, 1, 6, 11])
    want = screened_strands(rows, [0, 1, 6, 11], rules=lambda s: R.default_rules(s))
    assert found.columns == want.columns and sorted(found.collect()) == sorted(want.collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "default_errors" not in plan and "translate" not in plan


def test_bases_by_block_are_counted_where_they_are(spark):
    from helixframe.operators.kmers import block_bases

    r = random.Random(13)
    texts = ["".join(r.choices("ACGT", k=r.randrange(0, 100))) for _ in range(40)] + ["", None]
    found = block_bases(spark.createDataFrame([(x,) for x in texts], "strand string").repartition(3), "strand", 32)
    want = {}
    for x in filter(None, texts):
        for i, c in enumerate(x):
            row = want.setdefault(i // 32, [0] * 5)
            row["ACGT".index(c)] += 1
            row[4] += 1
    assert {x[0]: list(x[1:]) for x in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_cancelled_sets_are_rows_of_bits(spark):
    k, width = 6, 70
    edges = [(s, (s * 5 + j) % k) for s in range(width - k) for j in range(1 + s % 3)]
    sets = [(1, [0, 1, 6]), (1, [1, 2, 69]), (2, [6, 7, 8, 8]), (3, []), (4, list(range(width))), (-5, [5])]
    df = spark.createDataFrame(sets, "packet_id long, symbols array<long>")
    e = spark.createDataFrame(edges, "symbol_idx long, source_idx long")
    got = fountain.cancelled_sets(df, e, k, width)
    used = df.select("packet_id", F.explode("symbols").alias("symbol_idx")).distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fountain.cancelled(used, e, k).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan and plan.count("Aggregate") == 1 and "RepartitionByExpression" in plan.split("Aggregate")[1]  # a row for each packet, dealt before it is held


def test_exact_joins_move_strands_once(spark, tmp_path):
    """Findings F27 and F34: one deal of the digests; documents filtered by the small side."""
    from helixframe.plans import catalogue, codec

    spark.createDataFrame([(i, "x" * 60 + str(i % 3)) for i in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x" * 47), (2, "y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    dealt = catalogue.exact_matches(spark, str(tmp_path))
    assert "RepartitionByExpression [digest" in dealt._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["n_shared"] for r in dealt.collect()} == {i: 2 for i in range(9)}
    absent = codec.exact_absent(spark, str(tmp_path))
    assert "LeftSemi" in absent._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in absent.collect()] == [(2, 0)]


@pytest.mark.parametrize("k", [1, 3, 9, 16, 17, 20, 31, 32])
def test_distinct_mers_by_the_table(k):
    """Finding F36: strands of one length together, beside odd, short, null and empty ones."""
    r = random.Random(k)
    texts = ["".join(r.choices("ACGT", [9, 3, 1, 1], k=r.choice([0, 5, 31, 40, 188]))) for _ in range(80)] + [None, "é" * 40, "ACGN" * 12, "ACGT" * 47]
    want = [0 if s is None else len({s[i : i + k] for i in range(len(s) - k + 1)}) for s in texts]
    assert S.distinct_of(pa.array(texts, pa.string()), k).tolist() == want
    assert S.distinct_of(pa.array(texts, pa.string())[7:50], k).tolist() == want[7:50]
