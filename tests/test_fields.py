"""Field arithmetic as columns against the plain functions, and words of three bases against all words."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from helixframe.functions import strand as S
from helixframe.operators import align, correction, fields


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(1)
    rows = [None, b"", b"\0", b"a", b"123456789", bytes(range(256)), r.randbytes(252), r.randbytes(253), r.randbytes(254), r.randbytes(700)]
    return spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate(rows)], "i long, d binary")


def test_checksums(data):
    for letter, check in (("B", 0xEA), ("H", 0x31C3), ("L", 0xCBF43926), ("I", 0xCBF43926), ("Q", 0x6C40DF5F0B497347)):
        got = {r["i"]: r for r in data.select("i", "d", fields.crc(F.col("d"), letter).alias("c"), fields.crc_bytes(F.col("d"), letter).alias("b"), fields.crc_checked(fields.crc_bytes(F.col("d"), letter), letter).alias("back"), fields.crc_checked(F.col("d"), letter).alias("wrong")).collect()}
        assert got[4]["c"] == (check - (1 << 64) if check >> 63 else check)
        for r in got.values():
            if r["d"] is None:
                assert r["c"] is r["b"] is r["back"] is None
                continue
            d = bytes(r["d"])
            assert r["c"] % (1 << 64) == correction.crc(d, letter) and bytes(r["b"]) == correction.crc_encode(d, letter) and bytes(r["back"]) == d
            assert (None if r["wrong"] is None else bytes(r["wrong"])) == correction.crc_decode(d, letter)


def test_reed_solomon(spark, data):
    coded = {r["i"]: (r["d"], r["c"]) for r in data.select("i", "d", fields.rs_encoded(F.col("d")).alias("c")).collect()}
    r, rows = random.Random(2), []
    for d, c in coded.values():
        assert (c is None) == (d is None)
        if d is None:
            continue
        assert bytes(c) == correction.rs_encode(bytes(d))
        rows.append((bytes(c), bytes(d)))
        for wrong in (1, 1, 1, 2, 2, 3):
            if c:
                w = bytearray(c)
                for at in r.sample(range(len(w)), min(wrong, len(w))):
                    w[at] ^= r.randrange(1, 256)
                rows.append((bytes(w), None))
    df = spark.createDataFrame([(bytearray(w),) for w, _ in rows] + [(None,), (bytearray(b"a"),), (bytearray(b"ab"),)], "w binary")
    got = {None if r["w"] is None else bytes(r["w"]): r["back"] for r in df.select("w", fields.rs_repaired(F.col("w")).alias("back")).collect()}
    for w, back in got.items():
        want = None if w is None else correction.rs_decode(w)
        assert (None if back is None else bytes(back)) == want
    assert all(bytes(got[w]) == d for w, d in rows if d is not None)


def test_words_over_four(spark):
    assert len(set(fields.WORDS.values())) == 4
    assert all(sum(x != y for x, y in zip(a, b)) == 3 for a, b in product(fields.WORDS.values(), repeat=2) if a != b)
    words = ["".join(w) for w in product("ACGT", repeat=3)]
    near = {w: [b for b, c in fields.WORDS.items() if sum(x != y for x, y in zip(w, c)) <= 1] for w in words}
    rows = [(w, near[w][0] if near[w] else None) for w in words] + [("", ""), (None, None), ("AC", None), ("AAN", None), ("AAACCG", None)]
    rows += [("".join(fields.WORDS[b] for b in "GATTACA"), "GATTACA")]
    want = dict(rows)
    want["AAACCG"] = near["AAA"][0] + near["CCG"][0] if near["CCG"] else None
    df = spark.createDataFrame([(w,) for w, _ in rows], "w string")
    assert {r["w"]: r["b"] for r in df.select("w", fields.strand_repaired(F.col("w")).alias("b")).collect()} == want
    assert spark.createDataFrame([("GATTACA",)], "s string").select(fields.strand_encoded(F.col("s"))).first()[0] == "".join(fields.WORDS[b] for b in "GATTACA")


def test_words_and_checksums_by_the_batch(spark):
    """Findings F24 and F31: null, empty and odd strands beside whole ones, and no translation of each strand."""
    texts = [None, "", "A", "GATTACA", "GANTÉA", "ACGT" * 50, "NNN", "T" * 64]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").coalesce(1)
    out = df.select("i", fields.strand_encoded(F.col("s")).alias("e"), S.with_checksum(F.col("s")).alias("c"))
    check = lambda s: "".join("ACGT"[sum("ACGT".find(c) + 1 for c in s) % 256 // 4**j % 4] for j in (3, 2, 1, 0))
    for r in out.collect():
        s = texts[r["i"]]
        assert r["e"] == (None if s is None else "".join(fields.WORDS.get(c, c) for c in s)) and r["c"] == (None if s is None else s + check(s))
    back = out.select("i", fields.strand_repaired(F.col("e")).alias("s"), S.checksum_ok(F.col("c"), 7).alias("ok"))
    assert {r["i"]: r["s"] for r in back.collect()} == {i: s if s is None or not set(s) - set("ACGT") else None for i, s in enumerate(texts)}
    assert [r["i"] for r in back.where("ok").collect()] == [3]
    assert "transl" not in back._jdf.queryExecution().optimizedPlan().toString()


def test_alignments_as_columns(spark):
    r = random.Random(3)
    pairs = [("", ""), ("", "ACG"), ("ACG", ""), (None, "A"), ("A", None), ("é\U0001f600A", "éA")]
    for _ in range(60):
        a = "".join(r.choices("ACG", k=r.randint(0, 22)))
        b = "".join(c for c in a if r.random() < 0.8) + "".join(r.choices("ACG", k=r.randint(0, 8)))
        pairs.append((a, b))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    a, b, e = F.col("a"), F.col("b"), F.col("e")
    got = df.withColumn("e", align.script_of(a, b)).select("i", "e", align.cigar_of(e).alias("cigar"), align.gapped_by(e, a, "I").alias("x"), align.gapped_by(e, b, "D").alias("y"), align.local_score_of(a, b).alias("score"))
    for row in got.collect():
        a, b = pairs[row["i"]]
        if a is None or b is None:
            assert row["e"] is row["score"] is None
            continue
        script = align.edit_script(a, b)
        assert (row["e"], row["cigar"], row["score"]) == (script, align.to_cigar(script), align.local_score(a, b))
        assert ((row["x"], row["y"]) if script else ("", "")) == align.gapped(a, b)


def test_errors_by_position(spark):
    df = spark.createDataFrame([("2=1X1D3I1=",), ("1I2=0X2D",), ("",), (None,), ("3X",)], "cigar string")
    got = {r["position"]: tuple(r)[1:] for r in align.errors_by_position(df).collect()}
    assert got == {0: (2, 1, 0, 1), 1: (2, 1, 0, 0), 2: (0, 2, 1, 0), 3: (0, 0, 2, 0), 4: (1, 0, 0, 3)}
