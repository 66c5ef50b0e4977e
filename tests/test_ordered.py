"""Global numbers, sorted merges and files cut after so many records."""

import random

from pyspark.sql import functions as F

from helixframe.sources import ordered


def test_numbers_are_those_of_one_sort(spark):
    r = random.Random(1)
    rows = [(r.randrange(50), r.random(), f"s{i}") for i in range(3000)] + [(None, 0.5, "n")]
    df = spark.createDataFrame(rows, "a int, `x.y` double, s string").withColumnRenamed("x.y", "x").repartition(7)
    got = ordered.numbered(df, F.col("a").asc_nulls_last(), "x").orderBy("number").collect()
    assert [x["number"] for x in got] == list(range(3001))
    assert [x["s"] for x in got] == [s for *_, s in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))]
    assert ordered.numbered(df.limit(0), "a").count() == 0


def test_merge_and_cut(spark, tmp_path):
    r = random.Random(2)
    records = [(r.choice(["5", "10", "100"]), str(r.randrange(1000)), "".join(r.choices("ACGT", k=8))) for _ in range(90)]
    for i in range(3):
        spark.createDataFrame([(f">{e}_{s}\n{q}",) for e, s, q in records[i::3]], "value string").coalesce(1).write.text(str(tmp_path / f"in{i}"))
    paths = [str(tmp_path / f"in{i}") for i in range(3)]
    want = sorted(records)  # errors as text: 10, 100, 5
    got = ordered.merged_fasta(spark, paths).orderBy("number").collect()
    assert [(x["error"], x["seed"], x["seq"]) for x in got] == want
    assert [(x["number"], x["seq"]) for x in ordered.merged_fasta(spark, paths, 7).orderBy("number").collect()] == [(i, want[i][2]) for i in range(7)]
    for _ in range(2):
        ordered.write_in_order(ordered.merged_fasta(spark, paths), str(tmp_path / "out"), records=40)
    for part, a in ((0, 0), (1, 40), (2, 80)):
        lines = [x for f in sorted((tmp_path / "out" / f"part={part}").glob("part-*")) for x in f.read_text().split()]
        assert lines == [y for e, s, q in want[a : a + 40] for y in (f">{e}_{s}", q)]
