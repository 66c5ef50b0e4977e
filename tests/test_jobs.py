"""The two jobs over growing and odd input: new files only, the same result when repeated, and packets against a plain XOR."""

import hashlib
import json
import math
import os
import pathlib
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import rules as R
from helixframe.functions import strand as S
from helixframe.operators import packet_table as P
from helixframe.operators.screening import unmasked_digits
from jobs import archive_strands, packet_search
from jobs.common import exact_glob, settings

ROOT = pathlib.Path(__file__).resolve().parents[1]
SCHEMA = "doc_id long, text string, load int, pool string, `odd.name` int"
TURN = {a: b for a, b in zip("ACGT", range(4))}


def rows(*pairs):
    return [(i, t, 7, "p", 1) for i, t in pairs]


def add(spark, path, *pairs):
    spark.createDataFrame(rows(*pairs), SCHEMA).coalesce(1).write.mode("append").parquet(path)


def texts_of(strands):
    """{(load, doc_id): text} that the archived strands hold, with their checksums tested."""
    plain = strands.select("load", "doc_id", "chunk_idx", S.checksum_ok(F.col("strand"), F.length("strand") - 4).alias("ok"), unmasked_digits(F.expr("left(strand, length(strand) - 4)")).alias("x")).collect()
    assert all(r["ok"] for r in plain)
    out = {}
    for r in sorted(plain, key=lambda r: r["chunk_idx"]):
        out.setdefault((r["load"], r["doc_id"]), []).append(r["x"])
    return {k: bytes.fromhex("".join(v)).decode() for k, v in out.items()}


def content(df):
    return sorted(map(repr, df.collect()))


def test_archive_takes_only_what_is_new(spark, tmp_path):
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    long = "The quick brown fox jumps over the lazy dog. " * 40
    add(spark, docs, (1, "first"), (2, long), (3, None), (4, ""), (None, "no id"), (5, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa é\n\t"))
    said = archive_strands.archive(spark, docs, out, mark)
    assert (said["loads"], said["documents_read"], said["documents_archived"]) == (1, 6, 6)
    assert texts_of(archive_strands.strands(spark, out)) == {(0, 1): "first", (0, 2): long, (0, None): "no id", (0, 5): "a" * 40 + " é\n\t"}
    before = content(archive_strands.strands(spark, out)), content(archive_strands.files(spark, out))

    assert archive_strands.archive(spark, docs, out, mark)["loads"] == 0  # nothing came
    assert (content(archive_strands.strands(spark, out)), content(archive_strands.files(spark, out))) == before

    add(spark, docs, (6, "sixth"), (1, "first"), (2, "changed"), (None, "no id"), (4, None), (7, "x"), (7, "x"))
    said = archive_strands.archive(spark, docs, out, mark)
    assert (said["loads"], said["documents_read"], said["documents_archived"]) == (1, 7, 4)  # 1, the one without id and 4, still empty, are known
    got = texts_of(archive_strands.strands(spark, out).where("load = 1 AND doc_id != 7"))
    assert got == {(1, 6): "sixth", (1, 2): "changed"}
    assert archive_strands.strands(spark, out).where("load = 1 AND doc_id = 7").count() == 2
    files = {(r["load"], r["doc_id"], r["n_bytes"], r["n_chunks"]): r["digest"] for r in archive_strands.files(spark, out).collect()}
    assert files[(1, 2, 7, 1)] == hashlib.md5(b"changed").hexdigest() and (0, 3, 0, 0) in files and len(files) == 9

    # A load whose end wasn't noted is repeated and replaces what it had written.
    before = content(archive_strands.strands(spark, out)), content(archive_strands.files(spark, out))
    os.remove(f"{mark}/commits/1")
    if os.path.exists(f"{mark}/commits/.1.crc"):
        os.remove(f"{mark}/commits/.1.crc")
    assert archive_strands.archive(spark, docs, out, mark)["loads"] == 1
    assert (content(archive_strands.strands(spark, out)), content(archive_strands.files(spark, out))) == before


def test_archive_chooses_the_best_mask(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    add(spark, docs, (1, "\x00" * 47), (2, "U" * 47), (3, "plain text of a document, long enough for one chunk"))
    archive_strands.archive(spark, docs, out, str(tmp_path / "mark"))
    got = {(r["doc_id"], r["chunk_idx"]): r for r in archive_strands.strands(spark, out).collect()}
    assert got[1, 0]["mask"] == 1 and got[1, 0]["strand"][:10] == "ACACACACAC"  # zeros under the first mask that breaks runs and keeps half GC
    assert all(r["strand"][:2] == S.pair(r["mask"]) for r in got.values())
    assert os.path.isdir(f"{out}/strands/load=0/pool=1")


def test_archive_of_nothing(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    add(spark, docs)
    archive_strands.archive(spark, docs, out, str(tmp_path / "mark"))
    assert archive_strands.strands(spark, out).count() == 0 and archive_strands.files(spark, out).count() == 0


def used_plainly(seed, k, most):
    draws, x = [], seed + 1
    for _ in range(5):
        x = x * P.FACTOR % P.MODULUS
        draws.append(x)
    degree = 1 + sum(limit <= draws[2] % P.SCALE for limit in P.degree_limits(most))
    prime = P.primes_from(most)[k]
    walk = [(draws[4] % prime + j * (1 + draws[3] % (prime - 1))) % prime for j in range(prime)]
    return [i for i in walk if i < k][: min(degree, k)]


def test_packet_search(spark, tmp_path):
    files, out = str(tmp_path / "files"), str(tmp_path / "out")
    texts = {1: "one", 2: "Lorem ipsum dolor sit amet, consectetur. " * 30, 3: None, 4: "", None: "without an id, but coded", 5: "é" * 700}
    add(spark, files, *texts.items())
    config = {"block_chunks": 16, "tries_per_chunk": 3.0, "overhead": 0.5, "pools": 3}
    said = packet_search.search(spark, files, out, config)
    first = packet_search.packets(spark, out).collect()
    assert said == {"files_read": 6, "blocks": 6, "packets_written": len(first), "packets_over_one": sum(r["error_prob"] >= 1 for r in first)}
    packet_search.search(spark, files, out, config)
    again = packet_search.packets(spark, out).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))

    blocks = {}
    for r in first:
        data = texts[r["file_id"]].encode()[r["block"] * 768 :][:768]
        k = math.ceil(len(data) / 48)
        chunks = [int.from_bytes(data[i * 48 : i * 48 + 48].ljust(48, b"\0")) for i in range(k)]
        used = used_plainly(r["seed"], k, 16)
        assert (r["k"], r["n_bytes"], r["degree"]) == (k, len(data), len(used)) and len(set(used)) == len(used)
        value = 0
        for i in used:
            value ^= chunks[i]
        bases = r["strand"][8:-4]
        assert sum(TURN[b] << 2 * i for i, b in enumerate(reversed(bases))) == value
        assert sum(TURN[b] << 2 * i for i, b in enumerate(reversed(r["strand"][:8]))) == r["seed"] ^ P.SEED_MASK
        blocks.setdefault((r["file_id"], r["block"]), []).append(r)
    assert all(len(b) == math.ceil(b[0]["k"] * 1.5) for b in blocks.values()) and {f for f, _ in blocks} == {1, 2, 5, None}
    tried = P.packets(spark.read.parquet(files), "doc_id", "text", 48, 16, 3.0)
    every = P.fewest_errors(tried, 100.0).collect()
    for key, kept in blocks.items():
        best = sorted((r["error_prob"], r["seed"]) for r in every if (r["file_id"], r["block"]) == key)[: len(kept)]
        assert sorted((r["error_prob"], r["seed"]) for r in kept) == best

    records = [line for line in spark.read.text(f"{out}/fasta").select("value").toPandas()["value"]]
    assert len(records) == 2 * len(first) and sorted(x for x in records if not x.startswith(">")) == sorted(r["strand"] for r in first)


def test_packet_search_of_nothing(spark, tmp_path):
    files, out = str(tmp_path / "files"), str(tmp_path / "out")
    add(spark, files, (1, None))
    assert packet_search.search(spark, files, out)["packets_written"] == 0
    assert packet_search.packets(spark, out).count() == 0


def test_settings_and_patterns(tmp_path):
    for name, module in (("archive_strands", archive_strands), ("packet_search", packet_search)):
        assert settings(str(ROOT / f"jobs/{name}.json"), module.DEFAULTS) == module.DEFAULTS
    (tmp_path / "c.json").write_text(json.dumps({"chunk": 3}))
    with pytest.raises(ValueError, match="unknown settings: chunk"):
        settings(str(tmp_path / "c.json"), archive_strands.DEFAULTS)
    assert exact_glob("s3a://b/docs.parquet/") == "s3a://b/docs.parque[t]" and exact_glob("/a/*.parquet") == "/a/*.parquet"


def test_command_lines(spark, tmp_path):
    docs = str(tmp_path / "docs")
    add(spark, docs, (1, "first"), (2, "second " * 30))
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_CONF_DIR": str(tmp_path)}
    for name, args in (("archive_strands", ["--documents", docs, "--checkpoint", str(tmp_path / "mark")]), ("packet_search", ["--files", docs])):
        out = str(tmp_path / name)
        said = subprocess.run([sys.executable, "-m", f"jobs.{name}", "--config", str(ROOT / f"jobs/{name}.json"), "--output", out, *args], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
        assert said.returncode == 0 and "helixframe.jobs" in said.stderr, said.stderr[-2000:]
    assert archive_strands.strands(spark, str(tmp_path / "archive_strands")).count() == 1 + math.ceil(210 / 47)
    assert packet_search.packets(spark, str(tmp_path / "packet_search")).count() > 2


def test_packets_are_chosen_where_they_are_made(spark):
    """No packet is moved to be chosen unless ids repeat, and then those of all rows are compared, as by fewest_errors()."""
    texts = [(1, "Lorem ipsum dolor sit amet, consectetur. " * 30), (2, "é" * 700), (3, None), (4, ""), (None, "none"), (None, "other"), (1, "a shorter text of the same id " * 9), (1, "x" * 900)]
    for rows in (texts[:5], texts):
        table = spark.createDataFrame(rows, "id long, text string")
        best = P.best_packed(table, "id", "text", 48, 16, 3.0, 0.5)
        assert ("Window" in best._jdf.queryExecution().optimizedPlan().toString()) == (len(rows) > 5)
        want = P.fewest_errors(P.packets(table, "id", "text", 48, 16, 3.0), 0.5)
        got = best.withColumn("strand", S.to_strand(F.col("packed"))).select(want.columns)
        key = ["file_id", "block", "error_prob", "seed", "k"]
        assert sorted(map(repr, got.select(key).collect())) == sorted(map(repr, want.select(key).collect()))
        assert got.exceptAll(P.packets(table, "id", "text", 48, 16, 3.0).withColumn("error_prob", F.round(R.default_rules(F.col("strand")), 6)).select(want.columns)).isEmpty()


def test_errors_of_a_table_of_strands():
    rows, some = [], random.Random(3)
    for n in (4, 5, 51, 204):
        rows = ["".join(some.choices("ACGT" if i % 3 else "AT", k=n)) for i in range(90)]
        rows += [rows[0][: n - 7] + m[:7] for m, _ in R.MOTIFS if n > 40] + [m[7:] + rows[0][len(m) - 7 :] for m, _ in R.MOTIFS if n > 40] + [m + rows[0][len(m) :] for m, _ in R.MOTIFS if n > 40]
        assert R.default_errors_of(np.array([list(x.encode()) for x in rows], np.uint8)).tolist() == R.default_errors(rows).tolist()
