"""Files through the Raptor code in built-in expressions, packets in long sequences, repeated k-mers: against plain Python."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import strand as S
from helixframe.operators import file_codes, kmers, windows
from helixframe.operators.codes import Raptor, back_substitute, insert
from helixframe.operators.packet_table import SEED_MASK, drawn

FILES = {1: ("a.txt", b"short"), 2: ("empty", b""), 3: ("no data", None), 4: ("é.bin", random.Random(1).randbytes(48 * 70 + 7)), 5: ("zeros", bytes(96)), 6: (None, b"x" * 48)}


@pytest.fixture(scope="module")
def sent(spark, tmp_path_factory):
    files = spark.createDataFrame([(i, n, None if d is None else bytearray(d), "extra") for i, (n, d) in FILES.items()], "file_id long, name string, data binary, seed string")
    path = str(tmp_path_factory.mktemp("sent"))
    file_codes.packets(files).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sizes(sent):
    return sent.select("file_id", "block", "k").distinct()


def test_files_come_back(sent):
    lost = sent.where("seed % 10 != 3").select("file_id", "block", "k", "strand")
    spoiled = lost.limit(20).select("file_id", "block", "k", F.concat(F.lit("ACGTACGT"), F.expr("substr(strand, 9)")).alias("strand"))  # another seed: the checksum tells
    got = {r["file_id"]: r for r in file_codes.decoded_files(lost.unionByName(lost).unionByName(spoiled), sizes(sent)).collect()}
    assert got.keys() == FILES.keys()
    for i, (name, data) in FILES.items():
        assert (got[i]["name"], bytes(got[i]["data"]), got[i]["crc_ok"], got[i]["n_missing"]) == (name or "", data or b"", True, 0)


def test_few_packets_solve_what_they_can(sent):
    """As many chunks as elimination by hand fixes; zeros for the others, and all zeros for a block without packets."""
    some = sent.where("file_id = 4 AND block = 0").orderBy("seed").limit(40)
    got = {(r["file_id"], r["block"]): r for r in file_codes.decoded_blocks(file_codes.read_strands(some.select("file_id", "block", "k", "strand")), sizes(sent)).collect()}
    assert got[5, 0]["n_missing"] == got[5, 0]["k"] == 3 and set(got[5, 0]["digits"]) == {"0"}
    code, pivots = Raptor(64), {}
    for r in some.collect():
        x, draws = r["seed"] + 1, []
        for _ in range(5):
            x = x * 48271 % 2147483647
            draws.append(x)
        degree = [1, 2, 3, 4, 10, 11, 40][sum(f <= draws[2] % 2**20 for f in (10241, 491582, 712794, 831695, 948446, 1032189))]
        walk = [(draws[4] % code.prime + j * (1 + draws[3] % (code.prime - 1))) % code.prime for j in range(code.prime)]
        mask = 0
        for i in [i for i in walk if i < code.size][:degree]:
            mask ^= code.masks[i]
        assert mask.bit_count() == r["degree"]
        while mask and mask & -mask in pivots:
            mask ^= pivots[mask & -mask]
        if mask:
            pivots[mask & -mask] = mask
    for low in sorted(pivots, reverse=True):
        for other in pivots:
            if other != low and pivots[other] & low:
                pivots[other] ^= pivots[low]
    whole = (len(FILES[4][1]) % 48).to_bytes(4, "little") + zlib.crc32(FILES[4][1]).to_bytes(4, "little") + "é.bin".encode()
    data = whole.ljust(48, b"\0") + FILES[4][1]
    chunks = [bytes.fromhex(got[4, 0]["digits"])[48 * i : 48 * i + 48] for i in range(64)]
    fixed = {m.bit_length() - 1 for low, m in pivots.items() if m == low}
    assert got[4, 0]["n_missing"] == 64 - len(fixed) > 0
    assert all(chunks[i] == (data[48 * i : 48 * i + 48] if i in fixed else bytes(48)) for i in range(64))


def test_packets_keep_the_rules_best(sent):
    every = sent.groupBy("file_id", "block", "k").agg(F.count("*").alias("n"), F.max("error_prob").alias("worst")).collect()
    assert all(r["n"] == -(-16 * r["k"] // 10) + 16 for r in every if r["k"] > 2)
    assert sent.where(F.length("strand") != 204).isEmpty() and not sent.where("error_prob < 1").isEmpty()


def test_packets_are_chosen_where_they_are_made(spark):
    """The default rules move nothing and choose as any other rules do."""
    from helixframe.functions import rules as R

    files = spark.createDataFrame([(i, n, None if d is None else bytearray(d)) for i, (n, d) in FILES.items()], "file_id long, name string, data binary")
    found = file_codes.packets(files)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    other = file_codes.packets(files, rules=lambda s: R.default_rules(s))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, other.select(found.columns).collect()), key=str)


def test_names_without_room_fail(spark):
    with pytest.raises(Exception, match="no room for the name"):
        file_codes.packets(spark.createDataFrame([(1, "n" * 41, bytearray(b"x"))], "file_id long, name string, data binary")).collect()


def test_no_files(spark):
    none = file_codes.packets(spark.createDataFrame([], "file_id long, name string, data binary"))
    assert file_codes.decoded_files(none.select("file_id", "block", "k", "strand"), none.select("file_id", "block", "k")).count() == 0


def test_drawn_numbers(spark):
    x, want = 8, []
    for _ in range(5):
        x = x * 48271 % 2147483647
        want.append(x)
    assert list(spark.range(1).select(*[drawn(F.lit(7), i) for i in range(1, 6)]).first()) == want


def checksum(s):
    n = sum("ACGT".index(c) + 1 for c in s) % 256
    return "".join("ACGT"[n >> i & 3] for i in (6, 4, 2, 0))


def test_found_packets(spark):
    r = random.Random(2)
    say = lambda n: "".join(r.choices("ACGT", k=n))
    length, rows = 40, []
    for i in range(12):
        seq = ""
        for _ in range(r.randrange(6)):
            body = say(36)
            seq += say(r.randrange(30)) + body + (checksum(body) if r.random() < 0.8 else say(4))
        rows.append((i, seq + ("N" if i % 3 else "") + say(50)))
    rows += [(100, None), (101, ""), (102, "ACGT"), (103, "é" + say(60)), (104, say(30000))]
    want = []
    for i, seq in rows:
        end = 0
        for at in range(len(seq or "") - length + 1):
            w = seq[at : at + length]
            if at < end or set(w) - set("ACGT") or w[-4:] != checksum(w[:-4]) or any(b * 5 in w for b in "ACGT") or not 30 <= 100 * sum(c in "GC" for c in w) / length <= 70:
                continue
            end = at + length
            want.append((i, at, w, sum("ACGT".index(c) << 2 * (7 - j) for j, c in enumerate(w[:8])) ^ SEED_MASK))
    got = windows.found_packets(spark.createDataFrame(rows, "id long, seq string"), length)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 60


@pytest.mark.parametrize("k", [3, 19, 31])
def test_shared_mers(spark, k):
    r = random.Random(3)
    base = "".join(r.choices("ACGT", k=120))
    rows = [(i, i % 2, "".join(r.choices("ACGT", k=r.randrange(60))) + base[i * 5 : i * 5 + 40]) for i in range(20)]
    rows += [(50, 0, None), (51, 0, ""), (52, 1, "AC"), (53, 1, base[:40] + "N" + base[:40]), (54, 1, "N" + base[:40]), (55, 0, base[:19]), (55, 0, base[:19]), (56, 0, "é" + base[:35]), (57, 0, base[5:10] + "é" + base[:35])]
    mers = lambda s: [s[i : i + k] for i in range(len(s or "") - k + 1)]
    n = collections.Counter(m for *_, s in rows for m in mers(s))
    want = collections.Counter()
    for a, b, s in rows:
        want[a, b] += sum(n[m] > 1 for m in mers(s))
    got = kmers.shared_mers(spark.createDataFrame(rows, "a long, `b.c` int, seq string").withColumnRenamed("b.c", "b"), ["a", "b"], "seq", k)
    assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == {x: c for x, c in want.items() if c}


def test_strand_of_a_long_file_is_whole(sent):
    assert sent.where(~S.checksum_ok(F.col("strand"), 200)).isEmpty()


def test_shared_mers_sends_a_mer_twice_at_most(spark):
    kept, r = np.full(1 << kmers.KEPT, -1, np.int64), random.Random(4)
    sent, places = collections.Counter(), {}
    for k, bits in ((19, 38), (31, 62)):
        some = [r.getrandbits(bits) for _ in range(50)]
        for turn in range(6):
            value = np.array(r.choices(some, k=200) + [turn], np.int64)
            got, place, weight = kmers._sent(value, k, kept)
            assert value[place].tolist() == got.tolist() and len(set(got.tolist())) == len(got)
            sent.update(got.tolist())
            places.update({v: w for v, w in zip(got.tolist(), weight.tolist())})
    assert max(sent.values()) == 2 and all(places[v] == 2 or sent[v] == 1 for v in sent)
    rows = spark.createDataFrame([(1, "ACGT" * 10)], "a long, seq string")
    plan = kmers.shared_mers(rows, ["a"], "seq")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # no row for each place of a mer is moved


def test_rank_curve(spark):
    """Rank and solved chunks behind each packet, against elimination by hand; blocks alike are worked out once."""
    from helixframe.operators import files, packets

    texts = [(1, "a text of some length, cut into blocks " * 60), (2, "short"), (3, None), (4, ""), (5, "b text of some length, cut into blocks " * 60)]
    table = spark.createDataFrame(texts, "id long, text string")
    sent = packets.encode(table, "id", "text", 47, 16, 0.3, "raptor", "none")
    blocks = packets.block_seeds(table, "id", "text", 47, 16, 0.3)
    seeds = {(r["file_id"], r["block"], r["k"]): r["seeds"] for r in blocks.collect()}
    found = collections.defaultdict(list)
    for r in sent.select("file_id", "block", "k", "seed").collect():
        found[r["file_id"], r["block"], r["k"]].append(r["seed"])
    assert seeds == {key: sorted(s) for key, s in found.items()} and {f for f, *_ in seeds} == {1, 2, 5}
    want = set()
    for (i, b, k), some in seeds.items():
        code, span, held = Raptor(k), {0}, []
        for n, seed in enumerate(some, 1):
            mask = code.sources(seed)
            reduced = mask
            for row in held:  # rows in echelon form, highest bit first
                reduced = min(reduced, reduced ^ row)
            held = sorted([*held, reduced] if reduced else held, reverse=True)
            fixed = 0
            for j in range(k):
                unit = 1 << j
                for row in held:
                    unit = min(unit, unit ^ row)
                fixed += unit == 0
            want.add((i, b, k, n, len(held), fixed))
    got = files.rank_curves(blocks)
    assert set(map(tuple, got.collect())) == want and max(x[-1] for x in want) == 16
    assert set(map(tuple, files.rank_curve(sent).collect())) == {(i, b, n, r, s) for i, b, k, n, r, s in want}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "FlatMapGroups" not in plan
    files._curve.cache_clear()
    for _ in range(2):
        files._curve("raptor", 16, np.arange(28, dtype=np.int64).tobytes(), ())
    assert files._curve.cache_info().misses == 1


def test_sequences_are_made_where_rows_are(spark):
    """Strands with checksums and spacers between them against plain Python; rows are moved only if ids repeat, and then as bytes."""
    rows = [(i, "é short text %d " % i * (i % 40)) for i in range(-40, 90)] + [(None, "no id"), (200, None), (201, "x" * 47), (202, "y" * 48)]
    again = rows + [(5, "other bytes " * 20), (5, "other bytes " * 20), (202, "z"), (77, ""), (78, None)]
    for some in (rows, again):
        want = {}
        for i, text in some:
            data = (text or "").encode()
            for at in range(-(-len(data) // 47)) if i is not None else ():
                strand = "".join("ACGT"[b >> j & 3] for b in data[at * 47 : at * 47 + 47] for j in (6, 4, 2, 0))
                turn = at * 7 + i
                gap = turn % 15 if turn >= 0 else 0  # none of a negative remainder
                want.setdefault(i, []).append((at, "ACGTTGCATGACCATG"[:gap] + strand + checksum(strand)))
        got = windows.spaced_packets(spark.createDataFrame(some, "id long, text string"), "id", "text", 47, "ACGTTGCATGACCATG", 7, 15)
        assert {r["id"]: r["seq"] for r in got.collect()} == {i: "".join(s for _, s in sorted(c)) for i, c in want.items()}
        assert ("Aggregate" in got._jdf.queryExecution().optimizedPlan().toString()) == (some is again)


def test_files_move_once(spark, sent):
    """What blocks take of their packets, wherever these are, is what elimination of all of them one by one takes; it moves in one exchange."""
    plain = spark.createDataFrame([(i, n, None if d is None else bytearray(d)) for i, (n, d) in FILES.items()], "file_id long, name string, data binary")
    assert sorted(map(tuple, file_codes.block_sizes(plain).collect())) == sorted(map(tuple, sizes(sent).collect()))
    some, r = sent.select("file_id", "block", "k", "seed", "strand"), random.Random(12)
    lies = []
    for row in some.where("file_id = 4").orderBy("block", "seed").collect():
        if r.random() < 0.1:  # a payload that contradicts the others, under a seed of its own and with a right checksum
            body = row["strand"][8:-4]
            head = "".join("ACGT"[(row["seed"] + 900 ^ SEED_MASK) >> 2 * (7 - i) & 3] for i in range(8))
            strand = head + body[::-1]
            lies.append((4, row["block"], row["k"], row["seed"] + 900, strand + checksum(strand)))
    few = some.where("file_id != 4 OR block != 1 OR seed % 4 = 0").where("file_id != 4 OR block != 0 OR seed % 2 = 0").where("file_id != 5").unionByName(spark.createDataFrame(lies, some.schema))
    want = {}
    for row in file_codes.decoded_blocks(file_codes.read_strands(few.drop("seed")), sizes(sent)).orderBy("file_id", "block").collect():
        digits, lost = want.get(row["file_id"], ("", 0))
        want[row["file_id"]] = (digits + row["digits"], lost + row["n_missing"])
    want = {i: (*file_codes._file_of(bytes.fromhex(d), 48), n) for i, (d, n) in want.items()}
    assert want[4][3] > 0 and want[5][3] == 3 and want[1] == ("a.txt", b"short", True, 0)
    for rows in (few, few.repartition(5, F.rand(1)), few.unionByName(few).repartition(3, F.rand(2)), few.orderBy(F.desc("seed"))):
        got = file_codes.decoded_files(rows.drop("seed"), sizes(sent))
        assert {x["file_id"]: (x["name"], bytes(x["data"]), x["crc_ok"], x["n_missing"]) for x in got.collect()} == want
    plan = file_codes.decoded_files(few.drop("seed"), file_codes.block_sizes(plain))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_independent_packets_and_what_they_solve():
    r, cases = random.Random(13), []
    for k in [1, 2, 3, 17, 63, 64] * 30:
        masks = [r.getrandbits(k) for _ in range(r.choice([0, 1, k // 2, k, k + 20]))]
        cases.append((k, [m for m in masks if m]))
    counts = np.array([len(m) for _, m in cases])
    first = np.cumsum(counts) - counts
    flat = np.array([m for _, some in cases for m in some], np.uint64)
    data = np.frombuffer(r.randbytes(12 * len(flat)), np.uint8).reshape(-1, 12)
    added = file_codes.independent(flat, first, counts)
    left = np.array([added[a : a + n].sum() for a, n in zip(first, counts)])
    out, fixed = file_codes.solved(np.array([k for k, _ in cases]), flat[added], data[added], np.cumsum(left) - left, left)
    for (k, masks), a, whole, n in zip(cases, first, out, fixed):
        pivots = {}
        grew = [insert(pivots, m, int.from_bytes(data[a + i].tobytes(), "big")) for i, m in enumerate(masks)]
        assert added[a : a + len(masks)].tolist() == grew
        got = back_substitute(pivots)
        assert n == len(got) and whole == b"".join(got.get(i, 0).to_bytes(12, "big") for i in range(k))


def test_blocks_are_solved_whatever_tenth_is_lost(spark):
    """Where the best packets aren't enough, the next best that are needed are kept as well, and no others."""
    r = random.Random(14)
    files = {i: r.randbytes(48 * (i % 20) + 5) for i in range(60)}
    plain = spark.createDataFrame([(i, "f", bytearray(d)) for i, d in files.items()], "file_id long, name string, data binary")
    best, safe, every = (collections.defaultdict(list) for _ in range(3))
    for out, options in ((best, {"tries": 4}), (safe, {"tries": 4, "lost": 10}), (every, {"overhead": 6.0, "tries": 1})):
        for x in file_codes.packets(plain, **({"overhead": 0.3, "more": 2} | options)).collect():
            out[x["file_id"], x["block"], x["k"]].append((x["error_prob"], x["seed"]))
    rank = lambda k, some, j: sum(insert(p, file_codes.used_mask(k, s), 0) for p in [{}] for _, s in some if s % 10 != j)
    failed = 0
    for key, some in safe.items():
        k, short = key[2], [j for j in range(10) if rank(key[2], best[key], j) < key[2]]
        failed += bool(short)
        assert set(best[key]) <= set(some) and (short or len(some) == len(best[key])) and all(rank(k, some, j) == k for j in range(10) if rank(k, every[key], j) == k)
    assert failed > 5 and len(safe) == len(best)
    sent = file_codes.packets(plain, overhead=0.3, more=2, tries=4, lost=10)
    for j in (3, 8):
        back = file_codes.decoded_files(sent.where(f"seed % 10 != {j}").select("file_id", "block", "k", "strand"), file_codes.block_sizes(plain))
        assert {x["file_id"]: bytes(x["data"]) for x in back.where("crc_ok AND n_missing = 0").collect()} == files
