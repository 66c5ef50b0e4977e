"""Near-duplicate documents by SetSketch registers: bands of registers find candidates, their joint likelihood is estimated, sets decide.

1. Each document's distinct shingles become REGISTERS registers (see setsketch) and an odd sketch.  Equal sets are one class.
2. Registers are cut into bands of WIDTH; classes that agree in all registers of a band share its bucket.  At similarity 0.85 a register is
   equal with chance 0.856, so a pair of classes misses all 51 buckets with chance 2e-14: in a billion links none is expected to be lost.
3. In the buckets of STAR_BANDS bands each class is compared with the one of smallest id only, which joins most of a group of copies by
   about one pair a member.
4. Then all bands: only in buckets that hold several components so far, and only pairs across them, each in the first band it shares.
   Buckets are cut into tiles of TILE classes, so that no task holds a large one.
5. A candidate goes where its registers speak against the limit by more than EVIDENCE (a likelihood ratio of e^30; a true link goes with
   a chance of 64 e^-30, or 6e-12, at most), or where the odd sketches of the two sets differ in more bits than similar sets can in elements (exact).
6. What is left is verified on the full sets, and links become components.

Cases: null and empty texts, and texts of white space, have an empty set, are linked with nothing, and are their own component.  Texts
with fewer words than a shingle are one shingle.  Rows with equal texts are linked.  Rows with a null doc_id are linked like any others;
a component's id is its smallest doc_id, null only if all its rows have none.  kept is true where doc_id is component_id; both null counts
as that, so that rows without an id are never lost.  Rows that repeat the smallest doc_id are all kept.  Similarity at the limit is a link.
An empty table gives no rows.  Very long texts are read whole.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import GROUP_BYTES, bounds_of, by_group, columns_of, may_be_in, mix, prepare, save, shuffle_parts, slices
from helixframe.llm.components import components
from helixframe.llm.ngram_join import _verified, set_keys, shingle_sets
from helixframe.llm.setsketch import REGISTERS, evidence_against, registers

WIDTH = 5
BANDS = REGISTERS // WIDTH
STAR_BANDS = 8
TILE = 1024
#: Pairs that are compared at once.
PAIRS = 8192
EVIDENCE = 30.0
#: Odd sketches have as many bits as a set has elements, up to the next power of two, between these.
LEAST_BITS, MOST_BITS = 256, 1 << 16


def odd_sketches(x: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The parity of how many elements of each set hash to each bit.  Folding a sketch in halves by XOR gives the next smaller one."""
    out = []
    for a, b in zip(at[:-1], at[1:]):
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(b - a - 1).bit_length() if b > a else 0))
        place = (mix(x[a:b], 51) & np.uint64(bits - 1)).astype(np.int64)
        out.append(np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes() if b > a else b"")
    return out


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """(id, row_key, n, set_key, registers, odd) of each document."""

    def scan(batches):
        for batch in batches:
            n, key, regs, odd = [], [], [], []
            for _, _, data, off in slices(batch, "text"):
                x, at = shingle_sets(data, off, k)
                n.append(np.diff(at).astype(np.int32))
                key.append(set_keys(x, at))
                regs += [r.tobytes() for r in registers(x, at)]
                odd += odd_sketches(x, at)
            if n:
                columns = [pa.array(np.concatenate(n)), pa.array(np.concatenate(key)), pa.array(regs, pa.binary()), pa.array(odd, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row_key"), *columns], ["id", "row_key", "n", "set_key", "regs", "odd"])

    return rows.mapInArrow(scan, "id long, row_key long, n int, set_key long, regs binary, odd binary")


def _matrix(column: list) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), REGISTERS)


class Sketches:
    """Odd sketches of many sets, by their size and folded to it from the next one, so that pairs of similar sizes are compared at once."""

    def __init__(self, odd: list[bytes]):
        self.size = np.array([len(o) for o in odd], np.int64)
        self.place = np.zeros((2, len(odd)), np.int64)  # in the table of one's own size, and in that of half of it
        self.tables: dict[int, np.ndarray] = {}
        for size in np.unique(self.size).tolist():
            own, twice = np.flatnonzero(self.size == size), np.flatnonzero(self.size == 2 * size)
            self.place[0, own], self.place[1, twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
            table = np.frombuffer(b"".join([odd[i] for i in own] + [odd[i] for i in twice]), np.uint64)
            mine, other = np.split(table, [len(own) * size // 8])
            folded = other.reshape(len(twice), 2, size // 8)
            self.tables[size] = np.concatenate([mine.reshape(len(own), size // 8), folded[:, 0] ^ folded[:, 1]])

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the sketches of each pair differ; 0, which refutes nothing, where their sizes are further apart than by two."""
        out = np.zeros(len(i), np.int64)
        least, most = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        for size, table in self.tables.items():
            some = np.flatnonzero((least == size) & (most <= 2 * size))
            a, b = (table[self.place[(self.size[x[some]] != size).astype(int), x[some]]] for x in (i, j))
            out[some] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
        return out


def _plausible(i: np.ndarray, j: np.ndarray, regs: np.ndarray, sketches: Sketches, n: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (i, j) of sets neither sizes, nor registers, nor odd sketches refute."""
    good = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    for a in range(0, len(i), PAIRS):
        some = a + np.flatnonzero(good[a : a + PAIRS])
        good[some] = (100 + percent) * sketches.apart(i[some], j[some]) <= (100 - percent) * (n[i[some]] + n[j[some]])
        some = some[good[some]]
        good[some] = evidence_against(regs[i[some]], regs[j[some]], n[i[some]], n[j[some]], percent / 100) <= EVIDENCE
    return good


def _postings(classes: DataFrame) -> DataFrame:
    """(h, set_key, band) of the buckets that several classes share.  Buckets are counted first, so that most bands move as a bare number."""
    keys = F.array(*[F.xxhash64(F.lit(j), F.substring("regs", WIDTH * j + 1, WIDTH)) for j in range(BANDS)])
    hashed = classes.select("set_key", F.posexplode(keys).alias("band", "h"))
    shared = save(hashed.groupBy("h").agg(F.count("*").alias("many")).where("many > 1").select("h"), "shared")
    return save(hashed.where(may_be_in(shared, "h")(F.col("h"))).join(shared, "h"), "postings")


def _of(classes: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Columns of the classes that a table of set keys names, and perhaps of a few more, without moving the others."""
    return classes.where(may_be_in(keys, "set_key")(F.col("set_key"))).select("set_key", *columns)


def _star(classes: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of set keys: each class with the first one of its bucket, in a few bands."""
    hashed = postings.where(F.col("band") < STAR_BANDS).select("set_key", "h").join(classes.select("set_key", "id"), "set_key")
    least = hashed.groupBy("h").agg(F.min_by("set_key", F.struct(F.col("id").isNull(), "id", "set_key")).alias("a"))
    pairs = save(hashed.join(least, "h").where("a != set_key").select("a", F.col("set_key").alias("b")).distinct(), "pairs")
    named = _of(classes, pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct(), "n", "regs", "odd")
    side = lambda s: named.select(F.col("set_key").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "regs", "odd")])
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def test(batches):
        for batch in batches:
            if batch.num_rows:
                x = {c: batch.column(f"{c}_a").to_pylist() + batch.column(f"{c}_b").to_pylist() for c in ("n", "regs", "odd")}
                i = np.arange(batch.num_rows)
                good = _plausible(i, i + batch.num_rows, _matrix(x["regs"]), Sketches(x["odd"]), np.array(x["n"]), percent)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "n_a", "n_b", "regs_a", "regs_b", "odd_a", "odd_b").mapInArrow(test, "a long, b long")


def _across(classes: DataFrame, postings: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of set keys of different components that share a band and that nothing refutes.  known: (set_key, comp)."""
    spark = known.sparkSession
    rows = postings.join(known, "set_key")
    crossing = rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("many")).where("lo != hi")
    crossing = save(crossing.select("h", F.ceil(F.col("many") / TILE).cast("int").alias("parts")), "crossing")

    # Class i of a bucket has a part; tile (p, q) holds parts p and q, and p == q all pairs inside it.
    mine = F.pmod(F.xxhash64("set_key", F.lit(5)), F.col("parts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("mine", q).alias("p"), F.greatest("mine", q).alias("q")))
    placed = rows.join(crossing, "h").withColumn("mine", mine).select("set_key", "comp", "band", "h", "mine", F.explode(tiles).alias("tile"))
    placed = save(placed.select("set_key", "comp", "band", "h", "mine", "tile.p", "tile.q"), "tiles")
    groups = max(shuffle_parts(spark), -(-placed.count() * 2 * REGISTERS // GROUP_BYTES))
    laid = placed.join(_of(classes, placed.select("set_key").distinct(), "n", "regs", "odd"), "set_key")
    laid = laid.withColumn("bucket", F.pmod(F.xxhash64("h", "p", "q"), F.lit(groups)).cast("int"))
    weights = np.uint64(256) ** np.arange(WIDTH, dtype=np.uint64)

    def compare(table):
        x = {c: np.asarray(table.column(c)) for c in ("set_key", "band", "h", "mine", "p", "q", "comp", "n")}
        regs, sketches, n = _matrix(table.column("regs").to_pylist()), Sketches(table.column("odd").to_pylist()), x["n"].astype(np.int64)
        bands = (regs.reshape(-1, BANDS, WIDTH) * weights).sum(2, dtype=np.uint64)
        order = np.lexsort((n, x["q"], x["p"], x["h"]))
        tile = np.stack([x["h"][order], x["p"][order], x["q"][order]], 1)
        at, ends = bounds_of(np.cumsum(np.concatenate([[0], (tile[1:] != tile[:-1]).any(1)])))
        found = []
        for lo, hi in zip(at, ends):
            r = order[lo:hi]
            comp, part, size = x["comp"][r], x["mine"][r], n[r]
            if comp.min() == comp.max():
                continue
            split, step = x["p"][r[0]] != x["q"][r[0]], max(1, PAIRS // len(r))
            last = np.searchsorted(size, size * 100 // percent, "right")
            for a in range(0, len(r), step):
                i = np.arange(a, min(a + step, len(r)))[:, None]
                j = np.arange(len(r))[None, :]
                some = (j > i) & (j < last[i]) & (comp[j] != comp[i])
                if split:
                    some &= part[j] != part[i]
                i, j = np.nonzero(some)
                i, j = r[i + a], r[j]
                first = (bands[i] == bands[j]).argmax(1) == x["band"][r[0]]  # of all bands that a pair shares the first has it
                i, j = i[first], j[first]
                good = _plausible(i, j, regs, sketches, n, percent)
                found.append(np.stack([x["set_key"][i[good]], x["set_key"][j[good]]]))
        both = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(both.min(0)), "b": pa.array(both.max(0))})

    return by_group(laid, groups).applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85) -> DataFrame:
    """Returns id_col, n_shingles, component_id and kept, one row for each input row: documents link if 100 |A and B| >= percent |A or B|.

    percent is 85 at least: the number of bands is made for it.
    """
    if not 85 <= percent <= 100:
        raise ValueError("percent must be in 85..100")
    prepare(docs.sparkSession)
    rows = columns_of(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("binary").alias("text"))
    rows = rows.select("id", F.xxhash64("id", "text").alias("row_key"), "text")
    sets = save(_sets(rows, k), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("first")
    classes = sets.where("n > 0").groupBy("set_key").agg(first, F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("odd").alias("odd"))
    classes = save(classes.select("set_key", "first.id", "first.row_key", "n", "regs", "odd"), "classes")

    postings = _postings(classes)
    comp = components(_verified(save(_star(classes, postings, percent), "candidates"), classes, rows, k, percent))
    known = save(classes.select("set_key", "id").join(comp, F.col("set_key") == F.col("node"), "left").select("set_key", "id", F.coalesce("root", "set_key").alias("comp")), "known")
    links = known.select(F.col("set_key").alias("a"), F.col("comp").alias("b")).where("a != b")
    across = save(_across(classes, postings, known.select("set_key", "comp"), percent), "candidates")
    comp = components(links.unionByName(_verified(across, classes, rows, k, percent)))

    final = known.join(comp, known["set_key"] == comp["node"], "left").select("set_key", "id", F.coalesce("root", "set_key").alias("root"))
    final = final.join(final.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("set_key", "component_id")
    out = sets.select("id", "n", "set_key").join(final, "set_key", "left").select("id", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
