"""Complete joins of strands by edit distance and by similarity: no pair within the limit is lost.

Two ways, both exact:

- `edit_join` for tight limits.  A strand within distance d of another keeps one of its d + 1 segments whole, at a place that is shifted by d
  at most.  Segments are joined with equal substrings, and what meets is verified.  A segment that many strands have is dealt to parts.
- `theta_join` for loose limits, where segments would be too short to tell strands apart.  Strands meet in tiles of two parts each, and all
  pairs of a tile are worked out at once on 64 places of a strand a word (Myers; Hyyroe for common subsequences).  Where one side is small
  by measure, it goes to all tasks instead and the other one doesn't move.  Rows leave a tile for what is found only, not for each pair.

Strings are compared by code points.  Nulls are left out by both.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.strand import _held

#: Strands of a part; a tile holds two parts.
PART = 1024
#: Characters of the smaller side up to which it goes to all tasks.
SMALL = 8 << 20
#: Pairs that are worked out at once.
PAIRS = 1 << 15
#: Segments shorter than this tell strands apart too badly.
LEAST_SEGMENT = 7
#: Index rows of one segment that a task joins.
HOT = 512

_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


class Strings:
    """Many strings as letters 1, 2, ... of an alphabet, 0 behind their ends."""

    def __init__(self, strings: list[str], alphabet: np.ndarray | None = None):
        self.n = np.array([len(s) for s in strings], np.int64)
        width = max(1, int(self.n.max(initial=0)))
        codes = np.zeros((len(strings), width), np.uint32)
        flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[np.arange(width)[None, :] < self.n[:, None]] = flat + 1
        self.alphabet = np.unique(codes) if alphabet is None else alphabet
        self.letters = np.searchsorted(self.alphabet, codes)

    def masks(self, letters: int) -> np.ndarray:
        """(letter, word, string): the places of each letter, 64 a word; none for what isn't a letter."""
        words = -(-self.letters.shape[1] // 64)
        out = np.zeros((letters, words, len(self.n)), np.uint64)
        for at in range(self.letters.shape[1]):
            np.bitwise_or.at(out, (self.letters[:, at], at // 64, np.arange(len(self.n))), _ONE << np.uint64(at % 64))
        out[0] = 0
        return out


def both(a: list[str], b: list[str]) -> tuple[Strings, Strings, int]:
    """Two lists over one alphabet, and its size."""
    letters = np.unique(np.frombuffer("".join(set("".join(a)) | set("".join(b))).encode("utf-32-le", "surrogatepass"), np.uint32) + 1)
    alphabet = np.concatenate([[0], letters]).astype(np.uint32)
    return Strings(a, alphabet), Strings(b, alphabet), len(alphabet)


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of all pairs, (len(a), len(b))."""
    x, y, letters = both(a, b)
    masks, words = x.masks(letters), -(-x.letters.shape[1] // 64)
    last, bit = np.maximum(x.n - 1, 0) // 64, (np.maximum(x.n - 1, 0) % 64).astype(np.uint64)
    shape = (len(a), len(b))
    up, down = [np.full(shape, _ALL) for _ in range(words)], [np.zeros(shape, np.uint64) for _ in range(words)]
    score = np.broadcast_to(x.n[:, None], shape).copy()
    for at in range(y.letters.shape[1]):
        more, less = np.ones(shape, np.uint64), np.zeros(shape, np.uint64)  # what comes in from above: 1 at the top
        alive = at < y.n
        for w in range(words):
            eq = masks[y.letters[:, at], w].T
            pv, mv = up[w], down[w]
            xv, eq = eq | mv, eq | less
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            ends = np.flatnonzero(last == w)
            if len(ends):
                k = bit[ends][:, None]
                score[ends] += np.where(alive, ((ph[ends] >> k) & _ONE).astype(np.int64) - ((mh[ends] >> k) & _ONE).astype(np.int64), 0)
            more, less, ph, mh = ph >> np.uint64(63), mh >> np.uint64(63), (ph << _ONE) | more, (mh << _ONE) | less
            up[w], down[w] = mh | ~(xv | ph), ph & xv
    empty = np.flatnonzero(x.n == 0)
    score[empty] = y.n
    return score


#: Pairs of strands that are worked out side by side.
SIDE = 1 << 12
#: Places after which pairs that are over the limit are laid aside.
LOOK = 16


def pair_distances(a: pa.Array, b: pa.Array, limit: int) -> np.ndarray:
    """levenshtein(a, b, limit) of a batch, row by row: -1 where the distance is over the limit, 62 at most, or a string is null.

    A way of `limit` edits at most stays on limit + 1 diagonals, so a column's part of it is the bits of one number (Hyyroe's band), which goes
    down a row with each letter of a.  The distance along the diagonal of the ends never falls, so a pair is done when it is over the limit.
    """
    if not 0 <= limit <= 62:
        raise ValueError("the limit is from 0 to 62")
    out = np.full(len(a), -1, np.int64)
    (x, n), (y, m) = _points(a), _points(b)
    for_all = np.flatnonzero((n >= 0) & (m >= 0) & (np.abs(m - n) <= limit))
    seen = np.zeros(1 + max(int(x.max(initial=0)), int(y.max(initial=0))), bool)  # by code point: a sort would cost more than all the rest
    seen[x], seen[y] = True, True
    number, planes = (np.cumsum(seen) - 1).astype(np.uint32), max(1, int(seen.sum() - 1).bit_length())
    codes_a, codes_b = number[x], number[y]
    starts_a, starts_b = (np.cumsum(np.maximum(k, 0)) - np.maximum(k, 0) for k in (n, m))
    for_all = for_all[np.argsort(-n[for_all], kind="stable")]
    for i in range(0, len(for_all), SIDE):
        rows = for_all[i : i + SIDE]
        out[rows] = _banded(codes_a, starts_a[rows], n[rows], codes_b, starts_b[rows], m[rows], planes, limit)
    return out


def _points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all strings, and how many each has; -1 for null."""
    held, ends, valid = _held(strings)
    if not len(held) or held.max() < 128:
        return held, np.where(valid, np.diff(ends), -1)
    texts = strings.to_pylist()
    flat = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.array([-1 if t is None else len(t) for t in texts])


def _places(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    """The letters of strings at places, a row for each of them; `none` outside."""
    inside = (at >= 0) & (at < sizes)
    if not len(codes):
        return np.full(inside.shape, none, np.uint32)
    return np.where(inside, codes[np.where(inside, starts + at, 0)], np.uint32(none))


def _banded(codes_a, starts_a, n, codes_b, starts_b, m, planes: int, limit: int) -> np.ndarray:
    """Distances of pairs, longest a first; bit 63 of a column is the lowest diagonal of its band."""
    none, top, width = 1 << planes, np.uint64(63), int(n.max(initial=0))
    ends = m - n  # the diagonal of both ends
    low = (ends + limit) // 2
    text = _places(codes_a, starts_a, n, np.arange(width)[:, None], 0)
    below = _places(codes_b, starts_b, m, low + np.arange(-64, width)[:, None], none)
    score, out, alive, bit = np.maximum(ends, 0), np.full(len(n), -1, np.int64), np.arange(len(n)), (63 - low + ends).astype(np.uint64)
    window = [np.zeros(len(n), np.uint64) for _ in range(planes + 1)]
    for row in below[:64].astype(np.uint64):
        for p, w in enumerate(window):
            w >>= _ONE
            w |= (row >> np.uint64(p)) << top
    up = _ALL << (63 - low).astype(np.uint64)  # from row 0 on; rows above it count letters of a only
    down = np.zeros(len(n), np.uint64)
    for at in range(width):
        if at % LOOK == 0:
            done = n[alive] <= at
            out[alive[done]] = score[done]
            keep = ~done & (score <= limit)
            if not keep.all():
                alive, score, bit, up, down = alive[keep], score[keep], bit[keep], up[keep], down[keep]
                window, text, below = [w[keep] for w in window], text[:, keep], below[:, keep]
                if not len(alive):
                    return np.where(out > limit, -1, out)
        row, letter, differ = below[at + 64].astype(np.uint64), text[at].astype(np.uint64), None
        for p, w in enumerate(window):
            w >>= _ONE
            w |= (row >> np.uint64(p)) << top
            other = w if p == planes else w ^ (np.uint64(0) - ((letter >> np.uint64(p)) & _ONE))
            differ = other.copy() if differ is None else differ | other
        eq = ~differ
        same = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(same | up), same & up
        score = score + ((~same >> bit) & _ONE).astype(np.int64) * (at < n[alive])
        same >>= _ONE
        up, down = left | ~(same | right), same & right
    out[alive] = score
    return np.where(out > limit, -1, out)


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of all pairs."""
    x, y, letters = both(a, b)
    masks, words = x.masks(letters), -(-x.letters.shape[1] // 64)
    rows = [np.full((len(a), len(b)), _ALL) for _ in range(words)]
    for at in range(y.letters.shape[1]):
        carry = np.zeros((len(a), len(b)), np.uint64)
        for w in range(words):
            v = rows[w]
            hit = v & masks[y.letters[:, at], w].T
            first = v + hit
            total = first + carry
            carry = ((first < v) | (total < first)).astype(np.uint64)
            rows[w] = total | (v ^ hit)
    out = np.zeros((len(a), len(b)), np.int64)
    for w in range(words):
        inside = np.clip(x.n - 64 * w, 0, 64)
        out += inside[:, None] - np.bitwise_count(rows[w] & np.where(inside == 64, _ALL, (_ONE << (inside % 64).astype(np.uint64)) - _ONE)[:, None])
    return out


def equal_places(a: list[str], b: list[str]) -> np.ndarray:
    """At how many places the letters of each pair are equal: a product of two tables of marks."""
    x, y, letters = both(a, b)
    width = min(x.letters.shape[1], y.letters.shape[1])
    out = np.zeros((len(a), len(b)), np.float32)
    for letter in range(1, letters):
        out += (x.letters[:, :width] == letter).astype(np.float32) @ (y.letters[:, :width] == letter).astype(np.float32).T
    return out.astype(np.int64)


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """2 * LCS over both lengths; two empty strings are alike."""
    n = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :]
    return np.where(n > 0, 2 * common_lengths(a, b) / np.maximum(n, 1), 1.0)


def identities(a: list[str], b: list[str]) -> np.ndarray:
    """Equal letters at equal places over the length of b; 0 for an empty b."""
    n = np.array([len(s) for s in b])[None, :]
    return np.where(n > 0, equal_places(a, b) / np.maximum(n, 1), 0.0)


#: compare(ids of a, strands of a, ids of b, strands of b) gives columns of what is found.
Compare = Callable[[np.ndarray, list[str], np.ndarray, list[str]], dict[str, np.ndarray]]


def _in_slices(compare: Compare, schema: pa.Schema, ids_a, a, ids_b, b) -> pa.Table:
    """All pairs of two lists, PAIRS at a time.  Both are taken in order of length, so that a slice's strands are about as long."""
    by_a, by_b = (sorted(range(len(s)), key=lambda i: (len(s[i]), i)) for s in (a, b))
    ids_a, a, ids_b, b = ids_a[by_a], [a[i] for i in by_a], ids_b[by_b], [b[i] for i in by_b]
    out, wide = [], max(1, min(len(b), 256))
    tall = max(1, PAIRS // wide)
    for i in range(0, len(a), tall):
        for j in range(0, len(b), wide):
            out.append(pa.table(compare(ids_a[i : i + tall], a[i : i + tall], ids_b[j : j + wide], b[j : j + wide])).cast(schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def theta_join(left: DataFrame, right: DataFrame, compare: Compare, result: str, part: int = PART, small: int = SMALL) -> DataFrame:
    """What `compare` finds among all pairs of left (id, seq) and right (id, seq), in a table of schema `result`; ids are long.

    A pair comes to one call of compare, and it may be that a left strand comes to many; what it finds best among those of a call is best of
    all only when the results are reduced once more.
    """
    spark = left.sparkSession
    left, right = (t.select(F.col("id").cast("long").alias("id"), "seq").where("seq IS NOT NULL") for t in (left, right))
    size = right.agg(F.coalesce(F.sum(F.length("seq") + 16), F.lit(0)).alias("chars"), F.count("*").alias("n")).first()
    schema = _arrow_schema(spark, result)
    if size["chars"] <= small:
        rows = right.orderBy("id").collect()  # `small` characters at most
        ids, seqs = np.array([r["id"] for r in rows], np.int64), [r["seq"] for r in rows]
        held = spark.sparkContext.broadcast((ids, seqs))

        def run(batches):
            for batch in batches:
                got = _in_slices(compare, schema, np.asarray(batch.column(0)).astype(np.int64), batch.column(1).to_pylist(), *held.value)
                yield from got.to_batches()

        return left.mapInArrow(run, result)
    parts_a, parts_b = max(1, -(-left.count() // part)), -(-size["n"] // part)
    places = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.pmod(F.xxhash64("id", "seq"), F.lit(n)).cast("int")
    a = left.select("id", "seq", mine(parts_a).alias("p"), places(parts_b).alias("q"))
    b = right.select("id", "seq", places(parts_a).alias("p"), mine(parts_b).alias("q"))

    def meet(x, y):
        pick = lambda t: (np.asarray(t.column("id")).astype(np.int64), t.column("seq").to_pylist())
        return _in_slices(compare, schema, *pick(x), *pick(y))

    return a.groupBy("p", "q").cogroup(b.groupBy("p", "q")).applyInArrow(meet, result)


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def within_distance(left: DataFrame, right: DataFrame, distance: int, **options) -> DataFrame:
    """(a, b, distance): all pairs within an edit distance, whatever it is, by tiles."""

    def compare(ids_a, a, ids_b, b):
        found = edit_distances(a, b)
        i, j = np.nonzero(found <= distance)
        return {"a": ids_a[i], "b": ids_b[j], "distance": found[i, j]}

    return theta_join(left, right, compare, "a long, b long, distance int", **options)


def over_ratio(left: DataFrame, right: DataFrame, ratio: float, **options) -> DataFrame:
    """(a, b, score): all pairs a != b whose indel similarity is over a ratio."""

    def compare(ids_a, a, ids_b, b):
        found = indel_ratios(a, b)
        i, j = np.nonzero((found > ratio) & (ids_a[:, None] != ids_b[None, :]))
        return {"a": ids_a[i], "b": ids_b[j], "score": found[i, j]}

    return theta_join(left, right, compare, "a long, b long, score double", **options)


def best_of(left: DataFrame, right: DataFrame, metric: str = "identity", **options) -> DataFrame:
    """(a, b, score): for each strand of left the right one with the greatest score, the smaller id of equals; no row is without one.

    Each call of compare gives the best of its part; the best of these is taken at last.
    """
    measure = {"identity": identities, "ratio": indel_ratios}[metric]

    def compare(ids_a, a, ids_b, b):
        order = np.argsort(ids_b, kind="stable")
        found = measure(a, [b[i] for i in order])
        best = found.argmax(1)
        return {"a": ids_a, "b": ids_b[order][best], "score": found[np.arange(len(a)), best]}

    some = theta_join(left, right, compare, "a long, b long, score double", **options)
    return some.groupBy("a").agg(F.max_by("b", F.struct("score", -F.col("b"))).alias("b"), F.max("score").alias("score"))


def segments(length, distance: int):
    """Columns of the d + 1 segments of a strand: structs of number, start (from 0) and size.  Sizes differ by one at most, longer ones last."""
    n = distance + 1
    short, longer = F.floor(length / n).cast("int"), (length % n).cast("int")

    def one(i):
        before = F.greatest(i - (n - longer), F.lit(0))  # how many longer segments stand before
        return F.struct(i.alias("i"), (i * short + before).alias("start"), (short + (i >= n - longer).cast("int")).alias("size"))

    return F.transform(F.sequence(F.lit(0), F.lit(distance)), one)


def segment_pairs(left: DataFrame, right: DataFrame, distance: int, hot: int = HOT) -> DataFrame:
    """(a, b): ids of left (id, seq) and right (id, seq) that share a segment of b at a place that edits can have moved; each pair once.

    Strands of more than `distance` bases.  If i segments before one are whole or not, at most i edits lie before it and at most distance - i
    behind, or another segment is whole too; so the shift of segment i is i at most, and its difference from the difference of the lengths
    is distance - i at most.
    """
    index = right.select(F.col("id").alias("b"), F.length("seq").alias("n"), F.explode(segments(F.length("seq"), distance)).alias("s"), "seq")
    index = index.select("b", "n", F.col("s.i").alias("i"), F.substring("seq", F.col("s.start") + 1, F.col("s.size")).alias("w"))
    counts = index.groupBy("n", "i", "w").agg(F.count("*").alias("c"))
    counts = counts.select("n", "i", "w", F.ceil(F.col("c") / hot).cast("int").alias("parts"))
    lengths = right.select(F.length("seq").alias("n")).distinct()

    probe = left.select(F.col("id").alias("a"), "seq").join(lengths, F.abs(F.length("seq") - F.col("n")) <= distance)
    probe = probe.select("a", "seq", "n", (F.length("seq") - F.col("n")).alias("delta"), F.explode(segments(F.col("n"), distance)).alias("s"))
    i = F.col("s.i")
    low = F.greatest(-i, F.col("delta") - (distance - i), -F.col("s.start"))
    high = F.least(i, F.col("delta") + (distance - i), F.length("seq") - F.col("s.size") - F.col("s.start"))
    at = F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")))
    probe = probe.select("a", "n", i.alias("i"), "seq", F.col("s.start").alias("start"), F.col("s.size").alias("size"), at.alias("shift"))
    probe = probe.select("a", "n", "i", F.substring("seq", F.col("start") + F.col("shift") + 1, F.col("size")).alias("w"))

    spread = probe.join(counts, ["n", "i", "w"]).select("a", "n", "i", "w", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    placed = index.join(counts, ["n", "i", "w"]).select("b", "n", "i", "w", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    return spread.join(placed, ["n", "i", "w", "part"]).select("a", "b").distinct()


def edit_join(left: DataFrame, right: DataFrame, distance: int, least: int = LEAST_SEGMENT, **options) -> DataFrame:
    """(a, b, distance): all pairs of left (id, seq) and right (id, seq) within an edit distance.

    Strands whose segments have `least` bases or more are joined by segments, shorter ones by tiles.  Ids are distinct on each side.
    """
    left, right = (t.select(F.col("id").cast("long").alias("id"), "seq").where("seq IS NOT NULL") for t in (left, right))
    enough = least * (distance + 1)
    long, short = right.where(F.length("seq") >= enough), right.where(F.length("seq") < enough)
    pairs = segment_pairs(left.where(F.length("seq") >= enough - distance), long, distance)
    met = pairs.join(left.toDF("a", "x"), "a").join(right.toDF("b", "y"), "b").select("a", "b", F.levenshtein("x", "y", distance).alias("distance")).where("distance >= 0")
    return met.unionByName(within_distance(left.where(F.length("seq") < enough + distance), short, distance, **options))
