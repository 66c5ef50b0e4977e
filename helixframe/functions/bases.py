"""Header integers, spaced identifiers, numbers in bases and rule expressions, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions import rules as R
from helixframe.functions import strand as S

# Masks over header integers by struct letter.
MASKS = {"H": 0xF9C3, "I": 0xF9C36F9C, "Q": 0xF9C36F9CF9C36F9C - (1 << 64), "B": 0}


def xor_mask(value: Column, letter: str = "I") -> Column:
    """Its own inverse."""
    return value.bitwiseXOR(F.lit(MASKS[letter]))


def little_endian(value: Column, width: int = 4) -> Column:
    """Lower-case hexadecimal digits, low byte first."""
    digits = F.lpad(F.lower(F.hex(value)), 2 * width, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))])


def from_little_endian(digits: Column, width: int = 4) -> Column:
    return F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))]), 16, 10).cast("long")


def header(last_length: Column, name: Column, size: int) -> Column:
    """Digits of a header chunk: length of the last chunk (four bytes), name, zeros up to the chunk's size.  A name that has no room fails."""
    coded = F.encode(name, "utf-8")
    whole = F.rpad(F.concat(little_endian(last_length), F.lower(F.hex(coded))), 2 * size, "0")
    return F.when(F.octet_length(coded) > size - 4, F.raise_error(F.concat(F.lit("no room for the name "), name))).otherwise(whole)


def header_length(digits: Column) -> Column:
    return from_little_endian(F.substring(digits, 1, 8))


def header_name(digits: Column) -> Column:
    return F.decode(F.unhex(F.regexp_extract(F.substring(digits, 9, 1 << 20), "^((?:(?!00)..)*)", 1)), "utf-8")


def base_four(value: Column, width: int) -> Column:
    """A number as bases, A for zero in front; of a number that has no room, the low digits."""
    return F.translate(F.lpad(F.right(F.conv(value.cast("string"), 10, 4), F.lit(width)), width, "0"), "0123", S.BASES)


def from_base_four(strand: Column) -> Column:
    return F.conv(F.translate(strand, S.BASES, "0123"), 4, 10).cast("long")


def spaced(ident: Column, payload: Column, spacing: int) -> Column:
    """The characters of an identifier, with `spacing` of the payload after each; what is left of the payload follows."""
    if spacing <= 0:
        return F.concat(ident, payload)
    at = F.sequence(F.lit(1), F.length(ident))
    mixed = F.array_join(F.transform(at, lambda i: F.concat(F.substring(ident, i, F.lit(1)), F.substring(payload, (i - 1) * spacing + 1, F.lit(spacing)))), "")
    return F.concat(mixed, F.substring(payload, F.length(ident) * spacing + 1, F.length(payload)))


def unspaced(whole: Column, width: int, spacing: int) -> Column:
    """Identifier of `width` characters and payload, as a struct (ident, payload)."""
    n = width * (spacing + 1)
    parts = [F.substring(whole, i * (spacing + 1) + 1, 1) for i in range(width)]
    rest = [F.substring(whole, i * (spacing + 1) + 2, spacing) for i in range(width)]
    return F.struct(F.concat(*parts).alias("ident"), F.concat(*rest, F.substring(whole, F.lit(n + 1), F.length(whole))).alias("payload"))


def phred(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10.0)


def density(x: Column, header_len: int, repair_len: int) -> Column:
    """Bits a base of x payload bytes."""
    return 2 * x / (x + header_len + repair_len)


def runs(strand: Column) -> Column:
    """Run-length encoding: an array of (base, n)."""
    return F.transform(F.regexp_extract_all(strand, F.lit("(A+|C+|G+|T+|[^ACGT])"), F.lit(1)), lambda r: F.struct(F.left(r, F.lit(1)).alias("base"), F.length(r).alias("n")))


def oligo_rule(strand: Column, low: float = 45, high: float = 55, longest: int = 3) -> Column:
    """1 for a run over `longest`, a share of G and C outside the band or an undesired motif, turned or not."""
    either = lambda m: strand.contains(m) | strand.contains(m[::-1]) | strand.contains(m[::-1].translate(str.maketrans("ACGT", "TGCA")))
    bad = (S.longest_run(strand) > longest) | ~S.gc_percent(strand).between(low, high)
    for m, _ in R.MOTIFS:
        bad = bad | either(m)
    return F.when(bad, 1.0).otherwise(0.0)


def with_complements(motifs: list[str]) -> list[str]:
    """The motifs, then their complements."""
    return motifs + [m.translate(str.maketrans("ACGT", "TGCA")) for m in motifs]


def with_reverse_complements(motifs: list[tuple[str, float]]) -> list[tuple[str, float]]:
    return motifs + [(m[::-1].translate(str.maketrans("ACGT", "TGCA")), p) for m, p in motifs]


def with_reversed(motifs: list[str]) -> list[str]:
    return motifs + [m[::-1] for m in motifs]


def any_motif(strand: Column, motifs: list[str]) -> Column:
    """1 if a strand has one of the motifs: a single search for all of them."""
    return F.when(strand.rlike("|".join(motifs)), 1.0).otherwise(0.0)


def round_to(x: Column, base: int = 5) -> Column:
    """The nearest multiple of base; of two, the even multiple."""
    return F.lit(base) * F.bround(x / base)


def elapsed(seconds: Column) -> Column:
    """Days, hours, minutes and seconds of a number of seconds, as a struct."""
    whole = F.floor(seconds)
    return F.struct(F.floor(whole / 86400).alias("days"), F.floor(whole / 3600 % 24).alias("hours"), F.floor(whole / 60 % 60).alias("minutes"), (whole % 60).alias("seconds"))


def chaos_game(strand: Column, size: int = 5000) -> Column:
    """The points of the chaos game, an array of (x, y): the first at its base's corner, each next one half way to the next base's corner."""
    corner = lambda c: (F.when(c.isin("T", "C"), F.lit(float(size))).otherwise(F.lit(0.0)), F.when(c.isin("G", "C"), F.lit(float(size))).otherwise(F.lit(0.0)))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    letters = F.filter(F.split(strand, ""), lambda c: c != "")

    def step(points, c):
        x, y = corner(c)
        last = F.element_at(points, -1)
        new = F.when(F.size(points) == 0, point(x, y)).otherwise(point((last["x"] + x) / 2, (last["y"] + y) / 2))
        return F.concat(points, F.array(new))

    return F.aggregate(letters, F.array().cast("array<struct<x:double,y:double>>"), step)


def bits_of(data: Column) -> Column:
    """The bits of bytes, as a string."""
    return F.array_join(F.transform(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1)), lambda x: F.lpad(F.conv(x, 16, 2), 8, "0")), "")


def bytes_of(bits: Column) -> Column:
    """The bytes of a string of bits, a multiple of eight."""
    return F.unhex(F.array_join(F.transform(F.regexp_extract_all(bits, F.lit("(.{8})"), F.lit(1)), lambda x: F.lpad(F.conv(x, 2, 16), 2, "0")), ""))


def flipped(strand: Column, share: Column) -> Column:
    """A and C, and G and T, changed for each other in the first ceil(share * length) bases."""
    n = F.ceil(share * F.length(strand)).cast("int")
    return F.concat(F.translate(F.substring(strand, F.lit(1), n), "ACGT", "CATG"), F.substring(strand, n + 1, F.length(strand)))


def rule_functions() -> dict:
    """Rules by name; numbers in an expression become their parameters."""
    return {
        "homopolymer": lambda s: R.homopolymer(s),
        "gc": lambda s, low=30, high=70: R.gc_band(S.gc_percent(s), low, high),
        "windowed_gc": lambda s, window=50, low=30, high=70: R.windowed_gc(s, int(window), low, high),
        "motifs": lambda s: R.motifs(s),
        "iupac": lambda s: R.iupac_motifs(s),
        "unit_runs": lambda s, unit=2: R.unit_runs(s, int(unit)),
        "repeat_region": lambda s, k=20: R.repeat_region(s, int(k)),
        "small_repeats": lambda s, k=9: R.small_repeats(s, int(k)),
        "long_strand": lambda s: R.long_strand(s),
        "illegal": lambda s: R.illegal_symbols(s),
        "constant": lambda s, p=0.02: F.lit(float(p)),
    }


def parse_rules(text: str, strand: Column) -> Column:
    """A rule expression such as `max(gc(40,60), sum(homopolymer, motifs))` as a column, at most 1.  Combiners are sum, max and min."""
    tokens = re.findall(r"[A-Za-z_]+|-?\d+(?:\.\d+)?|[(),]", text)
    if "".join(tokens) != re.sub(r"\s", "", text):
        raise ValueError(f"not a rule expression: {text!r}")
    known, at = rule_functions(), 0

    def arguments() -> list:
        nonlocal at
        found = []
        if at < len(tokens) and tokens[at] == "(":
            at += 1
            while tokens[at] != ")":
                found.append(term())
                at += tokens[at] == ","
            at += 1
        return found

    def term():
        nonlocal at
        word = tokens[at]
        at += 1
        if re.fullmatch(r"-?\d+(?:\.\d+)?", word):
            return float(word)
        inside = arguments()
        if word in ("sum", "max", "min"):
            if not inside:
                raise ValueError(f"{word} needs rules")
            out = inside[0]
            for x in inside[1:]:
                out = out + x if word == "sum" else F.greatest(out, x) if word == "max" else F.least(out, x)
            return out
        if word not in known:
            raise ValueError(f"no rule is called {word!r}")
        return known[word](strand, *inside)

    try:
        out = term()
    except IndexError:
        raise ValueError(f"not a rule expression: {text!r}") from None
    if at != len(tokens):
        raise ValueError(f"not a rule expression: {text!r}")
    return F.least(F.lit(1.0), out)
