"""Secret scans: three kinds of pattern, and a token-efficiency test for random strings.

A byte-pair vocabulary has long tokens for what people write, so random strings need more tokens for their length.  Candidates are runs of
letters, digits and a few marks that have at least `min_length` characters; one whose characters per token are fewer than `max_ratio` is
a `random` span.  A run that is not is cut at its marks, and its parts, and stretches of parts that people would not write, are tested
each by itself: a readable name or path before a key does not hide it.  Known digests (hexadecimal with a digest's length), UUIDs,
numbers with separators and identifiers (words joined by marks or capitals, with a short number at most; so any word in one case) are
excluded first.  A run is also cut at what a pattern found, so that random characters on either side of a base span are found too.

Spans count code points, end exclusive.  Cases: a null text counts as empty.  A null doc_id stays null.  Repeated rows are scanned each by
itself; spans that begin together go by kind; an empty table gives no rows.  The work grows with the length of a text and the number of its
spans, whatever the number.  Extra columns are kept by `redact` and ignored by `scan`.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType

from helixframe.llm.bpe import Codec, codec
from helixframe.llm.common import columns_of, prepare

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_PART = re.compile(r"[A-Za-z0-9]+")
_EXCLUDED = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|[0-9+/_=-]+"
    r"|[+/_=-]*(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})(?:[+/_=-]+(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,4})|[A-Z][a-z]+)*[0-9]{0,4}[+/_=-]*",
)
#: Any byte that is part of a run the hexadecimal pattern takes becomes 1: a search for 24 of them is quick.
_HEX_MARK = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))
_RUN_MARK = bytes(1 if re.match(rb"[A-Za-z0-9+/_=-]", bytes([c])) else 0 for c in range(256))


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    out, low = [], raw.lower()
    if any(x in low for x in (b"passw", b"secret", b"token", b"api")):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"\1" * 24 in raw.translate(_HEX_MARK):
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What the spans cover, as stretches in order that don't touch."""
    out = []
    for a, b, *_ in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def random_spans(text: str, raw: bytes, coder: Codec, taken: list[tuple[int, int, str]], min_length: int, max_ratio: float) -> list[tuple[int, int, str]]:
    if b"\1" * min_length not in raw.translate(_RUN_MARK):
        return []
    covered = merged(taken)
    begins = [a for a, _ in covered]

    def free(start, end):
        """The parts of a run that no base span covers."""
        i = max(bisect_right(begins, start) - 1, 0)
        while start < end:
            while i < len(covered) and covered[i][1] <= start:
                i += 1
            a, b = covered[i] if i < len(covered) else (end, end)
            if start < min(a, end):
                yield start, min(a, end)
            start = max(start, b)

    def is_random(a, b):
        x = text[a:b]
        return len(x) >= min_length and not _EXCLUDED.fullmatch(x) and len(x) / len(coder.encode(x)) < max_ratio

    out = []
    for m in _CANDIDATE.finditer(text):
        for a, b in free(*m.span()):
            if b - a < min_length or _EXCLUDED.fullmatch(text, a, b):
                continue
            if is_random(a, b):
                out.append((a, b, "random"))
            else:
                out += [(x, y, "random") for x, y in stretches(text, a, b, coder, max_ratio) if is_random(x, y)]
    return out


def stretches(text: str, start: int, end: int, coder: Codec, max_ratio: float) -> list[tuple[int, int]]:
    """Longest stretches of a run, from part to part, without a part that people would write: words and digests, or with long tokens."""
    out, last = [], None
    for m in _PART.finditer(text, start, end):
        x = m[0]
        if len(x) >= 4 and (not x.isdecimal() and _EXCLUDED.fullmatch(x) or len(x) / len(coder.encode(x)) >= max_ratio):
            last = None
        elif last is None:
            out.append(m.span())
            last = out
        else:
            out[-1] = (out[-1][0], m.end())
    return out


def spans(text: str, coder: Codec, min_length: int = 16, max_ratio: float = 1.9) -> tuple[list, list]:
    """Base spans and all spans (start, end, kind), by start and then kind as listed."""
    raw = text.encode("utf-8", "replace")
    order = lambda s: (s[0], KINDS.index(s[2]))
    base = sorted(base_spans(text, raw), key=order)
    return base, sorted(base + random_spans(text, raw, coder, base, min_length, max_ratio), key=order)


def written(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Returns id_col, base and found: arrays of struct(kind, start, end)."""
    prepare(docs.sparkSession)
    kind = "array<struct<kind:string,start:int,end:int>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batches):
        coder = codec(path, pattern)
        for b in batches:
            got = [spans(x or "", coder, **limits) for x in b.column("text").to_pylist()]
            cols = [pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in g[i]] for g in got], arrow) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], ["id", "base", "found"])

    rows = columns_of(docs, id=id_col, text=text_col).selectExpr("cast(id as long) id", "text")
    return rows.mapInArrow(work, f"id long, base {kind}, found {kind}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, path: str, pattern: str, text_col: str = "text", mark: str = "[SECRET]", length_col: str | None = None, **limits) -> DataFrame:
    """All rows and columns, whatever their names; in texts, each span (overlapping ones as one) is replaced by `mark`.

    length_col: a column that holds the number of characters and follows the new text, if it is there and is a number; null texts keep theirs.
    """
    prepare(docs.sparkSession)
    text_at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None
    if length_at is not None and not isinstance(docs.schema[length_at].dataType, NumericType):
        length_at = None

    def clean(text, coder):
        if text is None or not (found := spans(text, coder, **limits)[1]):
            return text
        out, at = [], 0
        for a, b, _ in found:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def work(batches):
        coder = codec(path, pattern)
        for b in batches:
            texts = [clean(x, coder) for x in b.column(text_at).to_pylist()]
            if length_at is not None:
                kind, old = b.schema.field(length_at).type, b.column(length_at)
                new = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(kind)
                b = b.set_column(length_at, b.schema.field(length_at), pa.compute.coalesce(new, old))
            yield b.set_column(text_at, b.schema.field(text_at), pa.array(texts, b.schema.field(text_at).type))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(work, plain.schema).toDF(*docs.columns)
