"""Byte-level BPE with a local rank file.

Long texts are cut where no match of the splitting pattern can cross: before a blank that follows a letter or digit.  A match never goes on
from a character that is not white space to one that is, and the piece on the left ends in no white space, so the pattern's look-ahead
sees the same.  That holds for patterns of this kind only, so long texts are cut under the patterns of CUTTABLE and whole under any other.
Decoding works on bytes, so a token that ends inside a character does no harm.

Cases: a null text counts as empty and has no tokens; so does an empty one.  A null doc_id stays null.  Special tokens are ordinary text.
Repeated rows are encoded each by itself, merges of one rank go from the left, and an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from helixframe.llm.common import columns_of, prepare

CUT = 1 << 16
# Fixed value: the splitting pattern, whose matches never cross from other characters to white space.
CUTTABLE = frozenset((r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",))
_codecs: dict[tuple[str, str], Codec] = {}


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.texts = {i: str(i) for i in ranks.values()}
        self.cut = CUT if pattern in CUTTABLE else None

    def pieces(self, text: str):
        """Parts of at most about CUT characters that can be encoded one by one."""
        a, n = 0, len(text)
        while self.cut and n - a > self.cut:
            b = text.find(" ", a + self.cut)
            while b > 0 and not text[b - 1].isalnum():
                b = text.find(" ", b + 1)
            if b < 0:
                break
            yield text[a:b]
            a = b
        yield text[a:] if a else text

    def encode(self, text: str) -> list[int]:
        if not self.cut or len(text) <= self.cut:
            return self.encoding.encode_ordinary(text)
        return [i for piece in self.pieces(text) for i in self.encoding.encode_ordinary(piece)]

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def codec(path: str, pattern: str) -> Codec:
    """One codec for each file and worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]



def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col and ids (array of int)."""
    prepare(docs.sparkSession)

    def work(batches):
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "ids": pa.array([c.encode(x or "") for x in b.column("text").to_pylist()], pa.list_(pa.int32()))})

    rows = columns_of(docs, id=id_col, text=text_col).selectExpr("cast(id as long) id", "text")
    return rows.mapInArrow(work, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Returns id_col and bytes, the raw bytes of the tokens; a null list has none."""
    prepare(rows.sparkSession)

    def work(batches):
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "bytes": pa.array([c.decode(x or []) for x in b.column("ids").to_pylist()], pa.binary())})

    return columns_of(rows, id=id_col, ids=ids_col).mapInArrow(work, "id long, bytes binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: id_col, n_tokens, ids_sha256 and decoded_sha256, so that no list of ids leaves the worker."""
    prepare(docs.sparkSession)

    def work(batches):
        c = codec(path, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for x in b.column("text").to_pylist():
                ids = c.encode(x or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(c.texts.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha} if n else {"id": b.column("id"), "n_tokens": pa.array([], pa.int64()), "ids_sha256": pa.array([], pa.string()), "decoded_sha256": pa.array([], pa.string())})

    rows = columns_of(docs, id=id_col, text=text_col).selectExpr("cast(id as long) id", "text")
    return rows.mapInArrow(work, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
