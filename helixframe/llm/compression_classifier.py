"""Quality by compression: a text is like the labelled texts whose dictionary makes it smaller.

Two zstandard dictionaries are built, from labelled good and bad text.  A text is compressed in blocks, so that a long one does not come to
describe itself, under each dictionary.  The difference of the two sizes is normalised by the text's size and PRIOR more bytes, and goes
through a logistic curve.  The curve also regards the share that PRIOR is of that sum: a short text shows little difference whatever it is,
while a long one without any is one that neither kind of text helps to describe, such as a few words over and over.

The curve is fitted across halves: each half of the labelled texts is scored under dictionaries of the other half; the dictionaries of the
model are then built from both.

Bounds of the fit: at most `per_label` labelled rows of each label (smallest hash of doc_id first) whose text has at most `max_chars`
characters.  Scoring reads every text whole.

Cases: null and empty texts have difference 0, so their score is the curve's value there; all of them have the same.  Labels other than 0
and 1, and labels without a document, are ignored; of several labels of a document the larger counts.  With no labels of one kind, every
score is the share of label 1 (0.5 without any).  Rows with a null doc_id are scored and never learned from.  Repeated rows are scored each
by itself, ties have equal scores; an empty table gives none.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import columns_of, prepare

BLOCK, LEVEL, DICTIONARY = 512, 3, 65536
#: Bytes that every text counts as longer than it is.
PRIOR = 50


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: tuple[float, float, float]  # of the difference, of the share of PRIOR, and the level

    def scorer(self):
        return Scorer(self)


class Scorer:
    """Holds compressors, so it is made on the worker."""

    def __init__(self, model: Model):
        self.model, self.packers = model, []
        for data in (model.good, model.bad):
            if data:
                known = zstandard.ZstdCompressionDict(data)
                known.precompute_compress(level=LEVEL)
                self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: bytes) -> tuple[float, float, float]:
        size, difference = len(text) + PRIOR, 0
        if text and len(self.packers) == 2:
            blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
            good, bad = (sum(len(p.compress(x)) for x in blocks) for p in self.packers)
            difference = bad - good
        return difference / size, PRIOR / size, 1.0

    def __call__(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.model.curve, self.features(text)), -30, 30))))


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples to train on, their text itself."""
    samples = [t[i : i + 4 * BLOCK] for t in texts for i in range(0, len(t), 4 * BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[:DICTIONARY]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, ...]:
    """The weights of the columns of x, by Newton steps with a slight ridge."""
    t = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        g = x.T @ (weight * (y - p)) - 1e-3 * t
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(t))
        t = t + np.linalg.solve(h, g)
    return tuple(map(float, t))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 5, per_label: int = 1500, max_chars: int = 20000) -> Model:
    """Learn from labels whose crc32(doc_id as text) mod `held_out` is not 0."""
    spark = prepare(docs.sparkSession)
    known = columns_of(labels, id=id_col, label=label_col).where(f"label IN (0, 1) AND id IS NOT NULL AND crc32(cast(id as string)) % {held_out} != 0")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(count.values())
    share = count.get(1, 0) / total if total else 0.5
    picked = known.where("label = 0").orderBy(F.xxhash64("id"), "id").limit(per_label).unionAll(known.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(per_label))
    ids = {r["id"]: int(r["label"]) for r in picked.collect()}  # at most 2 per_label rows
    chosen = spark.createDataFrame(list(ids.items()) or [(-1, -1)], "id long, label int")
    rows = columns_of(docs, id=id_col, text=text_col).where(F.length("text").between(1, max_chars)).join(F.broadcast(chosen), "id").orderBy("id").collect()
    texts = {0: [], 1: []}
    for r in rows:
        texts.get(r["label"], []).append(r["text"].encode("utf-8", "replace"))
    if not texts[0] or not texts[1]:
        return Model(b"", b"", (0.0, 0.0, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))))
    halves = [{y: t[i::2] or t for y, t in texts.items()} for i in (0, 1)]
    seen = []
    for learned, judged in (halves, halves[::-1]):
        see = Model(dictionary(learned[1]), dictionary(learned[0]), (0.0, 0.0, 0.0)).scorer()
        seen += [(see.features(t), y) for y in (0, 1) for t in judged[y]]
    x, y = np.array([f for f, _ in seen]), np.array([y for _, y in seen], float)
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)
    return Model(dictionary(texts[1]), dictionary(texts[0]), logistic(x, y, weight))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col and score, the chance of label 1."""
    prepare(docs.sparkSession)

    def work(batches):
        see = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "score": pa.array([see(x or b"") for x in b.column("text").to_pylist()], pa.float64())})

    rows = columns_of(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(work, "id long, score double").withColumnRenamed("id", id_col)
