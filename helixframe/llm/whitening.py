"""Whitening of embeddings by a randomised range finder, power passes over all centred rows, and Rayleigh-Ritz.

Entries are rounded to integers, x = floor(64 * c) + 1000000, so that counts, sums and deviations are exact.  The fit list holds each
distinct vector once, and all statistics are over it.

1. A Gaussian start of COMPONENTS + OVERSAMPLING columns is orthonormalised to Q.
2. A power pass goes over all rows y = x - S / n of the fit list and sums y (y Q): V Q for the covariance V.  The projection Q' V Q gives
   Ritz values and vectors, and |V u - e u| their residuals; V Q orthonormalised is the next Q.
3. Where passes bring the residuals under TOLERANCE times the largest value, that is the answer.  Where their decline shows that they
   won't within PASSES, as for flat spectra, the range is widened to all dimensions; then V Q is V itself and the answer is direct.

A pass moves one matrix a task, dimensions times columns, and sums these by entry; the driver holds two such matrices, and none of the rows.

Cases: rows whose vector is null, or holds null or non-finite entries, are dropped; an empty table, or one without other rows, gives no
rows.  Repeated vectors and repeated rows count once for the fit, and each row is returned.  Entries of over 2^55 count as that.  Rows with
a null vec_id are kept.  Vectors of zero entries have no components and so no rows; vectors of different lengths are an error.  There are as
many components as dimensions, 16 at most.  A component whose eigenvalue is zero to double precision (fewer distinct vectors than
dimensions, equal columns) has a null `whitened` and counts for nothing in identity_error, which is null where no component is left.
explained is 0 where V is 0.  A deviation of 2^63 or more is null.  Ties of eigenvalues: any basis, the same for all rows.  Extra columns
are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import columns_of, prepare, save

SCALE, SHIFT = 64, 1_000_000
COMPONENTS, OVERSAMPLING, PASSES = 16, 8, 12
TOLERANCE = 1e-13
#: Rows of a vector block that are multiplied at once.
ROWS = 4096
_LARGEST = float(1 << 55)


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the rows that stay, and blocks of their integer vectors."""
    col = batch.column("v")
    ok = np.asarray(col.is_valid())
    flat = col.flatten()
    sizes = np.diff(np.asarray(col.offsets))
    values = np.asarray(flat.fill_null(float("nan")).cast(pa.float64()))
    bad = ~np.isfinite(values)
    row = np.repeat(np.flatnonzero(ok), sizes[ok])
    ok[row[bad]] = False
    stay = np.flatnonzero(ok)
    if not len(stay):
        return stay, []
    if len(np.unique(sizes[stay])) > 1:
        raise ValueError("vectors of different lengths")
    x = np.floor(np.clip(SCALE * values[np.isin(row, stay)], -_LARGEST, _LARGEST)).astype(np.int64) + SHIFT
    x = x.reshape(len(stay), -1)
    return stay, [x[a : a + ROWS] for a in range(0, len(x), ROWS)]


def encode(x: np.ndarray) -> list[bytes]:
    """Each row in the fewest bytes an entry that hold it: equal bytes for equal rows only."""
    near = x - SHIFT
    top = np.maximum(near.max(1), -(near.min(1) + 1)) if x.shape[1] else np.zeros(len(x), np.int64)
    out = []
    for row, t in zip(near, top):
        kind = np.int8 if t < 1 << 7 else np.int16 if t < 1 << 15 else np.int32 if t < 1 << 31 else np.int64
        out.append(bytes([np.dtype(kind).itemsize]) + row.astype(kind).tobytes())
    return out


def decode(packed: list[bytes]) -> np.ndarray:
    rows = [np.frombuffer(b, f"<i{b[0]}", offset=1).astype(np.int64) for b in packed]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("vectors of different lengths")
    return np.stack(rows) + SHIFT


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n x - S, exactly: as 64-bit integers where these hold it, or else as Python's."""
    most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if n * most + max((abs(int(s)) for s in total), default=0) < 1 << 62:
        return n * x - total.astype(np.int64)
    return n * x.astype(object) - total


def _deviation(y: np.ndarray) -> list[int | None]:
    most = max(abs(int(y.max())), abs(int(y.min()))) if y.size else 0
    if y.dtype != object and most * most * y.shape[1] < 1 << 63:
        return (y * y).sum(1).tolist()
    sums = [sum(v * v for v in map(int, row)) for row in y]
    return [s if s < 1 << 63 else None for s in sums]


def _entries(fit: DataFrame, shape: tuple[int, int], of) -> np.ndarray:
    """The sum over all rows of the fit list of a matrix, `of`(block of vectors) being its sum over a block."""
    width = shape[1]

    def scan(batches):
        out = np.zeros(shape)
        for batch in batches:
            packed = batch.column("x").to_pylist()
            for a in range(0, len(packed), ROWS):
                out += of(decode(packed[a : a + ROWS]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size), pa.int64()), pa.array(out.ravel())], ["at", "v"])

    out = np.zeros(shape[0] * width)
    for r in fit.select("x").mapInArrow(scan, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # shape[0] * shape[1] rows
        out[r["at"]] = r["v"]
    return out.reshape(shape)


def _moments(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sums by dimension."""

    def scan(batches):
        n, total = 0, None
        for batch in batches:
            packed = batch.column("x").to_pylist()
            for a in range(0, len(packed), ROWS):
                x = decode(packed[a : a + ROWS])
                part = x.sum(0).astype(object)  # ROWS entries of 2^56 at most
                if total is not None and len(total) != len(part):
                    raise ValueError("vectors of different lengths")
                n, total = n + len(x), part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))], ["d", "n", "s"])

    rows = fit.select("x").mapInArrow(scan, "d int, n long, s decimal(38,0)").groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s")).cast("decimal(38,0)").alias("s")).collect()
    if len({r["n"] for r in rows}) > 1:
        raise ValueError("vectors of different lengths")
    total = np.array([int(r["s"]) for r in sorted(rows, key=lambda r: r["d"])], object)
    return (rows[0]["n"] if rows else 0), total


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, their vectors, and the residuals |V u - e u|."""
    b = q.T @ vq
    e, s = np.linalg.eigh((b + b.T) / 2)
    e, s = e[::-1], s[:, ::-1]
    return e, q @ s, np.linalg.norm(vq @ s - (q @ s) * e, axis=0)


def principal(apply, dimensions: int, wanted: int, oversampling: int = OVERSAMPLING, passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = 0) -> tuple[np.ndarray, np.ndarray, list[tuple[int, float]]]:
    """Largest eigenvalues and unit eigenvectors of a covariance V that is known by `apply`(Q) = V Q; and (columns, residual) of each pass."""
    columns = min(dimensions, wanted + oversampling)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, columns)))[0]
    if columns == dimensions:
        q = np.eye(dimensions)
    said: list[tuple[int, float]] = []
    while True:
        vq = apply(q)
        e, u, residual = _ritz(q, vq)
        worst = float(residual[:wanted].max(initial=0) / e[0]) if len(e) and e[0] > 0 else 0.0
        said.append((q.shape[1], worst))
        if worst <= tolerance or q.shape[1] == dimensions:
            return e[:wanted], u[:, :wanted], said
        left = passes - len(said)
        slow = len(said) > 2 and worst * (worst / said[-2][1]) ** left > tolerance
        q = np.eye(dimensions) if slow or left <= 0 else np.linalg.qr(vq)[0]


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Returns id_col, component, n, deviation, whitened, explained and identity_error, a row for each remaining row and component."""
    spark = prepare(table.sparkSession)
    rows = columns_of(table, id=id_col, v=vector_col)

    def pack(batches):
        for batch in batches:
            _, blocks = _vectors(batch)
            for x in blocks:
                yield pa.RecordBatch.from_arrays([pa.array(encode(x), pa.binary())], ["x"])

    fit = save(rows.select("v").mapInArrow(pack, "x binary").distinct(), "vectors")
    n, total = _moments(fit)
    d = len(total)
    wanted = min(components, d)
    schema = f"`{id_col}` {dict(table.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n or not wanted:
        return spark.createDataFrame([], schema)

    mean = lambda x: np.asarray(_centred(x, n, total) / n, np.float64)

    def covariance_times(q):
        def of(x):
            y = mean(x)
            return y.T @ (y @ q)

        return _entries(fit, q.shape, of) / n

    trace = float(_entries(fit, (1, 1), lambda x: np.square(mean(x)).sum().reshape(1, 1))[0, 0]) / n
    e, u, _ = principal(covariance_times, d, wanted)
    e = np.concatenate([e, np.zeros(wanted - len(e))])
    alive = e > max(e[0], 0) * d * np.finfo(float).eps
    scale = np.where(alive, 1 / np.sqrt(np.where(alive, e, 1)), np.nan)
    project = u * scale
    error = None
    if alive.any():
        w = project[:, alive]

        def of_whitened(x):
            y = mean(x) @ w
            return y.T @ y

        error = float(np.abs(_entries(fit, (w.shape[1], w.shape[1]), of_whitened) / n - np.eye(w.shape[1])).max())
    explained = np.where(trace > 0, e / (trace or 1), 0.0)

    def out(batches):
        for batch in batches:
            stay, blocks = _vectors(batch)
            at = 0
            for x in blocks:
                y = _centred(x, n, total)
                z = np.asarray(y / n, np.float64) @ np.where(alive, project, 0)
                ids = batch.column("id").take(pa.array(np.repeat(stay[at : at + len(x)], wanted)))
                many = len(x) * wanted
                numbers = pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), len(x)))
                deviation = pa.array(_deviation(y), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), wanted)))
                whitened = pa.array(z.ravel(), mask=np.tile(~alive, len(x)))
                yield pa.RecordBatch.from_arrays([ids, numbers, pa.array(np.full(many, n)), deviation, whitened, pa.array(np.tile(explained, len(x))), pa.array([error] * many, pa.float64())], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])
                at += len(x)

    return rows.mapInArrow(out, schema)
