"""Embedding whitening (operator 12): Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Every vector becomes whole numbers; each distinct one is a row of X, once, centred by the exact mean. From a unit vector v the
steps alternate u = Xv and v = X'u, each made orthogonal to all before it. A pass over the rows serves one step: since all
u are combinations of X's products with small vectors (U = XM), a task makes its part of U anew, and no left vector is ever
stored or shuffled. What passes leave to the driver are sums of about 3 * dimensions numbers. The small matrix R with XV = UR is bidiagonal
but for what reorthogonalisation takes off; its singular values and V give components and deviations.

All steps that the dimensions allow are taken: a repeated eigenvalue shows only when the space is used up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.scratch import Scratch, ship_code

COMPONENTS = 16
#: x = floor(GRID * entry) + SHIFT. Entries beyond 2^40 grid steps count as 2^40.
GRID, SHIFT, LARGEST = 64, 1_000_000, float(1 << 40)
BLOCK_BYTES = 2 << 20
#: A direction whose length is this small a part of the whole matrix is none.
NOTHING = 1e-11


def finite_matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the batch, their entries as doubles) for each length: vectors that are no null and hold finite entries only."""
    column = column.cast(pa.large_list(pa.float64()))
    starts, ends = np.asarray(column.offsets)[:-1], np.asarray(column.offsets)[1:]
    values = column.values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    present = np.asarray(column.is_valid())
    for length in np.unique((ends - starts)[present]):
        rows = np.flatnonzero(present & (ends - starts == length))
        entries = values[starts[rows][:, None] + np.arange(length)]
        good = np.isfinite(entries).all(axis=1)
        if length and good.any():
            yield int(length), rows[good], entries[good]


def _steps(entries: np.ndarray) -> np.ndarray:
    """x - SHIFT."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(GRID * entries), -LARGEST, LARGEST).astype(np.int64)


def _distinct_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for length, _, entries in finite_matrices(batch.column(0)):
            rows = np.unique(_steps(entries), axis=0)
            yield pa.record_batch([pa.array([length] * len(rows), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["length", "x"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one length as blocks of rows; the entries are doubles that hold whole numbers."""
    held: dict[int, list[bytes]] = {}

    def block(length: int) -> pa.RecordBatch:
        rows = held.pop(length)
        data = np.frombuffer(b"".join(rows), np.int64).astype(np.float64).tobytes()
        return pa.record_batch([pa.array([length], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([data], pa.binary())], ["length", "rows", "data"])

    for batch in batches:
        for length, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(length, []).append(x)
            if len(held[length]) * 8 * length >= BLOCK_BYTES:
                yield block(length)
    for length in list(held):
        yield block(length)


def _sums(fit: DataFrame, size: int, of) -> np.ndarray:
    """Sum over all blocks of the size numbers that `of` makes of a block; added up in tasks, then by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for data in batch.column(0):
                total += of(np.frombuffer(data.as_buffer(), np.float64))
        yield pa.record_batch([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["i", "s"])

    out = np.zeros(size)
    for i, s in fit.select("data").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s")).collect():  # size rows
        out[i] = s
    return out


def _mean(fit: DataFrame, length: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension: tasks add whole numbers, Spark adds theirs as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                x = np.frombuffer(data.as_buffer(), np.float64).reshape(-1, length).astype(np.int64)
                yield pa.record_batch([pa.array(np.arange(-1, length), pa.int32()), pa.array(np.append(len(x), x.sum(axis=0)))], ["i", "s"])

    sums = {i: int(s) for i, s in fit.select("data").mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect()}
    return sums[-1], [sums[i] for i in range(length)]


def bidiagonalised(products, length: int, rank: int, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (columns) of X.

    products(M, t) -> (M'X'Xt, |Xt|^2, X'Xt) is a pass over the rows; size is X's Frobenius norm, rank the most it can be.
    """
    random = np.random.Generator(np.random.PCG64(12))

    def apart(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
        for _ in range(3):
            v = v - basis @ (basis.T @ v)
        return v

    def fresh(basis: np.ndarray) -> np.ndarray:
        v = apart(random.standard_normal(length), basis)
        return v / np.linalg.norm(v)

    V, M, XtU = np.zeros((length, 0)), np.zeros((length, 0)), np.zeros((length, 0))
    columns: list[np.ndarray] = []
    v = fresh(V)
    while True:
        V = np.column_stack([V, v])
        part = XtU.T @ v  # what of Xv lies along each u: the last one is beta, the others are nought
        t = v - M @ part
        for _ in range(3):
            along, length2, z = products(M, t)
            if along @ along <= 1e-16 * length2 or length2 <= (NOTHING * size) ** 2:
                break
            part, t = part + along, t - M @ along
        alpha = np.sqrt(max(0.0, length2 - along @ along))
        found = alpha > NOTHING * size
        columns.append(np.append(part + along, alpha) if found else part)
        if found:
            M = np.column_stack([M, (t - M @ along) / alpha])
            XtU = np.column_stack([XtU, (z - XtU @ along) / alpha])
        if V.shape[1] == length:
            break
        v = apart(XtU[:, -1], V) if found else np.zeros(length)
        beta = np.linalg.norm(v)
        going = beta > NOTHING * size
        v = apart(v / beta, V) if going else fresh(V)
        v /= np.linalg.norm(v)
        if M.shape[1] == rank:  # the left side is complete: Xv is known without a pass
            if going:
                V = np.column_stack([V, v])
                columns.append(XtU.T @ v)
            break
    R = np.zeros((M.shape[1], V.shape[1]))
    for k, c in enumerate(columns):
        R[: len(c), k] = c
    _, values, right = np.linalg.svd(R, full_matrices=False)
    return values, V @ right.T


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """embeddings -> vec_id, component, n, deviation, whitened, explained, identity_error: rows of each vector and component.

    Vectors that are null, empty or hold null or non-finite entries have no rows, and so have those of another length than most
    distinct vectors (ties: the longer). Repeated vectors count once in the fit and are whitened each; repeated and null ids are like others.
    Components of no variance have no rows: with one distinct vector, or none, there are no rows at all. Equal eigenvalues have some
    orthonormal vectors, the same for all rows. deviation is null where it doesn't fit a long. Other columns are not read.
    """
    spark = embeddings.sparkSession
    ship_code(spark)
    scratch = Scratch(spark, "whitening")
    each = embeddings.select("embedding").mapInArrow(_distinct_in_task, "length int, x binary").distinct()
    blocks = scratch.table(each.mapInArrow(_packed, "length int, rows long, data binary"), "blocks")
    found = blocks.groupBy("length").agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    length = found[0]["length"] if found else 0
    fit = blocks.where(F.col("length") == length)
    n, sums = _mean(fit, length) if found else (0, [])
    mean = np.array([s / n for s in sums])

    def products(M: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        r = M.shape[1]
        both = np.column_stack([M, t])

        def of(data: np.ndarray) -> np.ndarray:
            x = data.reshape(-1, length) - mean
            made = x @ both
            w = made[:, r]
            return np.concatenate([made.T @ w, x.T @ w])

        out = _sums(fit, r + 1 + length, of)
        return out[:r], out[r], out[r + 1 :]

    trace = float(_sums(fit, 1, lambda data: np.sum((data.reshape(-1, length) - mean) ** 2, keepdims=True).ravel())[0]) if found else 0.0
    if trace:
        values, vectors = bidiagonalised(products, length, min(length, n - 1), np.sqrt(trace))
        kept = np.flatnonzero(values > NOTHING * np.sqrt(trace))[:components]
        axes = vectors[:, kept] / (values[kept] / np.sqrt(n))
        explained = values[kept] ** 2 / trace
        k = len(kept)

        def moments(data: np.ndarray) -> np.ndarray:
            w = (data.reshape(-1, length) - mean) @ axes
            return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

        sums_w = _sums(fit, k + k * k, moments)
        centre = sums_w[:k] / n
        error = float(np.abs(sums_w[k:].reshape(k, k) / n - np.outer(centre, centre) - np.eye(k)).max())
    scratch.drop(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows, entries in finite_matrices(batch.column(1)) if trace else ():
                if size != length:
                    continue
                x = _steps(entries)
                w = (x - mean) @ axes
                m = len(rows)
                columns = [
                    batch.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                    pa.array([d for d in _deviations(x, n, sums) for _ in range(k)], pa.int64()), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return embeddings.select("vec_id", "embedding").mapInArrow(run, schema)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, in whole numbers; the shift of x falls out."""
    about = (float(n) * x - np.array(sums, np.float64)) ** 2
    if float(n) * np.abs(x).max() < 2**62 and max(map(abs, sums)) < 2**62 and about.sum(axis=1).max() < 2**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return [d if d < 2**63 else None for d in exact]
