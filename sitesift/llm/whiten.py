"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The rows of C are the centred vectors. From a start vector v the method
alternates products with C and its transpose, C v_j = a_j u_j + b_(j-1)
u_(j-1) and C' u_j = a_j v_j + b_j v_(j+1), with u and v kept orthonormal; then
C = U B V' for a small upper bidiagonal B of the a and b. Its singular value
decomposition gives the components (V times B's right vectors) and deviations
(singular values over the root of the number of rows).

One pass over the rows makes both products of a step: y = C z and C' y. No
left vector is ever stored: u_j = C w_j for a short w_j on the driver, and as
C' u_i = g_i is known there from step i, the full reorthogonalisation of the
left side, u_i . C v = g_i . v, needs no pass of its own. The right side is
reorthogonalised against all earlier vectors. Both are done twice. As many
steps are made as a vector has entries (no eigenvalue, however close to
another, can be missed then); where the space is exhausted early (b or a is
0), the next start is orthogonal to all there was.

Exactness. Entries are whole numbers (``floor(scale * c) + shift``). Sums are
exact, and rows are centred as (n x - S) / n with n x - S exact, before
anything is multiplied.

Scale. The centred rows are written once as blocks of ``BLOCK_BYTES``; a pass
reads the blocks, each task adds up its own, and only vectors as long as one
embedding travel: to the driver from up to ``DIRECT`` tasks, beyond that
through an aggregation. The driver holds matrices of dimension by steps.
Nothing else grows with the rows.

Defined cases: a row whose vector is null or holds a null or a non-finite
entry is dropped, and so is one whose length is not the most common of the
rest (ties: the greater); a null id stays null. Repeated rows count each.
Components without deviation (under ``LEAST`` of the greatest) are none: fewer
than ``top`` come out, for one row or equal rows none. A squared distance
beyond 63 bits is null. Other columns are ignored. An empty table gives no
rows. Very long vectors are bounded by a block that holds one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import written

SCALE, SHIFT, TOP = 64, 1_000_000, 32
BLOCK_BYTES = 4 << 20
DIRECT = 512
LEAST = 1e-10


def entries(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x array<bigint>) of the rows whose vector is whole."""
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform("embedding", lambda c: F.floor(scale * c.cast("double")) + shift)
    return vectors.filter(F.col("embedding").isNotNull() & whole).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass
class Basis:
    """What whitening needs: rows, sums, the components as columns and their
    eigenvalues, the trace of the covariance."""
    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n x - S (exact) and x - S / n."""
        off = x * self.n - self.sums
        return off, off / self.n

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred @ self.components) / np.sqrt(self.eigenvalues)


def _added(rows: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray], size: int, kind: str) -> np.ndarray:
    """The sum over all batches of ``fn``'s vectors of ``size`` numbers."""
    dtype = {"bigint": np.int64, "double": np.float64}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for batch in batches:
            total += fn(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.from_numpy_dtype(dtype)))], names=["v"])

    parts = rows.mapInArrow(run, f"v array<{kind}>")
    if rows.rdd.getNumPartitions() <= DIRECT:
        return np.sum([np.array(r["v"], dtype) for r in parts.collect()], axis=0, dtype=dtype) + np.zeros(size, dtype)
    out = np.zeros(size, dtype)
    for r in parts.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[r["k"]] = r["x"]
    return out


def bidiagonalise(product: Callable[[np.ndarray], tuple[float, np.ndarray]], dims: int, steps: int,
                  seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """V (dims x steps) and B (steps x steps). ``product(z)`` gives |C z|^2
    and C' C z."""
    rng = np.random.default_rng(seed)
    right, short, back = np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros((dims, 0))
    band, least = np.zeros((steps, steps)), 0.0

    def away(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
        return v

    def fresh() -> np.ndarray:
        v = away(rng.standard_normal(dims), right)
        v = away(v / np.linalg.norm(v), right)
        return v / np.linalg.norm(v)

    v = fresh()
    for j in range(steps):
        right = np.column_stack([right, v])
        z = v
        for _ in range(2):
            z = z - short @ (back.T @ z)
        square, g = product(z)
        alpha = float(np.sqrt(square))
        least = max(least, 1e-14 * dims * alpha)
        if alpha > least:
            band[j, j] = alpha
            w, g = z / alpha, g / alpha
            after = away(g - alpha * v, right)
        else:
            w, g, after = np.zeros(dims), np.zeros(dims), np.zeros(dims)
        short, back = np.column_stack([short, w]), np.column_stack([back, g])
        if j + 1 == steps:
            break
        beta = float(np.linalg.norm(after))
        if beta > least:
            band[j, j + 1] = beta
            v = away(after / beta, right)
            v = v / np.linalg.norm(v)
        else:
            v = fresh()
    return right, band


def fit(rows: DataFrame, top: int = TOP) -> tuple[DataFrame, DataFrame, Basis | None]:
    """The rows of the common length, their centred blocks and the basis
    (None without rows or deviation) of ``rows(vec_id, x)``."""
    rows = written(rows, "whiten-rows")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if common is None or not common["d"]:
        return rows, rows, None
    dims, n = common["d"], common["n"]
    rows = rows.filter(F.size("x") == dims)
    sums = _added(rows.select("x"), lambda b: _matrix(b.column(0), dims).sum(axis=0), dims, "bigint")
    basis = Basis(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0)
    height = max(1, BLOCK_BYTES // (8 * dims))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            for a in range(0, len(x), height):
                centred = basis.centred(x[a:a + height])[1]
                yield pa.RecordBatch.from_arrays([pa.array([centred.tobytes()], pa.binary())], names=["c"])

    blocks = written(rows.select("x").mapInArrow(cut, "c binary"), "whiten-blocks")

    def over(fn: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        def of(batch: pa.RecordBatch) -> np.ndarray:
            return sum((fn(np.frombuffer(c.as_py(), np.float64).reshape(-1, dims)) for c in batch.column(0)), np.zeros(size))
        return _added(blocks, of, size, "double")

    def product(z: np.ndarray) -> tuple[float, np.ndarray]:
        def of(c: np.ndarray) -> np.ndarray:
            y = c @ z
            return np.concatenate([[y @ y], y @ c])
        out = over(of, dims + 1)
        return out[0], out[1:]

    right, band = bidiagonalise(product, dims, dims)
    _, deviation, turned = np.linalg.svd(band)
    held = np.flatnonzero(deviation > LEAST * deviation[0])[:top]
    if not len(held) or not deviation[0]:
        return rows, blocks, None
    basis = Basis(n, sums, right @ turned[held].T, deviation[held] ** 2 / n, float((deviation ** 2).sum() / n))
    return rows, blocks, basis


def identity_error(blocks: DataFrame, basis: Basis) -> float:
    """Largest absolute entry of the whitened rows' covariance less the
    identity, by a pass over the blocks."""
    dims, k = basis.components.shape

    def of(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(k * k + k)
        for c in batch.column(0):
            y = basis.project(np.frombuffer(c.as_py(), np.float64).reshape(-1, dims))
            out += np.concatenate([(y.T @ y).reshape(-1), y.sum(axis=0)])
        return out

    got = _added(blocks, of, k * k + k, "double") / basis.n
    mean = got[k * k:]
    return float(np.abs(got[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _squares(off: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row, null beyond 63 bits."""
    if not len(off) or float(np.abs(off).max()) ** 2 * off.shape[1] < 2.0 ** 62:
        return (off * off).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in off]
    return [v if v < 1 << 63 else None for v in exact]


WHITENED = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, top: int = TOP) -> DataFrame:
    """A row for every row of ``vectors(vec_id, embedding)`` that is whole and
    each of its up to ``top`` components."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, {WHITENED}"
    rows, blocks, basis = fit(entries(vectors), top)
    if basis is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(blocks, basis)
    dims, k = basis.components.shape
    height = max(1, BLOCK_BYTES // (8 * (dims + k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, height):
                part = batch.slice(a, height)
                m = part.num_rows
                off, centred = basis.centred(_matrix(part.column(1), dims))
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, basis.n, np.int64)), pa.array(_squares(off), pa.int64()).take(pa.array(each)),
                    pa.array(basis.project(centred).reshape(-1)), pa.array(np.tile(basis.eigenvalues / basis.trace, m)),
                    pa.array(np.full(m * k, error))],
                    names=["vec_id", *(f.split()[0] for f in WHITENED.split(", "))])

    return rows.select("vec_id", "x").mapInArrow(run, schema)
