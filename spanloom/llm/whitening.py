"""Embedding whitening by matrix-free block Lanczos over distributed centred products.

The covariance V is never formed. A pass over the vectors gives V Q for a block Q of directions:
each task sums z (z' Q) over its centred vectors z, and the sums of the tasks are added by dimension.
The driver keeps the basis alone, which has at most as many columns as a vector has entries, however
many vectors there are. Every new block is orthogonalised against the whole basis, twice. Directions
that vanish (a breakdown: the block has reached an invariant space) are replaced by random ones
orthogonal to the basis. The images V Q of all blocks are kept, so the residuals of the Ritz vectors
are known exactly; the iteration ends when the largest ``components`` are below the tolerance or the
basis is complete. A block is wider than the number of components, so no multiple eigenvalue hides.

Entries are whole numbers and are centred as n*x - S without rounding. The squares of these numbers
are the deviations, whose sum is n^3 times the trace of V: the explained shares need no further pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Staged

# An entry c counts as floor(64 * c) + 1000000.
SCALE, SHIFT = 64, 1_000_000
CHUNK = 4096
#: No entry beyond: its scaled value would not fit a long.
LARGEST = float(1 << 56)


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums S of each dimension; components as columns with their eigenvalues, falling."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    residual: float


def scaled(vectors: DataFrame, staged: Staged) -> DataFrame:
    """(vec_id, x) of the vectors that can be fitted: no nulls, all entries finite, of the full number of dimensions."""
    good = f"size(embedding) > 0 and forall(embedding, c -> c is not null and not isnan(c) and abs(double(c)) < {LARGEST:.1f}D)"
    fit = vectors.where("embedding is not null").where(good)
    dims = fit.agg(F.max(F.size("embedding"))).first()[0] or 0
    x = F.expr(f"transform(embedding, c -> floor({SCALE} * double(c)) + {SHIFT}L)")
    return staged.write(fit.where(F.size("embedding") == dims).select("vec_id", x.alias("x")), "scaled")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column, all of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.slice(at, CHUNK)
            yield part, matrix(part.column("x"))


def summed(rows: DataFrame, make: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> np.ndarray:
    """Sum over all vectors of the (height, width) matrix that make gives for a chunk of them, a row of numbers for each task and line."""
    names = [f"c{j}" for j in range(width)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in blocks(batches):
            part = make(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height)), *[pa.array(total[:, j]) for j in range(width)]], ["i", *names])

    parts = rows.select("x").mapInArrow(partial, "i long, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((height, width))
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r[0]] = r[1:]
    return out


def lanczos(product: Callable[[np.ndarray], np.ndarray], dims: int, components: int, tolerance: float = 1e-13, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Largest eigenpairs of a symmetric operator known by its products with blocks.

    Returns (eigenvalues, vectors as columns, passes, largest residual over the largest eigenvalue).
    """
    rng = np.random.default_rng(seed)
    width = min(dims, components + 8)
    block = np.linalg.qr(rng.normal(size=(dims, width)))[0]
    basis, images, passes = np.zeros((dims, 0)), np.zeros((dims, 0)), 0
    while True:
        image = product(block)
        passes += 1
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(-values, kind="stable")[:components]
        values, turns = values[top], turns[:, top]
        vectors = basis @ turns
        scale = max(float(np.abs(values).max()), np.finfo(float).tiny)
        residual = float(np.linalg.norm(images @ turns - vectors * values, axis=0).max()) / scale
        if basis.shape[1] == dims or residual <= tolerance:
            return values, vectors, passes, residual
        width = min(width, dims - basis.shape[1])
        block = image
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, size > tolerance / 10 * scale][:, :width]
        # what broke down starts again at random, orthogonal to all that is there
        fresh = rng.normal(size=(dims, width - block.shape[1]))
        for _ in range(2):
            known = np.hstack([basis, block])
            fresh = np.linalg.qr(fresh - known @ (known.T @ fresh))[0] if fresh.shape[1] else fresh
        block = np.hstack([block, fresh])
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]


def fit(rows: DataFrame, components: int = 32) -> Whitening | None:
    """Whitening of the scaled vectors (vec_id, x); None without any."""
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).first()
    if not seen.n:
        return None
    n, dims = seen.n, seen.dims

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, np.int64)
        for _, x in blocks(batches):
            total += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(total)], ["i", "s"])

    sums = np.zeros(dims, np.int64)
    for r in rows.select("x").mapInArrow(partial, "i long, s long").groupBy("i").agg(F.sum("s")).collect():
        sums[r[0]] = r[1]

    def product(block: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            z = (x * n - sums) / n
            return z.T @ (z @ block)

        return summed(rows, of, dims, block.shape[1]) / n

    # the trace by the same sums as the deviations, each an exact integer
    trace = summed(rows, lambda x: np.array([[float(deviations(x, n, sums)[1].sum())]]), 1, 1)[0, 0] / n / n / n
    values, vectors, passes, residual = lanczos(product, dims, min(components, dims))
    # a direction without any spread can't be scaled to one
    firm = values > max(float(values[0]), 0.0) * dims * 1e-14
    return Whitening(n, sums, values[firm], vectors[:, firm], trace, passes, residual)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Sum of (n*x - S)^2 of each row: exact, null where no long holds it, and as doubles."""
    d = x * n - sums
    near = (d.astype(float) ** 2).sum(axis=1)
    big = near >= 9.2e18
    exact = np.where(big, 0, (np.where(big[:, None], 0, d) ** 2).sum(axis=1))
    return pa.array(exact, pa.int64(), mask=big), np.where(big, near, exact.astype(float))


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """Whitened vectors, a row for each fitted vector and component.

    Returns (vec_id, component, n, deviation, whitened, explained, identity_error), components from 1
    by falling eigenvalue. Vectors that are null, empty or shorter than the longest, or hold null or
    non-finite entries (or such as no long holds once scaled), are dropped; a null vec_id is kept.
    Repeated rows count as often as they are there, equal eigenvalues share any basis of their space.
    Directions without spread have no component, so a table of equal vectors, or of one, gives no
    rows, nor does an empty table. A deviation beyond a long is null. Other columns are ignored,
    whatever their names.
    """
    staged = Staged(vectors.sparkSession)
    rows = scaled(vectors, staged)
    out = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(dict(rows.dtypes)["vec_id"])
    model = fit(rows, components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], out)
    n, sums, k = model.n, model.sums, len(model.values)
    turn = model.vectors / np.sqrt(model.values)

    def of(x: np.ndarray) -> np.ndarray:
        return ((x * n - sums) / n) @ turn

    def moments(x: np.ndarray) -> np.ndarray:
        w = of(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    found = summed(rows, moments, k + 1, k) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    explained = model.values / model.trace

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in blocks(batches):
            w, which = of(x), np.repeat(np.arange(len(batch)), k)
            columns = [batch.column("vec_id").take(pa.array(which)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))), pa.array(np.full(len(which), n)), deviations(x, n, sums)[0].take(pa.array(which))]
            columns += [pa.array(w.ravel()), pa.array(np.tile(explained, len(batch))), pa.array(np.full(len(which), error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(written, out)
