"""Embedding whitening by matrix-free block subspace iteration (operator 13).

Entries become the whole numbers x = floor(1024 c) + 100000. Their covariance V is never formed: a Spark pass over
the centred rows gives V Q = X'(X Q) / n for a block Q of BLOCK columns. The product is made orthogonal to the basis
so far (QR) and added to it, and a Rayleigh-Ritz step on the basis gives eigenpairs and residuals; the space of all
blocks holds that of the plain iteration, so it needs far fewer passes where eigenvalues lie close together. A basis
of more than MOST columns is restarted from its best Ritz vectors. The iteration ends when all k residuals are below
TOLERANCE of the largest eigenvalue; a last pass over the rows certifies them anew.

Rows are kept as blocks of whole numbers in the shared folder, so a pass reads no lists. Only matrices of the size of
the basis (dimensions x MOST) meet on the driver; sums over rows are made in the tasks and in one aggregation.

Edge cases: rows whose vector is null or empty, or has a null or non-finite entry (or one beyond 2^41, whose x is no
exact double), are left out; of vectors of several lengths those of the most frequent one stay (ties: the longer).
Repeated rows count as often as they stand, and vec_id may repeat or be null. Components with no variance (fewer
vectors than components, equal vectors) are not returned, so n equal vectors give no row. A deviation beyond a long is
null. Extra columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SCALE, SHIFT = 1024, 100_000
#: Greatest entry; above it floor(1024 c) is not exact in doubles.
GREATEST = 2.0**41
COMPONENTS, BLOCK, MOST, PASSES = 8, 16, 160, 500
#: Residuals, and eigenvalues that count as zero, relative to the largest eigenvalue.
TOLERANCE, ZERO = 1e-13, 1e-12
_BLOCK_BYTES = 4 << 20
COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whole(vectors: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have d finite entries, and their whole numbers (rows x d)."""
    mine = pc.fill_null(pc.equal(pc.list_value_length(vectors), d), False).to_numpy(zero_copy_only=False)
    c = vectors.filter(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    good = (np.abs(c) <= GREATEST).all(axis=1)  # not so for NaN, which nulls are
    at = np.flatnonzero(mine)[good]
    return at, np.floor(SCALE * c[good]).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column(0)
        for d in pc.unique(pc.list_value_length(vectors)).to_pylist():
            if not d:
                continue
            x = _whole(vectors, d)[1]
            step = max(1, _BLOCK_BYTES // (8 * d))
            for part in (x[at : at + step] for at in range(0, len(x), step)):
                yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "n": pa.array([len(part)], pa.int64()), "x": pa.array([part.tobytes()], pa.binary())})


def _total(blocks: DataFrame, fn: Callable[[np.ndarray], np.ndarray], d: int, shape: tuple[int, int], kind: str = "double") -> np.ndarray:
    """Sum over all rows of what fn makes of a block (rows x d) of whole numbers: added up in the tasks, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64 if kind == "long" else np.float64)
        for batch in batches:
            for x in batch.column(0):
                total += fn(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, d))
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(shape[0]), pa.int32()), "v": pa.array(total.tolist(), pa.list_(pa.int64() if kind == "long" else pa.float64()))})

    parts = blocks.select("x").mapInArrow(run, f"i int, v array<{kind}>")
    rows = parts.groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(shape[1])]).collect()  # shape[0] rows
    out = np.zeros(shape, np.int64 if kind == "long" else np.float64)
    for r in rows:
        out[r["i"]] = r[1:]
    return out


@dataclass
class Whitening:
    """Mean, eigenpairs and quality of the fit; transform applies it."""

    n: int
    d: int
    #: The mean is base + rest / n: whole numbers, so that rows are centred exactly.
    base: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2; null where a long does not hold one."""
        if not len(x):
            return []
        y = x - self.base
        if self.d * (self.n * (int(np.abs(y).max()) + 1)) ** 2 < 2**63:
            return ((self.n * y - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((self.n * y.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]

    def transform(self, df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """One row for each remaining row and component, COLUMNS."""
        k, d = len(self.values), self.d
        explained = self.values / self.trace if k else self.values

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = max(1, _BLOCK_BYTES // (8 * (d + 8 * k)))
                for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                    at, x = _whole(part.column(1), d)
                    m = len(at)
                    deviation = np.repeat(np.array(self.deviations(x), dtype=object), k)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, self.n, np.int64)), pa.array(deviation.tolist(), pa.int64()), pa.array(self.whitened(x).ravel()),
                        pa.array(np.tile(explained, m)), pa.array(np.full(m * k, self.identity_error)),
                    ], names=names)

        names = [c.split()[0] for c in COLUMNS.split(", ")]
        rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), _vector(vector))
        return rows.mapInArrow(run, COLUMNS) if k else rows.sparkSession.createDataFrame([], COLUMNS)


def _vector(name: str) -> Column:
    return F.col(f"`{name}`").cast("array<double>").alias("x")


def _orthogonal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns of a block outside a basis: projected and QR twice; columns that vanish go."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        q, r = np.linalg.qr(block)
        block = q[:, np.abs(np.diag(r)) > 1e-10]
    return block


def fit(df: DataFrame, k: int = COMPONENTS, vector: str = "embedding") -> Whitening | None:
    """The k leading eigenpairs of the covariance of all vectors; None without a vector."""
    with Scratch(df.sparkSession) as tmp:
        return _fit(tmp(df.select(_vector(vector)).mapInArrow(_blocks, "d int, n long, x binary")), k)


def _fit(blocks: DataFrame, k: int) -> Whitening | None:
    size = blocks.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if size is None:
        return None
    n, d = size["n"], size["d"]
    blocks = blocks.filter(F.col("d") == d)
    sums = [int(s) for s in _total(blocks, lambda x: x.sum(axis=0, keepdims=True).T, d, (d, 1), "long")[:, 0]]
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([s - n * int(b) for s, b in zip(sums, base, strict=True)], np.int64)
    model = Whitening(n, d, base, rest, np.empty(0), np.empty((d, 0)), 0.0, np.empty(0), 0.0, 0)

    def product(q: np.ndarray) -> np.ndarray:
        model.passes += 1
        return _total(blocks, lambda x: (z := model.centred(x)).T @ (z @ q), d, q.shape) / n

    model.trace = float(_total(blocks, lambda x: np.array([[np.square(model.centred(x)).sum()]]), d, (1, 1))[0, 0]) / n
    k = min(k, d)
    if model.trace == 0.0:
        return model
    block, most = min(d, max(BLOCK, 2 * k)), min(d, max(MOST, 4 * k))
    q = np.linalg.qr(np.random.default_rng(13).normal(size=(d, block)))[0]
    basis, image = q, product(q)
    while True:
        # Rayleigh-Ritz on the basis; residuals of the leading pairs.
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, ritz_image = basis @ turn, image @ turn
        residual = ritz_image - ritz * values
        size = np.linalg.norm(residual, axis=0)
        if (size[:k] <= TOLERANCE * values[0]).all() or model.passes >= PASSES or basis.shape[1] == d:
            break
        if basis.shape[1] + block > most and most < d:
            keep = most // 2
            basis, image = ritz[:, :keep], ritz_image[:, :keep]
        # What has not settled goes on; the images of the last block bring new directions if all has.
        more = _orthogonal(residual[:, :block], basis)[:, : d - basis.shape[1]]
        if not more.shape[1]:
            break
        basis, image = np.hstack([basis, more]), np.hstack([image, product(more)])
    # A last pass over the rows certifies the pairs.
    q = np.linalg.qr(ritz[:, :k])[0]
    image = product(q)
    values, turn = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    model.vectors = q @ turn
    model.residuals = np.linalg.norm(image @ turn - model.vectors * values, axis=0) / values[0]
    if (model.residuals > 100 * TOLERANCE).any():
        warnings.warn(f"residuals up to {model.residuals.max():.1e} of the largest eigenvalue after {model.passes} passes", stacklevel=3)
    some = values > ZERO * values[0]
    model.values, model.vectors, model.residuals = values[some], model.vectors[:, some], model.residuals[some]
    kept = len(model.values)
    mean = _total(blocks, lambda x: model.whitened(x).sum(axis=0, keepdims=True), d, (1, kept))[0] / n
    spread = _total(blocks, lambda x: (z := model.whitened(x) - mean).T @ z, d, (kept, kept)) / n
    model.identity_error = float(np.abs(spread - np.eye(kept)).max())
    return model


def whiten(df: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Fits all vectors of (vec_id, embedding) and returns COLUMNS of each."""
    model = fit(df, k)
    return df.sparkSession.createDataFrame([], COLUMNS) if model is None else model.transform(df)
