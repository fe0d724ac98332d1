"""Whitening of embeddings by shifted Cholesky QR.

The centred fit rows X are never gathered. A pass sums the Gram matrix of the rows as they stand, X times the inverses of
the factors found so far (triangular solves, row by row); its Cholesky factor joins these. The first Gram matrix is
shifted, so that its factor exists however ill conditioned X is, and two further passes make the rows orthonormal to
double precision. The product R of the factors has X's singular values and right vectors, so the SVD of a matrix as small
as the dimension gives the whitening components without squaring X's condition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.llm.storage import stored

#: Grid of the exact integer entries: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Largest entry whose grid value is exact in double precision.
LARGEST = 2.0**46
PASSES = 3


@dataclass
class Whitening:
    """``mean_of`` (n and the exact sums), right singular vectors in columns, eigenvalues, their total, and the error."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all entries finite and on the grid."""
    ok = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) <= LARGEST), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & ok, F.lit(False))


def on_grid(vector: Column) -> Column:
    return F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + OFFSET).cast("long"))


def centred(column: pa.Array, n: int, sums: list[int], wide: bool) -> np.ndarray:
    """n * x - S of every row, exact: 64-bit integers, or Python integers (``wide``) where those might not hold them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(sums))
    if wide:
        return flat.astype(object) * n - np.array(sums, object)
    return flat * n - np.array(sums, np.int64)


def _gram(fit: DataFrame, n: int, sums: list[int], wide: bool, transform) -> np.ndarray:
    """Sum of y'y over all fit rows, y = ``transform`` of the centred rows; partial sums are added up on the executors."""
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = transform(centred(batch.column("x"), n, sums, wide).astype(np.float64) / n)
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    cells = fit.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    table = cells.toArrow()  # one row for each pair of dimensions
    size = int(round(table.num_rows**0.5))
    out = np.zeros(table.num_rows)
    out[table["cell"].to_numpy()] = table["value"].to_numpy()
    assert size <= d
    return (out.reshape(size, size) + out.reshape(size, size).T) / 2


def _solved(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """y times the inverses of the upper triangular factors, one after the other."""
    for r in factors:
        y = np.linalg.solve(r.T, y.T).T
    return y


def fit_whitening(fit: DataFrame, n: int, sums: list[int], largest: int, most: int) -> Whitening:
    """Components of ``fit(x)``, n distinct rows of equal length; at most ``most``, none of a variance of zero.

    Where X has fewer independent columns than dimensions its Gram matrix has no Cholesky factor without a shift; the
    last factor is then the symmetric square root, which leaves the null space out of R.
    """
    d = len(sums)
    wide = largest * max(n, 1) >= 2**62
    factors: list[np.ndarray] = []
    eps = np.finfo(float).eps
    for turn in range(PASSES):
        gram = _gram(fit, n, sums, wide, lambda y: _solved(y, factors))  # noqa: B023
        if turn == 0:
            trace = float(np.trace(gram)) / n
            if trace == 0:
                return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0)
        shift = 11 * (n * d + d * (d + 1)) * (eps / 2) * np.linalg.norm(gram, 2)
        if turn == 0:
            gram = gram + shift * np.eye(d)
        values = np.linalg.eigvalsh(gram)
        if values[0] > 0.5 or turn == 0:
            factors.append(np.linalg.cholesky(gram).T)
        elif turn < PASSES - 1:
            factors.append(np.linalg.cholesky(gram + shift * np.eye(d)).T)
        else:
            values, vectors = np.linalg.eigh(gram)
            factors.append((vectors * np.sqrt(np.where(values > 0.5, values, 0.0))) @ vectors.T)
    product = np.eye(d)
    for r in factors:
        product = r @ product
    _, singular, right = np.linalg.svd(product)
    kept = min(most, int((singular > singular[0] * max(n, d) * d * eps).sum()))
    eigenvalues, vectors = singular[:kept] ** 2 / n, right[:kept].T
    scale = vectors / np.sqrt(eigenvalues)
    covariance = _gram(fit, n, sums, wide, lambda y: y @ scale) / n
    error = float(np.abs(covariance - np.eye(kept)).max())
    return Whitening(n, sums, vectors, eigenvalues, trace, error)


def whitened_rows(vectors: DataFrame, most: int = 16, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row for each vector and component.

    The fit list holds every different grid vector once. Rows whose vector is null, empty, of another length than most
    fit vectors (of equally common lengths the largest counts), or holds null, non-finite or off-grid entries (above
    ``LARGEST``) take no part; null and repeated ids do. Directions without variance are no components, so a table of equal vectors (or
    an empty one) gives no rows. ``deviation`` is null where it doesn't fit a long. Other columns are ignored. What reaches the driver
    are matrices of the dimension's size.
    """
    v = F.col(vector_column)
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(usable(F.col("v"))).select("vec_id", on_grid(F.col("v")).alias("x"))
    rows = stored(rows, "grid-vectors")
    fit = stored(rows.select("x").distinct(), "fit-vectors")
    sizes = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    d, n = sizes["d"], sizes["count"]
    rows, fit = rows.where(F.size("x") == d), fit.where(F.size("x") == d)
    found = (
        fit.select(F.posexplode("x").alias("i", "value")).groupBy("i")
        .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.max(F.abs("value")).alias("largest")).orderBy("i").collect()
    )  # one row for each dimension
    sums, largest = [int(r["total"]) for r in found], max(r["largest"] for r in found)
    model = fit_whitening(fit, n, sums, largest, most)
    shared = (n, sums, model.vectors / np.sqrt(model.eigenvalues), model.eigenvalues / model.trace if model.trace else model.eigenvalues, model.identity_error)
    # n * |x| bounds an entry of n * x - S by twice as much
    wide, squares = largest * n >= 2**62, d * (2 * largest * n) ** 2 >= 2**63

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, scale, explained, error = shared
        k = scale.shape[1]
        for batch in batches:
            m = batch.num_rows
            if not m or not k:
                continue
            exact = centred(batch.column("x"), n, sums, wide)
            if squares:
                total = (exact.astype(object) ** 2).sum(axis=1)
                deviation = [t if t < 2**63 else None for t in total.tolist()]
            else:
                deviation = (exact**2).sum(axis=1).tolist()
            y = (exact.astype(np.float64) / n) @ scale
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)), pa.array([t for t in deviation for _ in range(k)], pa.int64()), pa.array(y.ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
