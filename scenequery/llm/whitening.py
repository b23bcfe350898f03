"""Whitening of embeddings by a pivoted Cholesky factor of their scatter and one-sided Jacobi rotations of that factor.

Vectors are whole numbers here, so sums are exact and do not depend on how rows are spread over tasks: distinct vectors are counted
and added up, then their scatter is added up around the whole numbers nearest to the mean, and what these differ from the mean is
taken off. Only such sums, of the size of the dimensions squared, reach the driver, a task's rows as partial sums first.

The scatter V = L L' is factored with the largest remaining diagonal entry as pivot, so a scatter of lower rank simply gives fewer
columns. Jacobi rotations then make the columns of L orthogonal: L J = U S. Their squared norms are the eigenvalues of V and their
directions its eigenvectors; V itself is never multiplied again, which keeps small eigenvalues accurate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from . import common, vectors

SCALE, COMPONENTS = 64, 16
RANK_TOLERANCE = 1e-13  # of the largest diagonal entry: pivots below count as zero
MOST_SWEEPS = 60
ADDED = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L L', a column for each unit of v's rank; the largest remaining diagonal entry is the pivot of each step."""
    n = len(v)
    left, columns = np.diag(v).astype(float), []
    least = RANK_TOLERANCE * max(left.max(initial=0), 0)
    done = np.zeros(n, bool)
    for _ in range(n):
        p = int(np.argmax(np.where(done, -np.inf, left)))
        if left[p] <= least:
            break
        column = v[:, p] - sum((c * c[p] for c in columns), np.zeros(n))
        column[done] = 0.0
        column /= np.sqrt(column[p])
        columns.append(column)
        done[p] = True
        left = left - column**2
    return np.array(columns).T if columns else np.zeros((n, 0))


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of factor * factor', from rotations that make its columns orthogonal.

    The columns meet in rounds of disjoint pairs, so that all rotations of a round are done at once.
    """
    a = factor.copy()
    n = a.shape[1]
    ring = list(range(n)) + [-1] * (n % 2)
    half = len(ring) // 2
    enough = 1e-15 * np.sqrt(len(a))
    for _ in range(MOST_SWEEPS):
        largest = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(min(x, y), max(x, y)) for x, y in zip(ring[:half], ring[half:][::-1], strict=True) if x >= 0 and y >= 0]
            p, q = np.array([x for x, _ in pairs], int), np.array([y for _, y in pairs], int)
            alpha, beta, gamma = (a[:, p] ** 2).sum(0), (a[:, q] ** 2).sum(0), (a[:, p] * a[:, q]).sum(0)
            size = np.sqrt(alpha * beta)
            angle = np.divide(np.abs(gamma), size, out=np.zeros_like(size), where=size > 0)
            largest = max(largest, angle.max(initial=0))
            turn = angle > 1e-16
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta)), 0.0)
            c = 1 / np.sqrt(1 + t**2)
            s = c * t
            a[:, p], a[:, q] = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
            ring[1:] = [ring[-1], *ring[1:-1]]
        if largest < enough:
            break
    norms = np.sqrt((a**2).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, a[:, order] / norms[order]


# ---- sums over tasks -------------------------------------------------------------------------------------------------------


def _added(rows: DataFrame, of: Callable[[list[bytes]], np.ndarray], dims: int) -> list[np.ndarray]:
    """Sums of arrays of whole numbers or doubles over all rows: a partial one from each task, then from each of a few, then here."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = of(batch.column(0).to_pylist())
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([str(total.dtype)])], names=["part", "kind"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = None, None
        for batch in batches:
            for part, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(part, kind)
                total = found.copy() if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([kind])], names=["part", "kind"])

    parts = rows.mapInArrow(common.lean(partial), "part binary, kind string")
    few = max(1, int(common.partitions(rows.sparkSession) ** 0.5))
    return [np.frombuffer(r["part"], r["kind"]) for r in parts.repartition(few).mapInArrow(merged, "part binary, kind string").collect()]


class Whitening:
    """What a fit finds: n, centre and rest (the mean is centre + rest / n), eigenvalues, components as columns, trace, identity_error."""

    def __init__(self, n: int, centre: np.ndarray, rest: np.ndarray, values: np.ndarray, components: np.ndarray, trace: float):
        self.n, self.centre, self.rest, self.values, self.components, self.trace, self.identity_error = n, centre, rest, values, components, trace, 0.0
        self.to = components / np.sqrt(values) if len(values) else components

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) - self.rest / max(self.n, 1)) @ self.to

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; none where it is beyond a long."""
        y = x - self.centre
        if not y.size or float(np.abs(y).max()) * self.n < 2.0**62:
            z = y * self.n - self.rest
            if not z.size or float(np.abs(z).max()) ** 2 * z.shape[1] < 2.0**62:
                return (z * z).sum(1).tolist()
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest.tolist(), strict=True)) for row in y.tolist()]
        return [e if e < 2**63 else None for e in exact]


def fit(distinct: DataFrame, dims: int, components: int) -> Whitening:
    """Whitening by the first ``components`` components of ``distinct``: one column of packed vectors, each once."""
    parts = _added(distinct, lambda rows: np.concatenate([[len(rows)], vectors.unpacked(rows, dims).sum(0)]), dims)
    total = [sum(int(p[i]) for p in parts) for i in range(dims + 1)] if parts else [0] * (dims + 1)
    n, sums = total[0], total[1:]
    nearest = [(2 * s + n) // (2 * n) if n else 0 for s in sums]
    centre, rest = np.array(nearest, np.int64), np.array([s - n * c for s, c in zip(sums, nearest, strict=True)], np.int64)

    def scatter(rows: list[bytes]) -> np.ndarray:
        y = vectors.unpacked(rows, dims) - centre
        if float(np.abs(y).max(initial=0)) ** 2 * len(rows) < 2.0**53:  # whole numbers that doubles add up exactly
            y = y.astype(np.float64)
            return (y.T @ y).ravel()
        y = y.astype(np.float64) - rest / n
        return (y.T @ y + len(rows) * np.outer(rest / n, rest / n)).ravel()

    gathered = _added(distinct, scatter, dims) if n and dims else []
    v = sum(gathered, np.zeros(dims * dims)).reshape(dims, dims) / max(n, 1) - np.outer(rest / max(n, 1), rest / max(n, 1))
    values, directions = one_sided_jacobi(pivoted_cholesky(v))
    found = Whitening(n, centre, rest, values[:components], directions[:, :components], float(np.trace(v)))
    if len(found.values):

        def moments(rows: list[bytes]) -> np.ndarray:
            w = found.whitened(vectors.unpacked(rows, dims))
            return np.concatenate([w.sum(0), (w.T @ w).ravel()])

        k = len(found.values)
        sums = sum(_added(distinct, moments, dims), np.zeros(k + k * k))
        mean = sums[:k] / n
        found.identity_error = float(np.abs(sums[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    return found


def whiten(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Each usable row ``components`` times, with component (from 1), n, deviation, whitened, explained and identity_error.

    An entry c counts as floor(scale * c); a shift common to all entries would change none of the results. Rows whose vector is null or holds nulls or values that are not finite go. The fit
    is on the distinct vectors, so copies weigh nothing; every remaining row is projected, copies and rows with null keys too.
    Shorter vectors are filled up with zeros to the longest. A scatter of lower rank has fewer components, and so fewer rows: one
    vector, or none, gives no rows at all. Columns of the names above are replaced, all others stay but the vector. deviation is
    null where it is beyond a long; an entry beyond 2 to the power 62 is an error.
    """
    spark = rows.sparkSession
    common.small_batches(spark)
    kept = [c for c in rows.columns if c != column and c not in ADDED]
    clean = vectors.usable(rows, column).select(*kept, F.col(column).alias("_vector"))
    dims = vectors.longest(clean, "_vector")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(vectors.packed(vectors.floored(vectors.matrix(batch.column(0), dims), scale)), pa.binary())], names=["x"])

    distinct, path = common.staged_at(clean.select("_vector").mapInArrow(common.lean(pack), "x binary").distinct(), "vectors")
    model = fit(distinct, dims, components)
    common.discard(spark, [path])
    k = len(model.values)
    explained = (model.values / model.trace).tolist() if k else []
    schema = StructType([*clean.select(*kept).schema.fields])
    for name, kind in zip(ADDED, (IntegerType(), LongType(), LongType(), DoubleType(), DoubleType(), DoubleType()), strict=True):
        schema = schema.add(name, kind)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.floored(vectors.matrix(batch.column(batch.num_columns - 1), dims), scale)
            times = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [c.take(times) for c in batch.columns[:-1]]
            columns += [pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(x) * k, model.n), pa.int64())]
            columns += [pa.array(model.deviations(x), pa.int64()).take(times), pa.array(model.whitened(x).ravel(), pa.float64())]
            columns += [pa.array(np.tile(explained, len(x)), pa.float64()), pa.array(np.full(len(x) * k, model.identity_error), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return clean.mapInArrow(common.lean(project), schema)


def op11_cholesky_jacobi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened: vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
