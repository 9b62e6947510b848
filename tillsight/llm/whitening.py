"""Whitening of embeddings: principal components to double precision by mixed-precision refinement.

An entry c becomes the whole number floor(256 * c).  The fit list holds each distinct vector of whole
numbers once.  Its sums are exact; its covariance is summed from centred vectors, one matrix a task,
and these are added up in two levels, band by band.  The driver holds one matrix of dimensions x dimensions.

``eigen`` takes the eigenvectors of that matrix in float32 and corrects them in double by the
Ogita-Aishima iteration: from R = I - X'X and S = X'AX follow the eigenvalues and a correction E of
X, four matrix products a round, with an error that squares each time.  Eigenvalues that lie closer
together than the present error can't be told apart by it: each such cluster is solved by itself, as a
small shifted eigenproblem in the space of its own vectors, and the iteration goes on from there.

Then every row is projected; the whitened fit list's covariance is measured, not assumed.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped, and those of
another length than the most frequent one (of equally frequent ones the longest).  Null ids and repeated rows are rows like
any other.  Entries whose whole number is beyond a long have the nearest long.  Fewer dimensions than components give
as many components.  A component without variance (an eigenvalue at rounding level) has null ``whitened``, and
``explained`` is null if nothing varies.  ``deviation`` is null where it is beyond a long.  An empty table gives an empty
result.  Only id and vector are read, under names of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tillsight.llm.batches import bounded_batches
from tillsight.session import stored

SCALE = 256
COMPONENTS = 4
#: Matrix rows of one band, and groups of tasks whose bands are added first.
BAND, FIRST_LEVEL = 64, 32
MOST_ROUNDS = 30
EPS = float(np.finfo(np.float64).eps)


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of values, in order, whose neighbours are at most ``gap`` apart."""
    order = np.argsort(values, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(values[order]) > gap) + 1)


def solved_within(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The vectors ``x`` of one cluster, turned within the space they span into eigenvectors there."""
    q, _ = np.linalg.qr(x)
    ax = a @ q
    shift = float(np.einsum("ij,ij->", q, ax)) / q.shape[1]
    inner = q.T @ (ax - shift * q)  # small beside ``a``: the differences in the cluster keep their digits
    return q @ np.linalg.eigh((inner + inner.T) / 2)[1]


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    size = float(np.abs(covariance).max(initial=0.0))
    n = len(covariance)
    if not size:
        return np.zeros(n), np.eye(n)
    a = (covariance + covariance.T) / (2 * size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    norm, before = np.linalg.norm(a, 2), np.inf
    for _ in range(MOST_ROUNDS):
        r = np.eye(n) - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        error = 2 * (np.linalg.norm(off, 2) + norm * np.linalg.norm(r, 2))
        gaps = values[None, :] - values[:, None]
        least = max(error, 64 * n * EPS * norm)  # closer values can't be told apart, with rounding at least
        apart = np.abs(gaps) > least
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1.0), r / 2)
        x = x + x @ e
        together = [c for c in clusters(values, least) if len(c) > 1]
        for c in together:
            x[:, c] = solved_within(a, x[:, c])
        step = np.abs(e).max()
        if step <= EPS**0.5 and not together:  # the error left is the square of that
            break
        if error <= 8 * n * EPS * norm and step > before / 2:  # at rounding level: what is still together is one eigenvalue
            break
        before = step
    for _ in range(2):
        x = x @ (1.5 * np.eye(n) - x.T @ x / 2)  # orthogonal to rounding
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.linalg.norm(x[:, order], axis=0)
    return values[order] * size, x


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows of the fit list and its exact sum by dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(dims, object), 0
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            safe = not len(x) or int(np.abs(x.astype(np.float64)).max()) * len(x) < 1 << 61
            total, rows = total + (x.sum(axis=0) if safe else x.astype(object).sum(axis=0)).astype(object), rows + len(x)
        if rows:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(-1, dims), pa.int32()), "s": [str(rows), *map(str, total)]})

    parts = fit.mapInArrow(add, "at int, s string")
    got = {r.at: int(r.s) for r in parts.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return got.get(-1, 0), [got.get(d, 0) for d in range(dims)]


def _covariance(fit: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    dims = len(mean)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((dims, dims)), False
        for batch in batches:
            y = _matrix(batch.column(0), dims) - mean
            total, any_rows = total + y.T @ y, any_rows or len(y) > 0
        if any_rows:
            task = TaskContext.get().partitionId()
            for at in range(0, dims, BAND):
                yield pa.RecordBatch.from_pydict({"band": pa.array([at], pa.int32()), "part": pa.array([task % FIRST_LEVEL], pa.int32()),
                                                  "m": pa.array([total[at : at + BAND].tobytes()], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m.as_py()) for m in group.column("m"))
        return pa.table({"band": group.column("band")[:1], "part": group.column("part")[:1], "m": pa.array([total.tobytes()], pa.binary())})

    schema = "band int, part int, m binary"
    bands = fit.mapInArrow(products, schema).groupBy("band", "part").applyInArrow(add, schema).groupBy("band").applyInArrow(add, schema)
    rows = sorted((r.band, r.m) for r in bands.collect())  # dimensions x dimensions in all
    return np.concatenate([np.frombuffer(m) for _, m in rows]).reshape(dims, dims) / n


def _identity_error(fit: DataFrame, n: int, mean: np.ndarray, turn: np.ndarray) -> float | None:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    dims, k = turn.shape
    if not k:
        return None

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = (_matrix(batch.column(0), dims) - mean) @ turn
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(total.size), pa.int32()), "s": total.ravel()})

    got = {r.at: r.s for r in fit.mapInArrow(moments, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()}
    total = np.array([got[i] for i in range((k + 1) * k)]).reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over the dimensions of (n * x - sum)**2."""
    about = ((x.astype(np.float64) * n - np.array(sums, np.float64)) ** 2).sum(axis=1)
    # sums modulo 2**64 are exact where the result is below 2**63
    wrap = lambda v: np.uint64(v % (1 << 64))
    y = x.astype(np.uint64) * wrap(n) - np.array([wrap(s) for s in sums], np.uint64)
    out = (y * y).sum(axis=1, dtype=np.uint64).astype(object)
    for i in np.flatnonzero(about > 2.0**62).tolist():
        exact = sum((n * int(c) - s) ** 2 for c, s in zip(x[i], sums))
        out[i] = exact if exact < 1 << 63 else None
    return out.tolist()


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), one row for each usable row and component."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    id_field = StructField(id_col, vectors.schema[id_col].dataType)
    schema = StructType([id_field, StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()),
                         StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType())])
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where("v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dims = lengths[0]["d"]
    top = 2.0**63
    whole = lambda c: F.when(c * SCALE >= top, (1 << 63) - 1).when(c * SCALE < -top, -(1 << 63)).otherwise(F.floor(c * SCALE))
    rows = rows.where(F.size("v") == dims).select("id", F.transform("v", whole).alias("x"))
    fit = stored(rows.select("x").distinct(), "whitening-fit")

    n, sums = _sums(fit, dims)
    mean = np.array([s / n for s in sums])
    covariance = _covariance(fit, n, mean)
    values, turn = eigen(covariance)
    trace, k = float(np.trace(covariance)), min(components, dims)
    sound = values[:k] > dims * EPS * max(trace, 0.0)
    scaled = turn[:, :k] / np.sqrt(np.where(sound, values[:k], 1.0))
    error = _identity_error(fit, n, mean, scaled[:, sound])
    explained = [float(e / trace) if trace > 0 else None for e in values[:k]]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = schema.names
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            m = len(x)
            w = (x - mean) @ scaled
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)), pa.array([d for d in deviations(x, n, sums) for _ in range(k)], pa.int64()),
                pa.array(w.ravel(), pa.float64(), mask=np.tile(~sound, m)), pa.array(explained * m, pa.float64()),
                pa.array([error] * (m * k), pa.float64())], names)

    return rows.mapInArrow(project, schema)
