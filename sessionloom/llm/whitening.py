"""Whitening of embeddings onto principal components found by spectral divide and conquer.

Entries become integers ``floor(scale * c) + shift``, so counts, sums and products are exact whatever the order of rows:
tasks add up products of entries from which the rounded mean was taken, and the covariance is divided once at the end.
It is a table of the squared dimension, independent of the rows, and is split on the driver:

* The polar factor of the matrix minus a shift, by QDWH (inverse-free dynamically weighted Halley steps: QR steps while
  the matrix is ill-conditioned, Cholesky steps afterwards), has eigenvalue 1 above the shift and -1 below it.
* Half of its sum with the identity projects onto the space above the shift; a few subspace steps give bases of that
  space and of its complement, and the two compressed matrices are split further until they are diagonal.
* Two correction steps on all components together settle the last digits.

Components, mean and scales (at most the squared dimension) are then sent to all tasks.

Null vectors and those with null, non-finite or enormous entries (2^36 or more in size, for which exact products are not
defined) are left out, and so are empty ones and those of another length than most (the greater length on ties).  Repeated
ids are rows of their own.  Components without variance have null in place of whitened values and explain 0.  There are
never more components than dimensions.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import free_name, written

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
MOST_ENTRY = float(2**36)
EPS = float(np.finfo(float).eps)


# ---- eigenvectors of a symmetric matrix --------------------------------------------------------------------------

def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal factor of a symmetric regular matrix by QDWH."""
    n = len(a)
    x = a / np.linalg.norm(a, 1)
    low = min(1.0, 1 / np.linalg.norm(np.linalg.inv(x), 1))  # the smallest singular value is at least this
    eye = np.eye(n)
    for _ in range(40):
        two = low * low
        d = (4 * (1 - two) / two**2) ** (1 / 3)
        p = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - two) / (two * np.sqrt(1 + d)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            f, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))
            y = q / r * x + (p - q / r) / np.sqrt(r) * f[:n] @ f[n:].T
        else:
            y = q / r * x + (p - q / r) * np.linalg.solve(eye + r * x.T @ x, x.T).T
        y = (y + y.T) / 2
        low = min(1.0, low * (p + q * two) / (1 + r * two))
        change, x = np.linalg.norm(y - x), y
        if 1 - low < 10 * EPS and change < EPS ** (1 / 3):
            break
    return x


def _halves(a: np.ndarray, shift: float, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenspaces above and below a shift; None where it doesn't separate any."""
    n = len(a)
    try:
        above = (np.eye(n) + polar_factor(a - shift * np.eye(n))) / 2
    except np.linalg.LinAlgError:
        return None
    rank = round(float(np.trace(above)))
    if not np.isfinite(above).all() or not 0 < rank < n:
        return None
    basis = above @ np.random.default_rng(n).standard_normal((n, rank))
    for _ in range(3):
        q, _ = np.linalg.qr(basis, mode="complete")
        one, two = q[:, :rank], q[:, rank:]
        if np.linalg.norm(two.T @ a @ one) <= 100 * n * EPS * size:
            return one, two
        basis = above @ one
    return None


def _split(a: np.ndarray, size: float) -> np.ndarray:
    """Eigenvectors of a symmetric matrix that is part of one of norm ``size``."""
    n = len(a)
    if n == 1 or np.linalg.norm(a - np.diag(np.diag(a))) <= EPS * size:
        return np.eye(n)
    diagonal = np.diag(a)
    spread = max(np.ptp(diagonal), np.linalg.norm(a - np.diag(diagonal)))
    # Not all eigenvalues are above the mean or below it; other shifts help where one of them is hit.
    middle = float(diagonal.mean())
    for shift in (float(np.median(diagonal)), middle, middle + 1e-3 * spread, middle - 1e-3 * spread):
        if halves := _halves(a, shift, size):
            one, two = halves
            parts = [v @ _split((b + b.T) / 2, size) for v in (one, two) for b in [v.T @ a @ v]]
            return np.hstack(parts)
    return np.eye(n)  # eigenvalues that agree to the last digits


def _corrected(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """One step towards exactly orthonormal eigenvectors of a matrix of norm 1; close eigenvalues are left as they are."""
    r, s = np.eye(len(a)) - q.T @ q, q.T @ a @ q
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    gap = values[None] - values[:, None]
    off = np.linalg.norm(s - np.diag(values)) + np.linalg.norm(r)
    apart = np.abs(gap) > max(2 * off, 1e-6)
    return q + q @ np.where(apart, (s + values[None] * r) / np.where(apart, gap, 1), r / 2)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors as columns; the largest entry of each is positive."""
    size = float(np.linalg.norm(a))
    q = np.eye(len(a)) if not size else _split(a / size, 1.0)
    for _ in range(2 if size else 0):
        q = _corrected(a / size, q)
    values = np.einsum("ij,ik,kj->j", q, a, q)
    order = np.argsort(-values, kind="stable")
    values, q = values[order], q[:, order]
    return values, q * np.where(q[np.abs(q).argmax(axis=0), np.arange(len(a))] < 0, -1.0, 1.0)


# ---- distributed sums --------------------------------------------------------------------------------------------

def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector can be used, whatever its length."""
    fine = F.forall(column, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < MOST_ENTRY))
    return vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & F.coalesce(fine, F.lit(False)))


def _entries(column: pa.Array, dimension: int, scale: int, shift: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * flat).astype(np.int64).reshape(-1, dimension) + shift


def _added(rows: DataFrame, cells: Callable[[pa.Array], np.ndarray], column: str) -> dict[int, int | float]:
    """Sums of one array of cells per batch, whole numbers exactly; as many rows as there are cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = cells(batch.column(0))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(v) for v in total.tolist()], pa.string())], names=["cell", "s"])

    exact = rows.select(column).mapInArrow(run, "cell int, s string")
    return {r["cell"]: int(r["s"]) for r in exact.groupBy("cell").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}


def _products(y: np.ndarray) -> np.ndarray:
    """Sums of products of all pairs of columns, exact."""
    upper = np.triu_indices(y.shape[1])
    most = int(np.abs(y).max(initial=0))
    step = max(1, 2**53 // max(1, most * most)) if most < 2**26 else 0
    if step:
        f = y.astype(float)
        return sum((np.rint(f[k : k + step].T @ f[k : k + step])[upper].astype(np.int64).astype(object) for k in range(0, len(f), step)), np.zeros(len(upper[0]), object))
    o = y.astype(object)
    return (o.T @ o)[upper]


# ---- the operator ------------------------------------------------------------------------------------------------

class Whitening:
    """Exact mean, components and scales of a fit list; its size depends on the dimension alone."""

    def __init__(self, n: int, sums: list[int], products: list[int], components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> None:
        self.n, self.dimension, self.scale, self.shift = n, len(sums), scale, shift
        self.centre = [(2 * s + n) // (2 * n) for s in sums]  # rounded means
        self.rest = [s - n * m for s, m in zip(sums, self.centre)]  # n times what the rounded mean lacks
        self.covariance = np.zeros((self.dimension, self.dimension))
        for (i, j), p in zip(zip(*np.triu_indices(self.dimension)), products):
            self.covariance[i, j] = self.covariance[j, i] = (n * p - self.rest[i] * self.rest[j]) / (n * n)
        values, vectors = eigen(self.covariance)
        self.trace = float(np.trace(self.covariance))
        k = min(components, self.dimension)
        floor = self.dimension * EPS * max(float(values[0]), 0.0)
        self.values = np.where(values[:k] > floor, values[:k], 0.0)
        self.vectors = vectors[:, :k]
        self.explained = (self.values / self.trace if self.trace else np.zeros(k)).tolist()


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """Whitening of all usable vectors; None where there are none."""
    rows = usable(vectors, column).select(F.col(column).cast("array<double>").alias("v"))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return None
    d, n = most["d"], most["count"]
    rows = rows.where(F.size("v") == d)
    # A batch has well under 2^16 rows and entries are below 2^47, so its sums fit.
    sums = _added(rows, lambda v: _entries(v, d, scale, shift).sum(axis=0).astype(object), "v")
    sums = [sums[i] for i in range(d)]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    products = _added(rows, lambda v: _products(_entries(v, d, scale, shift) - centre), "v")
    return Whitening(n, sums, [products[i] for i in range(d * (d + 1) // 2)], components, scale, shift)


def whiten(vectors: DataFrame, model: Whitening | None, column: str = "embedding") -> DataFrame:
    """Usable rows with all columns, ``whitened`` (one entry per component) and ``deviation``; such columns are replaced.

    ``deviation`` is the sum over dimensions of ``(n * x - sum)`` squared, exact; null where it has over 38 digits.
    """
    kept = vectors.drop("whitened", "deviation")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", whitened array<double>, deviation decimal(38,0)"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = usable(kept, column).where(F.size(column) == model.dimension)
    name, names, n = free_name(kept, "entries"), kept.columns, model.n
    centre, rest = np.array(model.centre, np.int64), model.rest
    lacking, empty = np.array([r / n for r in rest]), model.values == 0
    map_to = np.where(empty, 0.0, model.vectors / np.sqrt(np.where(empty, 1.0, model.values)))

    def deviations(y: np.ndarray) -> pa.Array:
        most = int(np.abs(y).max(initial=0)) * n + max(map(abs, rest), default=0)
        if y.shape[1] * most * most < 2**63:
            return pa.array(((n * y - np.array(rest, np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        exact = ((n * y.astype(object) - np.array(rest, object)) ** 2).sum(axis=1).tolist()
        return pa.array([str(v) if v < 10**38 else None for v in exact], pa.string()).cast(pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _entries(batch.column(name), model.dimension, model.scale, model.shift) - centre
            white = (y - lacking) @ map_to
            k = white.shape[1]
            values = pa.array(white.ravel(), mask=np.tile(empty, len(white)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1, dtype=np.int32) * k), values)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists, deviations(y)], names=[*names, "whitened", "deviation"])

    return rows.withColumn(name, F.col(column).cast("array<double>")).mapInArrow(run, schema)


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, over components with variance."""
    at = [i for i, v in enumerate(model.values) if v > 0]
    if not at:
        return 0.0
    entry = [F.get("whitened", F.lit(i)) for i in at]
    means = whitened.agg(*[F.avg(e) for e in entry]).first()
    pairs = [(i, j) for i in range(len(at)) for j in range(i, len(at))]
    found = whitened.agg(*[F.avg((entry[i] - means[i]) * (entry[j] - means[j])) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found))


def components_of(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component, with the share of variance explained and the error over all rows."""
    model = fit(vectors, column, components)
    white = whiten(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).alias("embedding")), model)
    if model is None:
        error, explained, n = 0.0, [0.0], 0
    else:
        white = written(white.drop("embedding"), "whitened")
        error, explained, n = identity_error(white, model), model.explained, model.n
    share: Column = F.get(F.array(*[F.lit(e) for e in explained]), F.col("component") - 1)
    rows = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return rows.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
