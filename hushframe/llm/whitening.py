"""Whitened principal components of a table of vectors.

`whiten(vectors)` drops vectors that are null or hold null or non-finite entries and turns each other entry c into the
whole number floor(1024 c) + 100000. All statistics are over these vectors, in passes whose tasks give one sum per cell
of the statistic; Spark adds the cells up:

1. number and sums (exact), 2. covariance of the centred vectors (divisor n), 3. covariance of the whitened rows, which
must be the identity.

Between them the driver works on one d x d matrix (d is the vectors' length, whatever the number of rows): Householder
reflections make it tridiagonal, Sturm counts bisect its leading eigenvalues, inverse iteration gives their vectors,
orthogonalised again within clusters, and the reflections turn them back. Sums and components are broadcast (16 d k bytes).

Defined results: rows come once per component, `components` at most. Components without variance (an eigenvalue within
rounding of zero: fewer vectors than dimensions, constant entries) cannot be whitened and are left out; a table where
nothing is left gives no rows. Vectors must have one length: the one that most rows have (the larger on a tie); others
are dropped like broken ones, and so are empty vectors. Equal eigenvalues span a plane of which any orthonormal basis is
right; one is chosen, the same for all rows. A component's entry of largest size is positive. Repeated rows and ids count
and stay as rows of their own, null ids too; further columns are not read. Entries beyond 2^62 / 1024 count as that.
`deviation` is exact and null beyond 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
FACTOR = 1024
SHIFT = 100_000
#: Eigenvalues nearer to each other than this part of the matrix norm have their vectors orthogonalised together.
CLUSTER = 1e-3
BIAS = float(1 << 62)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, side diagonal and the unit vectors of the reflections (the k-th acts on entries k + 1 and on)."""
    a = np.array(matrix, np.float64)
    d = len(a)
    mirrors = []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x[1:]).max()
        v = np.zeros(d - k - 1)
        if scale > 0:
            v = x / max(scale, abs(x[0]))
            v[0] += np.copysign(np.linalg.norm(v), v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k + 1 :]
            w = rest @ v
            w -= (v @ w) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1 :, k] = x - 2 * (v @ x) * v
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def counts_below(diagonal: np.ndarray, side: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues are less than each point: negative pivots of a Sturm sequence."""
    least = np.finfo(np.float64).tiny * max(1.0, float((side**2).max(initial=0)))
    pivot = diagonal[0] - points
    count = (pivot < 0).astype(np.int64)
    for value, beside in zip(diagonal[1:], side):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = value - points - beside * beside / pivot
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, side: np.ndarray, k: int) -> np.ndarray:
    """The k largest, falling, each bisected until its bounds are neighbours."""
    around = np.concatenate([[0], np.abs(side)]) + np.concatenate([np.abs(side), [0]])
    low, high = float((diagonal - around).min()), float((diagonal + around).max())
    wide = 1e-12 * max(abs(low), abs(high)) + np.finfo(np.float64).tiny
    below, above = np.full(k, low - wide), np.full(k, high + wide)
    rank = len(diagonal) - np.arange(k)  # the i-th largest has this many at or below it
    while True:
        middle = (below + above) / 2
        if not ((middle > below) & (middle < above)).any():
            return middle
        high_side = counts_below(diagonal, side, middle) >= rank
        inside = (middle > below) & (middle < above)
        above, below = np.where(high_side & inside, middle, above), np.where(~high_side & inside, middle, below)


def solve_shifted(diagonal: np.ndarray, side: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges; a pivot of zero becomes a tiny one."""
    d = len(diagonal)
    tiny = np.finfo(np.float64).eps * (np.abs(diagonal).max() + np.abs(side).max(initial=0)) or np.finfo(np.float64).tiny
    rows, x = [], right.astype(np.float64).copy()
    row = (diagonal[0] - shift, side[0] if d > 1 else 0.0, 0.0)
    for i in range(d - 1):
        under = (side[i], diagonal[i + 1] - shift, side[i + 1] if i + 2 < d else 0.0)
        if abs(under[0]) > abs(row[0]):
            row, under = under, row
            x[i], x[i + 1] = x[i + 1], x[i]
        pivot = row[0] or tiny
        factor = under[0] / pivot
        rows.append((pivot, row[1], row[2]))
        row = (under[1] - factor * row[1], under[2] - factor * row[2], 0.0)
        x[i + 1] -= factor * x[i]
    rows.append((row[0] or tiny, 0.0, 0.0))
    for i in range(d - 1, -1, -1):
        pivot, first, second = rows[i]
        x[i] -= (first * x[i + 1] if i + 1 < d else 0) + (second * x[i + 2] if i + 2 < d else 0)
        x[i] /= pivot
        if abs(x[i]) > 1e200:
            x[i:] /= 1e200
            x[:i] /= 1e200
    return x / np.abs(x).max()


def eigenvectors(diagonal: np.ndarray, side: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Inverse iteration; the vectors of a cluster are kept orthogonal in every step."""
    d = len(diagonal)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(side).max(initial=0))
    rng = np.random.default_rng(7)
    found: list[np.ndarray] = []
    shift = np.inf
    first = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER * norm:
            first = i
        shift = value if i == first else min(value, shift - 4 * np.finfo(np.float64).eps * norm)
        x = rng.standard_normal(d)
        for _ in range(5):
            x = solve_shifted(diagonal, side, shift, x / np.linalg.norm(x))
            for _ in range(2):
                for other in found[first:i]:
                    x -= (other @ x) * other
            x /= np.linalg.norm(x)
        found.append(x)
    return np.array(found)


def principal_components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues, falling, and their unit eigenvectors as rows."""
    size = float(np.abs(covariance).max())
    diagonal, side, mirrors = tridiagonal(covariance / size)
    values = leading_eigenvalues(diagonal, side, k)
    vectors = eigenvectors(diagonal, side, values)
    for j in range(len(mirrors) - 1, -1, -1):
        v = mirrors[j]
        vectors[:, j + 1 :] -= 2 * np.outer(vectors[:, j + 1 :] @ v, v)
    largest = np.abs(vectors).argmax(axis=1)
    vectors *= np.sign(vectors[np.arange(k), largest])[:, None]
    return values * size, vectors


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries as doubles (null as nan), the length of each vector (-1: null) and where each begins."""
    lengths = np.array(column.value_lengths().fill_null(-1), np.int64)
    flat = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    return flat, lengths, np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)


def whole_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows remain, and their entries as whole numbers."""
    flat, lengths, starts = _entries(column)
    rows = np.flatnonzero(lengths == dim)
    values = flat[starts[rows][:, None] + np.arange(dim)]
    good = np.isfinite(values).all(axis=1)
    return rows[good], np.floor(np.clip(FACTOR * values[good], -BIAS, BIAS)).astype(np.int64) + SHIFT


def squares(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Per row the exact sum of (n x - S)^2."""
    mean = [s // n for s in sums.tolist()]
    offset = np.array([s - m * n for s, m in zip(sums.tolist(), mean)], object)
    base = np.array(mean, np.int64)
    difference = x - base
    most = max(int(np.abs(difference).max(initial=0)), 1) * n + n
    if most * most * x.shape[1] < 1 << 63:
        d = n * difference - offset.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    if most < 1 << 62:  # three parts of 21 bits: their products cannot overflow, and only the sums per row grow long
        d = np.abs(n * difference - offset.astype(np.int64))
        parts = [(d >> shift) & ((1 << 21) - 1) for shift in (0, 21, 42)]
        total = [0] * len(x)
        for i in range(3):
            for j in range(3):
                low, high = (parts[i] * parts[j]) & 0xFFFFFFFF, (parts[i] * parts[j]) >> 32
                each = zip(low.sum(axis=1).tolist(), high.sum(axis=1).tolist())
                total = [t + ((a + (b << 32)) << 21 * (i + j)) for t, (a, b) in zip(total, each)]
        return [t if t < 10**38 else None for t in total]
    d = (n * difference.astype(object) - offset) ** 2
    return [t if t < 10**38 else None for t in d.sum(axis=1).tolist()]


def _cells(vectors: DataFrame, sums_of, schema: str) -> DataFrame:
    """One partial sum per cell and task, by `sums_of(column)` for each batch."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = sums_of(batch.column(0))
            held = new if held is None else [a + b for a, b in zip(held, new)]
        if held is not None:
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(held[0])), pa.int64()), *map(pa.array, held)], names)

    return vectors.mapInArrow(partial, schema)


def dimension(vectors: DataFrame, vector: Column) -> int:
    """The length that most vectors have."""
    found = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    first = found.orderBy(F.desc("n"), F.desc("d")).first()
    return first["d"] if first else 0


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained and identity_error of every remaining vector."""
    spark = vectors.sparkSession
    column = F.col(f"`{embedding}`").cast("array<double>").alias("v")
    read = vectors.select(column)
    dim = dimension(vectors, column)
    kind = vectors.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    nothing = spark.createDataFrame([], schema)
    if dim == 0:
        return nothing

    def totals(batch: pa.Array) -> list[np.ndarray]:
        rows, x = whole_vectors(batch, dim)
        return [np.full(dim, len(rows)), (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)]

    cells = _cells(read, totals, "cell long, n long, high long, low long").groupBy("cell")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    rows = cells.agg(F.sum("n").alias("n"), *wide).orderBy("cell").collect()  # one row per dimension
    n = rows[0]["n"] if rows else 0
    if n == 0:
        return nothing
    sums = np.array([(int(r["high"]) << 31) + int(r["low"]) for r in rows], object)
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - int(b) * n) / n for s, b in zip(sums, base)])

    def centred(batch: pa.Array) -> np.ndarray:
        return (whole_vectors(batch, dim)[1] - base).astype(np.float64) - rest

    def products(batch: pa.Array) -> list[np.ndarray]:
        x = centred(batch)
        return [(x.T @ x)[np.tril_indices(dim)]]

    found = _cells(read, products, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    covariance = np.zeros((dim, dim))
    covariance[np.tril_indices(dim)] = [r["value"] / n for r in found.orderBy("cell").collect()]  # d (d + 1) / 2 cells
    covariance = covariance + np.tril(covariance, -1).T
    trace = float(np.trace(covariance))
    values, basis = principal_components(covariance, min(components, dim)) if trace > 0 else (np.zeros(0), np.zeros((0, dim)))
    some = values > 16 * dim * np.finfo(np.float64).eps * trace
    values, basis = values[some], basis[some]
    k = len(values)
    if k == 0:
        return nothing
    scaled = basis / np.sqrt(values)[:, None]

    def whitened_products(batch: pa.Array) -> list[np.ndarray]:
        w = centred(batch) @ scaled.T
        return [np.concatenate([w.sum(axis=0), (w.T @ w)[np.tril_indices(k)]])]

    found = _cells(read, whitened_products, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    sums_w = np.array([r["value"] / n for r in found.orderBy("cell").collect()])
    second = sums_w[k:] - (sums_w[:k, None] * sums_w[None, :k])[np.tril_indices(k)]
    error = float(np.abs(second - np.eye(k)[np.tril_indices(k)]).max())
    explained = values / trace
    names = [c.split()[0] for c in schema.split(", ")]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole_vectors(batch.column(1), dim)
            if not len(rows):
                continue
            w = ((x - base).astype(np.float64) - rest) @ scaled.T
            of = np.repeat(np.arange(len(rows)), k)
            deviation = pa.array(squares(x, n, sums), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)).take(pa.array(of)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(of), n, np.int64)),
                    deviation.take(pa.array(of)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, len(rows))),
                    pa.array(np.full(len(of), error)),
                ],
                names,
            )

    return vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), column).mapInArrow(rows_of, schema)
