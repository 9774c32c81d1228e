"""Whitening of embeddings: exact distributed covariance, float32 eigenvectors refined in higher precision."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.batches import bound_batches
from tidemark.llm.training import free_name
from tidemark.session import stored_copy

COMPONENTS = 4
STEPS_PER_UNIT = 256
# Entries beyond this many steps count as this many.
LARGEST = 1 << 40
ROUNDS = 12
# Products of limbs of so many bits, summed over so many rows, are exact in float64.
_LIMB, _ROWS = 20, 1024
# Products of whitened values are summed as whole multiples of this.
_GRAIN = float(1 << 40)
_Wide = np.longdouble


def grid_vectors(vectors: DataFrame, vector_col: str = "embedding", grid_col: str = "grid") -> DataFrame:
    """The rows whose vector has no null or non-finite entry, with floor(256 * entry) of each entry as long."""
    parts = F.col(vector_col).cast("array<double>")
    whole = F.forall(parts, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    cut = F.transform(parts, lambda c: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(c * float(STEPS_PER_UNIT)).cast("double"))).cast("long"))
    return vectors.where(parts.isNotNull() & whole).withColumn(grid_col, cut)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        sizes = pa.compute.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            yield int(size), _matrix(batch.column(0).filter(pa.array(sizes == size)))


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """Doubles that add up to the values when weighted by powers of 2 ** _LIMB."""
    high = values >> _LIMB
    low = values - (high << _LIMB)
    return [low.astype(np.float64), *([high.astype(np.float64)] if high.any() else [])]


def exact_gram(values: np.ndarray) -> np.ndarray:
    """The sum of outer products of the rows as Python integers; rows hold at most 42 bits."""
    total = np.zeros((values.shape[1],) * 2, object)
    for first in range(0, len(values), _ROWS):
        parts = _limbs(values[first:first + _ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total = total + (a.T @ b).astype(np.int64).astype(object) * (1 << (_LIMB * (i + j)))
    return total


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([str(v) for v in values], pa.string())


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums per dimension of a task, for each length of vector."""
    held: dict[int, list] = {}
    for size, values in _by_length(batches):
        own = held.setdefault(size, [0, np.zeros(size, object)])
        own[0] += len(values)
        for first in range(0, len(values), 1 << 20):
            own[1] = own[1] + values[first:first + (1 << 20)].sum(0).astype(object)
    for size, (n, sums) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([size] * (size + 1), pa.int32()), pa.array(range(-1, size), pa.int32()),
                                          _decimals([n, *sums])], ["size", "i", "v"])


def _grams(batches: Iterator[pa.RecordBatch], centres: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The upper triangle of the sum of outer products of a task's centred vectors, for each length."""
    held: dict[int, np.ndarray] = {}
    for size, values in _by_length(batches):
        gram = exact_gram(values - centres[size])
        held[size] = held[size] + gram if size in held else gram
    for size, gram in held.items():
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                          _decimals(list(gram[i, j]))], ["size", "i", "j", "v"])


def _wide(values: np.ndarray) -> np.ndarray:
    """Fractions or integers as extended doubles, rounded once or twice in the last bits."""
    high = np.array([float(v) for v in values.ravel()], np.float64)
    low = np.array([float(v - Fraction(h)) for v, h in zip(values.ravel(), high.tolist())], np.float64)
    return (high.astype(_Wide) + low).reshape(values.shape)


def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Places of ascending values in groups whose neighbours are no further apart than ``near``."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    return np.split(order, cuts)


def refine(matrix: np.ndarray, vectors: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors) of a symmetric matrix, from rough eigenvectors, falling.

    Each round is the correction of Ogita and Aishima, with matrix products in the precision of
    ``matrix``: X + X E, where E has (S_ij + l_j R_ij) / (l_j - l_i) of S = X'AX and R = I - X'X, or
    R_ij / 2 where the two values are too close to tell apart; it is written as R / 2 plus a part that
    changes sign with i and j, so rounding over a small gap can't harm orthogonality. Values that are too close are a cluster:
    its vectors are turned by a solve of X_J' (A - m I) X_J, whose entries are only as large as the
    cluster is wide, so float64 tells them apart; then the rounds go on.
    """
    x = vectors.astype(matrix.dtype)
    size = len(matrix)
    eye = np.eye(size, dtype=matrix.dtype)
    scale = np.abs(matrix).sum(1).max()
    least = float(np.finfo(matrix.dtype).eps)
    before, solved = np.inf, False
    for _ in range(rounds):
        r = eye - x.T @ x
        s = x.T @ (matrix @ x)
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        delta = float(2 * (np.abs(off).sum(1).max() + scale * np.abs(r).sum(1).max()))
        gap = values[None, :] - values[:, None]
        close = np.abs(gap) <= delta
        np.fill_diagonal(close, True)
        e = r / 2 + np.where(close, 0, (s + (values[None, :] + values[:, None]) / 2 * r) / np.where(close, 1, gap))
        x = x + x @ e
        size_of_e = float(np.abs(e).max())
        groups = [g for g in _clusters(values.astype(np.float64), delta) if len(g) > 1]
        # The rest of the space is settled well enough when a correction no longer reaches into a cluster.
        if groups and size_of_e < 1e-3 and not solved:
            for group in groups:
                own = x[:, group]
                own = own + own @ ((np.eye(len(group), dtype=matrix.dtype) - own.T @ own) / 2)
                middle = values[group].mean()
                small = own.T @ (matrix @ own - middle * own)
                width = np.abs(small).max()
                if width > 0:
                    x[:, group] = own @ np.linalg.eigh(((small + small.T) / (2 * width)).astype(np.float64))[1].astype(matrix.dtype)
            solved = size_of_e < 1e-9
            before = np.inf
            continue
        if size_of_e <= 8 * least or (size_of_e >= before and size_of_e < 1e-12):
            break
        before = size_of_e
    x = x / np.sqrt((x * x).sum(0))
    values = np.array([(x[:, k] @ (matrix @ x[:, k])) for k in range(size)], matrix.dtype)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


@dataclass
class Whitening:
    """Mean and leading components of the distinct grid vectors of one length, with what the fit has measured."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None


def eigen(n: int, offsets: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors, trace) of the covariance gram / n - offsets offsets' / n ** 2, exact until rounded once."""
    exact = gram * n - np.outer(offsets, offsets)
    matrix = _wide(exact) / _Wide(n) / _Wide(n)
    biggest = float(np.abs(matrix).max()) if matrix.size else 0.0
    if not biggest:
        return np.zeros(len(matrix)), np.eye(len(matrix)), 0.0
    scaled = matrix / _Wide(biggest)
    rough = np.linalg.eigh(scaled.astype(np.float32))[1]
    values, vectors = refine(scaled, rough)
    least = len(matrix) * float(np.finfo(np.float64).eps) * float(values[0])
    values = np.where(values <= least, 0, values) * _Wide(biggest)
    flip = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(matrix))])
    return values.astype(np.float64), (vectors * np.where(flip == 0, 1, flip)).astype(np.float64), float(np.trace(matrix))


def _projected(values: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened coordinates: the same for equal rows, whatever rows come with them."""
    out = np.zeros((len(values), model.vectors.shape[1]))
    scale = np.sqrt(model.values)
    for d, total in enumerate(model.sums):
        # The whole part of the mean is taken off as integers, which loses nothing.
        whole, rest = divmod(total, model.n)
        out += ((values[:, d] - whole).astype(np.float64) - rest / model.n)[:, None] * model.vectors[d][None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(scale > 0, out / scale, np.nan)


def _moments(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Sums of the whitened coordinates (j = -1) and of their products, in whole grains."""
    held: dict[int, np.ndarray] = {}
    for size, values in _by_length(batches):
        for first in range(0, len(values), 1 << 14):
            out = np.nan_to_num(_projected(values[first:first + (1 << 14)], shared.value[size]))
            k = out.shape[1]
            whole = np.concatenate([out[:, :, None], out[:, :, None] * out[:, None, :]], 2)
            made = np.array([[int(c) for c in row] for row in np.rint(whole * _GRAIN).sum(0)], object).reshape(k, k + 1)
            held[size] = held[size] + made if size in held else made
    for size, made in held.items():
        i, j = (x.ravel() for x in np.indices(made.shape))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size), pa.int32()), pa.array(i, pa.int32()), pa.array(j - 1, pa.int32()),
                                          _decimals(list(made.ravel()))], ["size", "i", "j", "v"])


def _added(parts: DataFrame, *keys: str) -> list:
    """The tasks' numbers added up for each key; the keys are places in a matrix, so they are few."""
    return parts.groupBy(*keys).agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()


def fit_whitening(grid: DataFrame, components: int = COMPONENTS, grid_col: str = "grid") -> dict[int, Whitening]:
    """A model for each length of vector, fitted on its distinct grid vectors.

    Distinct vectors are found by a combined aggregation, so a common one shrinks before the shuffle.
    Sums and, about the rounded mean, outer products are added up as integers: the covariance is exact
    in any order of the rows, and only its rounded entries (length times length) reach the driver, where
    the eigenvectors are found. The last pass measures the covariance of the whitened fit list.
    """
    spark = grid.sparkSession
    bound_batches(spark)
    fit = stored_copy(grid.select(F.col(grid_col).alias("x")).where(F.size("x") > 0).distinct(), "fit")
    found: dict[int, list[int]] = {}
    for row in _added(fit.mapInArrow(_sums, "size int, i int, v string"), "size", "i"):
        found.setdefault(row["size"], [0] * (row["size"] + 1))[row["i"] + 1] = int(row["v"])
    rounded = {size: np.array([(2 * s + n) // (2 * n) for s in sums], np.int64) for size, (n, *sums) in found.items()}
    centres = spark.sparkContext.broadcast(rounded)
    grams = {size: np.zeros((size, size), object) for size in found}
    for row in _added(fit.mapInArrow(lambda b: _grams(b, centres.value), "size int, i int, j int, v string"), "size", "i", "j"):
        grams[row["size"]][row["i"], row["j"]] = grams[row["size"]][row["j"], row["i"]] = int(row["v"])
    models = {}
    for size, (n, *sums) in found.items():
        offsets = np.array([s - n * int(c) for s, c in zip(sums, rounded[size])], object)
        values, vectors, trace = eigen(n, offsets, grams[size])
        models[size] = Whitening(n, sums, values[:components], vectors[:, :components], trace)
    shared = spark.sparkContext.broadcast(models)
    sums = {size: {} for size in models}
    for row in _added(fit.mapInArrow(lambda b: _moments(b, shared), "size int, i int, j int, v string"), "size", "i", "j"):
        sums[row["size"]][row["i"], row["j"]] = Fraction(int(row["v"]), int(_GRAIN) * models[row["size"]].n)
    for size, model in models.items():
        kept = [k for k in range(len(model.values)) if model.values[k] > 0]
        errors = [abs(float(sums[size][i, j] - sums[size][i, -1] * sums[size][j, -1]) - (i == j)) for i in kept for j in kept]
        model.identity_error = max(errors, default=None)
    return models


def _whitened(batches: Iterator[pa.RecordBatch], shared, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(at)
        sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            if int(size) not in shared.value:
                continue
            model, rows = shared.value[int(size)], np.flatnonzero(sizes == size)
            values = _matrix(column.take(pa.array(rows)))
            out, k = _projected(values, model), len(model.values)
            part = batch.take(pa.array(np.repeat(rows, k)))
            deviation = _deviations(values, model)
            flat = out.ravel()
            share = [float(e) / model.trace if model.trace > 0 else None for e in model.values]
            yield pa.RecordBatch.from_arrays([
                *part.columns, pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()), pa.array(np.full(len(flat), model.n), pa.int64()),
                pa.array([d for d in deviation for _ in range(k)], pa.int64()), pa.array(flat, mask=np.isnan(flat)),
                pa.array(share * len(rows), pa.float64()), pa.array([model.identity_error] * len(flat), pa.float64())],
                [*batch.schema.names, *WHITENED])


def _deviations(values: np.ndarray, model: Whitening) -> list[int | None]:
    """The sum over dimensions of (n * x - sum) ** 2 of each row; none where it is beyond a long."""
    far = max((max(abs(model.n * int(hi) - s), abs(model.n * int(lo) - s))
               for hi, lo, s in zip(values.max(0, initial=0), values.min(0, initial=0), model.sums)), default=0)
    if math.isqrt((1 << 62) // max(1, values.shape[1])) > far:
        gap = values * model.n - np.array(model.sums, np.int64)
        return (gap * gap).sum(1).tolist()
    exact = [sum((model.n * int(x) - s) ** 2 for x, s in zip(row, model.sums)) for row in values]
    return [e if e < 1 << 63 else None for e in exact]


WHITENED = ("component", "n", "deviation", "whitened", "explained", "identity_error")
_KINDS = (T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType())


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding") -> DataFrame:
    """For each row and component up to ``components``: component, n, deviation, whitened, explained, identity_error.

    Vectors become whole steps (floor(256 * entry)); the fit list holds each distinct one once: n of them,
    with covariance V (divisor n). Components are V's unit eigenvectors by falling eigenvalue, with their
    largest entry positive. whitened is the centred vector's part along the component over the square
    root of its eigenvalue, explained the eigenvalue over the trace, deviation the exact sum of squares of
    n * x - sum (null beyond a long), identity_error the largest entry of the fit list's whitened
    covariance minus the identity, over the components that have variance. A component without variance
    has whitened null; without any variance explained and identity_error are null too. Rows whose vector
    is null or holds null or non-finite entries are left out, and empty vectors have no components; vectors
    of another length have a fit of their own. Entries beyond LARGEST steps count as LARGEST. Rows that
    repeat are all returned; other columns pass through, but those called like a made one are replaced. An
    empty table gives no rows.
    """
    bound_batches(vectors.sparkSession)
    vectors = vectors.drop(*WHITENED)
    grid = free_name(vectors, "grid")
    rows = grid_vectors(vectors, vector_col, grid)
    shared = vectors.sparkSession.sparkContext.broadcast(fit_whitening(rows, components, grid))
    at = rows.columns.index(grid)
    schema = T.StructType([*rows.schema.fields, *map(T.StructField, WHITENED, _KINDS)])
    return rows.mapInArrow(lambda b: _whitened(b, shared, at), schema).drop(grid)
