"""Embedding whitening by mixed-precision refinement.

The covariance of all distinct vectors is summed where the rows are, on whole numbers, exactly. Its eigenvectors are taken in
single precision and corrected by the iteration of Ogita and Aishima, matrix multiplications only, in extended precision: with
R = I - X'X and S = X'AX, values s_ii / (1 - r_ii), and X + XE, where e_ij = (s_ij + l_j r_ij) / (l_j - l_i) if the two values are apart by
more than the bound on their error, and r_ij / 2 if not. Each step squares the error. Values that aren't apart form a cluster: its
vectors span the right space, and are turned within it by a sub-solve of X'(A - mI)X, a small matrix whose differences aren't hidden by the
cluster's own size any more, by the same method.

Defined results: rows whose vector is null or holds null or non-finite entries go; shorter vectors are padded with zeros; rows that repeat,
and vectors that become equal as whole numbers, count once for the covariance and each get their rows; a component whose variance is zero has a null
in ``whitened`` and doesn't count for ``identity_error``, which is 0 without any other; an entry beyond a long becomes the largest or
smallest long; a deviation beyond a long is null in the query; an empty table, or vectors without entries, give no rows; other columns can have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.shared import drop_stages, mark

from .common import materialise
from .vectors import exact_sums, gram, integers, largest, matrix

SCALE, COMPONENTS, STEPS = 256, 4, 20
LONG = np.longdouble


def correct(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One step: better vectors, their values, the least gap that tells two values apart, and how much was changed."""
    eye = np.eye(len(a), dtype=a.dtype)
    r = eye - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # else rounding, over a narrow gap, would turn vectors of a cluster towards each other
    values = np.diag(s) / (1 - np.diag(r))
    size = lambda m: np.sqrt((m * m).sum())  # noqa: E731  no less than the spectral norm
    apart = 2 * (size(s - np.diag(values)) + size(a) * size(r))
    gap = values[None, :] - values[:, None]
    clear = np.abs(gap) > apart
    e = np.where(clear, (s + values[None, :] * r) / np.where(clear, gap, 1), r / 2)
    return x + x @ e, values, float(apart), float(np.abs(e).max())


def eigen(a: np.ndarray, start: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of a symmetric matrix in its own precision, from vectors in that of ``start``."""
    n, scale = len(a), np.abs(a).max(initial=0)
    if n < 2 or scale == 0:
        return np.diag(a).copy(), np.eye(n, dtype=a.dtype)
    a = a / scale
    x = np.linalg.eigh(a.astype(start))[1].astype(a.dtype)
    precise = np.finfo(a.dtype).eps
    for _ in range(STEPS):
        x, values, apart, change = correct(a, x)
        if change <= 4 * precise:
            break
    order = np.argsort(values)
    values, x = values[order], x[:, order]
    cuts = [0, *(np.flatnonzero(np.diff(values) > apart) + 1), n]
    for i, j in zip(cuts, cuts[1:]):
        if j - i < 2:
            continue
        v, middle = x[:, i:j], values[i:j].mean()
        inner = v.T @ (a @ v - middle * v)
        inner = (inner + inner.T) / 2
        size = np.abs(inner).max()
        if size <= 4 * n * precise:  # one value, as far as can be told: any basis will do
            continue
        if size <= 0.5:
            x[:, i:j] = v @ eigen(inner, start)[1]
        elif start is np.float32:  # values that differ, but not by more than single precision's error
            x[:, i:j] = v @ eigen(inner, np.float64)[1]
    x = x + x @ (np.eye(n, dtype=a.dtype) - x.T @ x) / 2
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


@dataclass
class Whitening:
    """n vectors with sums S; values, vectors (by column) and the trace of their covariance; positive: how many values aren't zero."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    positive: int

    def project(self, x: np.ndarray, components: int) -> np.ndarray:
        """Whitened coordinates of rows x; not a number where a component has no variance."""
        near = [round(Fraction(s, self.n)) for s in self.sums]  # whole numbers first, which subtract exactly
        rest = np.array([float(Fraction(s, self.n) - m) for s, m in zip(self.sums, near, strict=True)])
        exact = largest(x) + max(map(abs, near), default=0) < 1 << 62
        centred = (x - np.array(near, np.int64) if exact else (x.astype(object) - np.array(near, object)).astype(np.float64)) - rest
        out = np.full((len(x), components), np.nan)
        k = min(components, self.positive)
        out[:, :k] = (centred @ self.vectors[:, :k].astype(np.float64)) / np.sqrt(self.values[:k].astype(np.float64))
        return out

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n x - S) squared, exactly."""
        most = self.n * largest(x) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most * most * max(1, x.shape[1]) < 1 << 62 else object
        gap = x.astype(kind) * self.n - np.array(self.sums, kind)
        return (gap * gap).sum(axis=1).tolist()


def covariance(fit: DataFrame, x: str, dims: int) -> tuple[int, list[int], np.ndarray, int]:
    """n, sums, covariance and rank bound of the rows of whole numbers: rows less their rounded mean are multiplied and summed exactly, and
    what the rounding left is taken off exactly, so the figures are those of the centred rows, whatever the tasks."""
    if not dims:
        return 0, [], np.zeros((0, 0), LONG), 0
    counted = exact_sums(fit, lambda b: np.append(matrix(b.column(x), dims).sum(axis=0, dtype=object), b.num_rows), dims + 1)
    n, sums = counted[-1], counted[:-1]
    if not n:
        return 0, sums, np.zeros((dims, dims), LONG), 0
    middle = [round(Fraction(s, n)) for s in sums]
    upper = np.triu_indices(dims)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        rows = matrix(batch.column(x), dims)
        near = largest(rows) + max(map(abs, middle)) < 1 << 62
        centred = rows - np.array(middle, np.int64) if near else rows.astype(object) - np.array(middle, object)
        return gram(centred)[upper]

    got = exact_sums(fit, products, len(upper[0]))
    left = [s - n * m for s, m in zip(sums, middle, strict=True)]
    out = np.zeros((dims, dims), LONG)
    for i, j, g in zip(*upper, got, strict=True):
        exact = n * g - left[i] * left[j]  # n * n times the covariance
        high = float(exact)
        out[i, j] = out[j, i] = (LONG(high) + LONG(float(exact - int(high)))) / LONG(n) / LONG(n)
    return n, sums, out, min(dims, n - 1)


def fit_whitening(fit: DataFrame, x: str, dims: int) -> Whitening:
    """The whitening of the rows of whole numbers, each of which counts once. Only dims * dims sums reach the driver."""
    n, sums, cov, rank = covariance(fit, x, dims)
    values, vectors = eigen(cov)
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1, 1) if dims else vectors
    least = values[0] * dims * 64 * np.finfo(LONG).eps if dims else 0
    return Whitening(n, sums, values, vectors, float(np.trace(cov)), min(rank, int((values > least).sum())))


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), scale: int = SCALE) -> DataFrame:
    """The columns to keep, and component, n, deviation (decimal), whitened, explained, identity_error, for each row and component."""
    since = mark(vectors.sparkSession)
    rows, dims = integers(vectors.select(*keep, vector), scale, "x", vector)
    fit = materialise(rows.select("x").distinct(), "whiten-fit")
    model = fit_whitening(fit, "x", dims)
    many = min(components, dims)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            at = model.project(x, many)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(at.ravel(), from_pandas=True), many).cast(pa.list_(pa.float64()))
            deviation = [d if d < 10**38 else None for d in model.deviations(x)]
            kept = [batch.column(k) for k in batch.schema.names if k != "x"]
            yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(deviation, pa.decimal128(38, 0))], [*(k for k in batch.schema.names if k != "x"), "at", "deviation"])

    schema = lambda names: "".join(f"`{k}` {vectors.schema[k].dataType.simpleString()}, " for k in names) + "at array<double>, deviation decimal(38,0)"
    if not many or not model.n:
        found, error = rows.select(*keep, F.array().cast("array<double>").alias("at"), F.lit(None).cast("decimal(38,0)").alias("deviation")).where(F.lit(False)), 0.0
    else:
        found = rows.select(*keep, "x").mapInArrow(project, schema(keep))
        error = identity_error(materialise(fit.mapInArrow(project, schema(())), "whiten-check"), min(many, model.positive))
    drop_stages(vectors.sparkSession, since)
    share = [float(v / model.trace) if model.trace else 0.0 for v in np.maximum(model.values[:many], 0).astype(np.float64)]
    out = found.select(*keep, "deviation", F.posexplode("at").alias("place", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, share or [0.0])), F.col("place") + 1)
    return out.select(*keep, (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(whitened: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of the first k whitened coordinates, less the identity: of all rows, centred first."""
    if not k:
        return 0.0
    mean = whitened.agg(*[F.avg(F.col("at")[i]).alias(f"m{i}") for i in range(k)]).first()
    centred = [F.col("at")[i] - F.lit(mean[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = whitened.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs, strict=True))
