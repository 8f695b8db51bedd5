"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries are put on an integer grid, so that sums are exact and rows can be centred without loss: with n rows and sums S, the
whole part of S/n is subtracted as an integer. X is the table of centred rows; it is read, never held.

A step of the bidiagonalisation makes u from Xv and the next v from X'u. u has an entry a row, so it is not stored: as u is X
times a vector p of the rows' dimension, a step is one scan that computes Xp row by row, X'(Xp) and its length, and of
which a task returns as many numbers as there are dimensions. Both sides are fully reorthogonalised twice: v against all
earlier v, and u against all earlier u through their products X'u, which are at hand (u_i'Xp = (X'u_i)'p). Equal
eigenvalues and dimensions without variation end a chain; it goes on from a new direction, until all dimensions are spanned
(or `steps` of them). The singular values of the small bidiagonal matrix give the deviations, its right vectors the components.

Defined cases: rows whose vector is null, or holds null or non-finite entries, are dropped, and so are vectors of another
length than most have (of equally frequent lengths, the longest; the empty vector is one). Repeated rows count as often as they occur; a null id
is an id like any other. Components whose variance is under 1e-12 of the total can't be whitened and are left out, so rows
that are all equal give none, nor do empty tables. Other columns may have any names. A deviation, which grows
with the square of n, is null beyond 63 bits; distance, the deviation over n squared, is always there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: The grid of the entries.
SCALE, OFFSET = 64, 1_000_000
#: Shares of the total variance (of its root: lengths) that count as zero.
NO_VARIANCE, NO_LENGTH = 1e-12, 1e-13
RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, distance double"


@dataclass
class Whitening:
    """n rows; mean = whole + rest / n; one column a component; variances by falling size; total: the trace of the covariance."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of (n x - S) squared, exact; masked beyond 63 bits."""
        near = x - self.whole
        over = ((np.abs(near) * float(self.n) + self.n) ** 2).sum(axis=1) >= 2.0**63
        return np.ma.masked_array(((near * self.n - self.rest) ** 2).sum(axis=1), over)


def gridded(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, int]:
    """A written table of vec_id and x, the entries on their grid, and the dimension (0 without rows)."""
    sound = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform(column, lambda v: (F.floor(v.cast("double") * scale) + offset).cast("long"))
    rows = written(vectors.where(F.col(column).isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")), "whitening-rows")
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most[0] if most else 0
    return rows.where(F.size("x") == d), d


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(rows: DataFrame, function: Callable[[np.ndarray], np.ndarray], d: int, width: int, kind: str = "double") -> np.ndarray:
    """The sum over all rows of a function of blocks of them; a task adds up its blocks, a shuffle by place adds up the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = function(matrix(batch, d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["at", "value"])

    out = np.zeros(width, np.int64 if kind == "bigint" else float)
    for at, value in rows.select("x").mapInArrow(run, f"at int, value {kind}").groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    return out


def bidiagonalise(product: Callable[[np.ndarray], tuple[np.ndarray, float]], d: int, steps: int, size: float, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) with X V = U B, V orthonormal and B upper bidiagonal. product: p to X'Xp and the squared length of Xp. size: the
    root of X's summed squares."""
    rng, tiny = np.random.default_rng(seed), NO_LENGTH * size
    v_all, p_all, w_all = np.zeros((d, steps)), np.zeros((d, steps)), np.zeros((d, steps))
    b = np.zeros((steps, steps))

    def fresh(k: int) -> np.ndarray:
        v = rng.standard_normal(d)
        for _ in range(3):
            v -= v_all[:, :k] @ (v_all[:, :k].T @ v)
        return v / np.linalg.norm(v)

    v, beta = fresh(0), 0.0
    for j in range(steps):
        v_all[:, j] = v
        p = v - beta * p_all[:, j - 1] if j else v.copy()
        for _ in range(2):  # u against all earlier u
            p -= p_all[:, :j] @ (w_all[:, :j].T @ p)
        w, squared = product(p)
        alpha = float(np.sqrt(max(squared, 0.0)))
        if alpha > tiny:
            p_all[:, j], w_all[:, j], b[j, j] = p / alpha, w / alpha, alpha
            v = w_all[:, j] - alpha * v
        else:
            v = np.zeros(d)
        for _ in range(2):  # v against all earlier v
            v -= v_all[:, : j + 1] @ (v_all[:, : j + 1].T @ v)
        beta = float(np.linalg.norm(v))
        if j + 1 < steps:
            v, beta = (v / beta, beta) if beta > tiny else (fresh(j + 1), 0.0)
            b[j, j + 1] = beta
    return v_all, b


def fit(rows: DataFrame, d: int, components: int = 32, steps: int | None = None) -> Whitening:
    """rows: those of gridded. steps: all dimensions unless given; fewer need fewer scans, and find the largest components first."""
    n = rows.count()
    sums = summed(rows, lambda x: x.sum(axis=0), d, d, "bigint")
    model = Whitening(n, sums // n, sums % n, np.zeros((d, 0)), np.zeros(0), 0.0)
    model.total = float(summed(rows, lambda x: (model.centred(x) ** 2).sum(axis=0), d, d).sum()) / n
    if model.total == 0.0:
        return model

    def product(p: np.ndarray) -> tuple[np.ndarray, float]:
        def block(x: np.ndarray) -> np.ndarray:
            c = model.centred(x)
            u = c @ p
            return np.append(u @ c, u @ u)

        out = summed(rows, block, d, d + 1)
        return out[:-1], float(out[-1])

    v, b = bidiagonalise(product, d, min(steps or d, d), np.sqrt(n * model.total))
    _, s, right = np.linalg.svd(b)
    variances = s**2 / n
    keep = np.flatnonzero(variances > NO_VARIANCE * model.total)[:components]
    vectors = v @ right[keep].T
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(keep))] if len(keep) else np.ones(0)
    model.components, model.variances = vectors * np.sign(largest), variances[keep]
    return model


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    d, k = model.components.shape

    def block(x: np.ndarray) -> np.ndarray:
        z = model.whiten(x)
        return np.append((z.T @ z).ravel(), z.sum(axis=0))

    out = summed(rows, block, d, k * k + k)
    mean = out[k * k :] / model.n
    return float(np.abs(out[: k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 32, column: str = "embedding", steps: int | None = None) -> DataFrame:
    """One row a usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error, distance."""
    spark: SparkSession = vectors.sparkSession
    rows, d = gridded(vectors, column)
    model = fit(rows, d, components, steps) if d else None
    if model is None or not len(model.variances):
        return spark.createDataFrame([], RESULT)
    error, k = identity_error(rows, model), len(model.variances)
    explained = model.variances / model.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x, m = matrix(part, d), part.num_rows
                each = pa.array(np.repeat(np.arange(m), k))
                found = model.deviations(x)
                exact = pa.array(found.data, mask=np.ma.getmaskarray(found))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), exact.take(each), pa.array(model.whiten(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)), pa.array(np.repeat((model.centred(x) ** 2).sum(axis=1), k))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "distance"],
                )

    return rows.mapInArrow(run, RESULT)
