"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest

from fieldloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n int"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1) for i, v in enumerate(vectors)], SCHEMA)


def usable(vectors):
    return [(i, v) for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def compare(rows, vectors, components, close=1e-6):
    kept = usable(vectors)
    x = np.floor(64 * np.array([np.float32(v) for _, v in kept], float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values = np.linalg.eigvalsh(c.T @ c / n)[::-1]
    k = min(components, int((values > 1e-12 * values.sum()).sum()))
    assert len(rows) == n * k
    by = {(r.vec_id, r.component): r for r in rows}
    z = np.array([[by[i, j + 1].whitened for j in range(k)] for i, _ in kept])
    assert np.abs(z.T @ z / n - np.eye(k)).max() < 1e-8 and max(r.identity_error for r in rows) < 1e-8
    for (i, _), row in zip(kept, x, strict=True):
        exact = sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s, strict=True))
        assert {by[i, j + 1].deviation for j in range(k)} == {exact} and abs(by[i, 1].distance - exact / n**2) <= 1e-9 * max(1, exact / n**2)
    assert np.allclose([by[kept[0][0], j + 1].explained for j in range(k)], values[:k] / values.sum(), rtol=1e-9)
    # components from the whitened rows: eigenvectors of the covariance
    basis = c.T @ z / n / np.sqrt(values[:k])
    assert np.allclose((c.T @ c / n) @ basis, basis * values[:k], atol=close * values[0])


def test_equals_eigenvectors(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id")
    vectors = [list(r.embedding) for r in source.collect()]
    vectors += [None, [float("nan"), *vectors[0][1:]], [None, *vectors[0][1:]], [float("inf"), *vectors[0][1:]], *[vectors[5]] * 700]
    vectors = [v if v is None else v[:24] for v in vectors]
    compare(whitening.whiten(table(spark, vectors), 16).collect(), vectors, 16)


@pytest.mark.parametrize("kind", ["equal eigenvalues", "constant dimensions", "dependent dimensions", "few rows", "steep"])
def test_degenerate_tables(spark, kind):
    rng = np.random.default_rng(2)
    if kind == "equal eigenvalues":
        vectors = np.concatenate([np.eye(8) * 4, -np.eye(8) * 4])
    elif kind == "constant dimensions":
        vectors = np.column_stack([rng.normal(size=(200, 3)), np.full((200, 4), 2.5)])
    elif kind == "dependent dimensions":
        base = np.round(rng.normal(size=(300, 3)) * 64) / 64
        vectors = np.column_stack([base, base.sum(axis=1), base[:, 0]])
    elif kind == "few rows":
        vectors = rng.normal(size=(4, 10))
    else:
        vectors = rng.normal(size=(400, 6)) * [1e4, 1e3, 100, 10, 1, 0.1]
    compare(whitening.whiten(table(spark, vectors), components=6).collect(), vectors.tolist(), 6)


def test_fewer_steps_find_the_largest(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(500, 40)) * np.array([50, 20, 10, *[1] * 37])
    rows = whitening.whiten(table(spark, vectors), components=3, steps=12).collect()
    assert len(rows) == 1500 and max(r.identity_error for r in rows) < 1e-6


def test_no_components(spark):
    for vectors in ([], [None, None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[], []], [[float("nan")]]):
        out = whitening.whiten(table(spark, vectors))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "distance"] and out.count() == 0


def test_other_lengths_and_wide_deviations(spark):
    vectors = [[1.0, 0.0], [0.0, 1.0], [3.0, 1.0], [1.0], [1.0, 2.0, 3.0]]
    assert {r.vec_id for r in whitening.whiten(table(spark, vectors)).collect()} == {0, 1, 2}
    far = [[1e9, 0.0], [0.0, 1.0], [3.0, 1.0]]
    rows = whitening.whiten(table(spark, far)).collect()
    assert all(r.deviation is None and r.distance > 1e18 for r in rows if r.vec_id == 0)
