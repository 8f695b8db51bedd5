"""Designs from sums by cell against dense matrices of the same rows."""

import numpy as np
import pandas as pd
import pytest

from fieldloom.operators import cluster_runs as R
from fieldloom.operators import designs as D

DENSE, BLOCKS = ["e", "y", "age"], ["year", "month"]


def rows(level=0.0):
    rng = np.random.default_rng(12)
    n = 700
    df = pd.DataFrame({"cluster": rng.integers(0, 45, n), "w": rng.integers(1, 6, n).astype(float), "year": rng.integers(0, 5, n), "month": rng.integers(0, 4, n), "age": rng.normal(size=n), "grp": 0})
    df["grp"] = df.cluster % 3
    df["year"] = [f"{g}:{1990 + g + y}" for g, y in zip(df.grp, df.year, strict=True)]
    df["e"] = rng.normal(size=n) + df.cluster + 0.3 * df.age
    df["y"] = 2 * df.e - df.age + df.month + rng.normal(size=n)
    for c in DENSE:
        df[c] += level
    df["design"] = np.where(df.month < 3, "a", "b")
    df.loc[len(df)] = [999, 1.0, "0:1990", 1, level, 0, level, level, "a"]
    return df


def spark_rows(spark, df):
    wide = df.astype({"cluster": int, "month": int})
    gaps = pd.DataFrame([{**wide.iloc[0].to_dict(), "e": None}, {**wide.iloc[0].to_dict(), "year": None}, {**wide.iloc[0].to_dict(), "w": 0.0}])
    records = [tuple(None if isinstance(v, float) and np.isnan(v) else (v.item() if hasattr(v, "item") else v) for v in r) for r in [*wide.itertuples(index=False), *gaps[wide.columns].itertuples(index=False)]]
    return spark.createDataFrame(records, "cluster long, w double, year string, month long, age double, grp long, e double, y double, design string")


def dense(df, names, weighted=True):
    """The demeaned columns times the root of the weights."""
    w = df.w if weighted else pd.Series(1.0, df.index)
    out = []
    for x in names:
        v = df[x] if x in df else (df[x.split("=")[0]].astype(str) == x.split("=")[1]).astype(float)
        out.append((v - (w * v).groupby(df.cluster).transform("sum") / w.groupby(df.cluster).transform("sum")) * np.sqrt(w))
    return np.column_stack(out)


@pytest.mark.parametrize("level,close", [(0.0, 1e-8), (1e7, 1e-5)])
def test_products_equal_dense_ones(spark, level, close):
    df = rows(level)
    got = D.within(spark_rows(spark, df), "design", "cluster", DENSE, BLOCKS, "w")
    assert set(got) == {"a", "b"}
    for d, g in got.items():
        part = df[df.design == d]
        m = dense(part, g.names)
        assert np.allclose(g.gram, m.T @ m, atol=close * len(part)) and (g.n, g.clusters) == (len(part), part.cluster.nunique())
        sizes = part.groupby("cluster").size()
        assert g.singletons == (sizes == 1).sum() and g.varying == (part.groupby("cluster").e.nunique() > 1).sum()
    assert D.within(spark_rows(spark, df).limit(0), "design", "cluster", DENSE, BLOCKS, "w") == {}


def test_diagnostics(spark):
    df = rows().assign(design="all")
    g = D.within(spark_rows(spark, df).where("w > 0"), "design", "cluster", [*DENSE, "grp"], BLOCKS)["all"]
    # every year column at once: those of a group sum to a constant of its clusters, so one of each group depends on the rest
    columns = ["age", "grp", *g.block("year"), *g.block("month")[1:]]
    got = g.diagnostics("e", columns)
    m, e = dense(df, [c for c in columns if c != "grp"], False), dense(df, ["e"], False)[:, 0]
    beta = np.linalg.lstsq(m, e, rcond=None)[0]
    assert got["absorbed"] == ["grp"] and got["rank"] == np.linalg.matrix_rank(m) == m.shape[1] - 3 and got["condition"] == float("inf")
    assert set(got["dependent"]) == set(g.block("year")) and np.isclose(got["residual_sd"], np.std(e - m @ beta, ddof=1)) and np.isclose(got["within_sd"], np.std(e, ddof=1))
    fewer = [c for c in columns if c != "grp" and not c.endswith(("0:1990", "1:1991", "2:1992"))]
    got = g.diagnostics("e", fewer)
    s = dense(df, fewer, False)
    assert got["rank"] == len(fewer) and got["dependent"] == [] and np.isclose(got["condition"], np.linalg.cond(s / np.linalg.norm(s, axis=0)))


def test_codings(spark):
    df = rows()
    table = spark_rows(spark, df)
    levels = sorted(df.year.unique())
    local = [v for v in levels if v not in ("0:1990", "1:1991", "2:1992")]
    pooled = [v for v in levels if not v.endswith(":1990")]
    fewer = local[:-1]
    for other, equal in ((pooled, True), (fewer, False)):
        got = D.compare_codings(table, "cluster", ["y"], "e", {"with": ["age"], "without": []}, "year", {"local": local, "other": other}, "w")
        blocks = {"local": dense(df, [f"year={v}" for v in local]), "other": dense(df, [f"year={v}" for v in other])}
        e, y, age = (dense(df, [x]) for x in ("e", "y", "age"))
        project = lambda t, on: t - on @ np.linalg.lstsq(on, t, rcond=None)[0]
        ranks = [np.linalg.matrix_rank(b, tol=1e-8 * np.linalg.norm(b, 2)) for b in (*blocks.values(), np.hstack(list(blocks.values())))]
        for mode, more in (("with", [age]), ("without", [])):
            c = got[mode]
            assert list(c.alone) == ranks and c.equal == equal and (len(set(ranks)) == 1) == equal and (c.n, c.clusters) == (len(df), df.cluster.nunique())
            left = {k: project(e, np.hstack([*more, b])) for k, b in blocks.items()}
            for k, b in blocks.items():
                assert np.isclose(c.codings[k].beta["y"], (left[k] * project(y, np.hstack([*more, b]))).sum() / (left[k] ** 2).sum()) and np.isclose(c.codings[k].residual_norm, np.linalg.norm(left[k]))
            assert np.isclose(c.gap, np.abs(left["local"] - left["other"]).max(), atol=1e-9)


def test_a_level_costs_no_array_of_rows():
    """products with 2,000 levels of two blocks equal those of dummies, in memory that a dummy a level and row would not fit."""
    import tracemalloc

    rng, n = np.random.default_rng(6), 60_000
    of_cluster = np.sort(rng.integers(0, 50, n))
    part, x, w = R.Part(np.ones(n, dtype=bool), of_cluster), rng.normal(size=(2, n)) + 5, rng.uniform(1, 3, n)
    codes = [rng.integers(0, 2000, n), rng.integers(0, 3, n)]
    tracemalloc.start()
    got = D._sums(part, list(x), ["x0", "x1"], w, [(code, [f"b{b}={i}" for i in range(m)]) for b, (code, m) in enumerate(zip(codes, (2000, 3), strict=True))])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * n * 2000 / 4
    some = [0, 1, 2, 700, 2001, 2002, 2004]
    columns = np.array([x[0], x[1], *[codes[0] == i - 2 for i in some[2:5]], codes[1] == 0, codes[1] == 2], dtype=float)
    means = np.array([np.bincount(of_cluster, w * v) / np.bincount(of_cluster, w) for v in columns])
    left = columns - means[:, of_cluster]
    assert np.allclose(got.gram[np.ix_(some, some)], (left * w) @ left.T)
