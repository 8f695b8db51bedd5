"""Alternating projections on cell sums against row-wise demeaning, pass by pass."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import two_way as V


def rows():
    rng = np.random.default_rng(21)
    n = 500
    df = pd.DataFrame({"k": range(n), "g": rng.zipf(1.6, n) % 40, "y": rng.integers(1990, 1997, n), "by": rng.choice(["p", "q"], n)})
    df["x"] = rng.normal(size=n) + df.g + 3 * (df.y - 1993) + 1e6
    return df


def plain(df, passes, keys=((), ())):
    r = df.x.copy()
    for _ in range(passes):
        r = r - r.groupby([*[df[k] for k in keys[0]], df.g]).transform("mean")
        r = r - r.groupby([*[df[k] for k in keys[1]], df.y]).transform("mean")
    return r


def table(spark, df):
    gaps = [(1000, 1, 1990, "p", None), (1001, None, 1990, "p", 1.0), (1002, 1, None, "p", 1.0), (1003, 1, 1990, "p", float("nan"))]
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in df.itertuples(index=False)] + gaps, "k long, g long, y int, by string, x double")


@pytest.mark.parametrize("passes", [1, 2, 25])
def test_equals_demeaning_of_rows(spark, passes):
    df = rows()
    got = V.demean_two_way(table(spark, df), "g", "y", "x", passes)
    assert got.columns == ["k", "g", "y", "by", "x"]
    found = {r.k: r.x for r in got.collect()}
    assert len(found) == len(df) + 4 and all(found[k] is None for k in range(1000, 1004))
    assert np.allclose([found[k] for k in df.k], plain(df, passes), atol=1e-8)


def test_spread_by_group_and_convergence(spark):
    df = rows()
    fit = V.fit_two_way(table(spark, df), "g", "y", "x", "by", 500, 1e-12)
    assert fit.passes < 500 and fit.moved <= 1e-12
    left = plain(df, fit.passes, (("by",), ("by",)))
    for r in fit.spread().collect():
        part = df[df.by == r["_by"]]
        sizes = part.groupby("g").x.transform("size")
        around = (part.x - part.groupby("g").x.transform("mean"))[sizes > 1]
        assert (r.n, r.clusters, r.n_2plus) == (len(part), part.g.nunique(), (sizes > 1).sum()) and r.clusters_2plus == (part.groupby("g").size() > 1).sum()
        assert np.isclose(r.within, (around**2).sum()) and np.isclose(r.left, (left[df.by == r["_by"]] ** 2).sum())
    # what converged is the residual of both sets of dummies
    dummies = pd.get_dummies(df.g.astype(str) + df.by).join(pd.get_dummies(df.y.astype(str) + df.by)).astype(float).to_numpy()
    assert np.allclose(left, df.x - dummies @ np.linalg.lstsq(dummies, df.x, rcond=None)[0], atol=1e-6)


def test_nothing_to_fit(spark):
    empty = table(spark, rows()).where(F.lit(False))
    assert V.demean_two_way(empty, "g", "y", "x").count() == 0 and V.fit_two_way(empty, "g", "y", "x").spread().count() == 0
