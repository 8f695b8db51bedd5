"""Absorbed models on their own samples against single fits, at any level of the columns."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import cluster_runs as R
from fieldloom.operators import own_samples as O
from fieldloom.operators import regress as G
from fieldloom.operators.own_samples import Model, own_sample_grid
from fieldloom.plans import own_samples as P


def table(spark, level=0.0, spread=0.0):
    """Clusters in groups; x and z vary within clusters, by spread between them, around level; some values are missing."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(900):
        cluster = i % 61
        own = cluster * spread
        x, z = rng.normal() + own + level, rng.normal() - own - level
        y = 0.5 * (x - own - level) - (z + own + level) + cluster + rng.normal() + level
        gap = lambda v, p: None if rng.random() < p else float(v)
        rows.append((f"c{cluster}", cluster % 3, gap(x, 0.1), gap(z, 0.2), gap(y, 0.05), float(rng.integers(1, 9)), bool(rng.random() < 0.6), float(cluster), 2.0))
    rows += [("lone", 1, level, level, level, 1.0, True, 7.0, 2.0), (None, 1, level, level, level, 1.0, True, 7.0, 2.0), ("c1", 1, level, level, level, None, True, 1.0, 2.0), ("c1", 1, float("nan"), level, level, 1.0, True, 1.0, 2.0)]
    return spark.createDataFrame(rows, "cluster string, grp int, x double, z double, y double, w double, part boolean, held double, flat double").withColumn("twice", F.col("x") * 2)


MODELS = [Model("plain", "y", ("x",), weight="w"), Model("controlled", "y", ("x",), ("z",), weight="w"), Model("part", "y", ("x",), ("z",), "part", "w"), Model("unweighted", "y", ("z",), ("x",), "part"), Model("other outcome", "z", ("x",), ("held",), weight="w")]


def single(df, m, group):
    rows = df.na.drop(subset=["cluster", m.outcome, *m.regressors, *([m.weight] if m.weight else [])]).withColumn("one", F.lit(1.0))
    rows = rows.where(m.sample) if m.sample else rows
    return G.fit_absorbed(rows, m.outcome, list(m.exposures), list(m.controls), m.weight or "one", "cluster", group if m.weight else None)


@pytest.mark.parametrize("level,spread,close", [(0.0, 0.0, 1e-9), (1e4, 1e3, 1e-7), (1e9, 0.0, 1e-4), (1e9, 1e3, 1e-4)])
def test_equals_single_fits_at_any_level(spark, level, spread, close):
    df = table(spark, level, spread).cache()
    fits = own_sample_grid(df, MODELS, "cluster", "grp")
    for m in MODELS if level == 0.0 else MODELS[:3]:
        one, f = single(df, m, "grp"), fits[m.name]
        assert (f.status, f.terms, f.n, f.clusters, f.k, f.law) == (one.status, one.terms, one.n, one.clusters, one.k, one.law)
        assert np.allclose(f.beta, one.beta, atol=close) and np.allclose(f.cov, one.cov, atol=close)
    assert fits["other outcome"].more["absorbed"] == ["held"] and fits["plain"].more["singletons"] == 1
    grid = G.absorbed_grid(df, {"a": ("y", ["x"]), "b": ("y", ["x", "z"])}, "w", "cluster")
    rows = df.na.drop(subset=["cluster", "x", "y", "z", "w"])
    for name, right in (("a", []), ("b", ["z"])):
        one = G.fit_absorbed(rows, "y", ["x"], right, "w", "cluster")
        assert grid["ALL", name].status == "estimated" and np.allclose(grid["ALL", name].beta, one.beta, atol=close) and np.allclose(grid["ALL", name].cov, one.cov, atol=close)


def test_what_is_around_a_fit(spark):
    df = table(spark)
    f = own_sample_grid(df, MODELS[:2], "cluster", "grp")["controlled"]
    rows = df.na.drop(subset=["cluster", "x", "y", "z", "w"]).toPandas()
    rows = rows[rows.groupby("cluster").x.transform("size") > 1]
    rows["v"] = rows.w * len(rows) / 3 / rows.groupby("grp").w.transform("sum")
    inner = lambda c: rows[c] - (rows.v * rows[c]).groupby(rows.cluster).transform("sum") / rows.groupby("cluster").v.transform("sum")
    x, z = inner("x"), inner("z")
    left = x - z * (rows.v * x * z).sum() / (rows.v * z * z).sum()
    assert np.isclose(f.more["mean"], np.average(rows.x, weights=rows.v)) and np.isclose(f.more["within_sd"], np.sqrt(np.average(x**2, weights=rows.v)))
    assert np.isclose(f.more["residual_sd"], np.sqrt(np.average(left**2, weights=rows.v))) and f.more["varying"] == rows.cluster.nunique()


def test_refusals(spark):
    df = table(spark)
    models = [Model("absorbed", "y", ("held",), ("x",)), Model("constant", "y", ("flat",)), Model("copied", "y", ("x",), ("twice",)), Model("nobody", "y", ("x",), sample="never"), Model("sound", "y", ("x",), ("flat",))]
    fits = own_sample_grid(df.withColumn("never", F.lit(None).cast("boolean")), models, "cluster")
    assert {k: f.status for k, f in fits.items()} == {
        "absorbed": "non_estimable_exposure_absorbed", "constant": "non_estimable_no_within_variation", "copied": "non_estimable_rank_deficient", "nobody": "non_estimable_no_within_variation", "sound": "estimated",
    }
    assert all(f.beta is None for f in fits.values() if f.status != "estimated") and own_sample_grid(df, [], "cluster") == {}
    assert {f.status for f in own_sample_grid(df.limit(0), MODELS, "cluster", "grp").values()} == {"non_estimable_no_within_variation"}
    with pytest.raises(ValueError, match="two groups"):
        own_sample_grid(df.withColumn("grp", F.col("x") > 0), MODELS, "cluster", "grp")


def test_the_grid_has_every_model():
    listed = P.specs()
    assert len(listed) == 291 == len({tuple(sorted(s.items())) for s in listed})
    assert sum(s["family"].startswith("overlap") for s in listed) == 9 and len({(s["product"], s["outcome"]) for s in listed}) == 6


def test_moments_of_scores_do_not_depend_on_the_tasks():
    """what tasks return has a fixed size, and sums at coefficients of their own merge to those of all clusters in one task."""
    rng, n = np.random.default_rng(2), 400
    c = np.sort(rng.integers(0, 30, n))
    x, z = rng.normal(size=n) + c, rng.normal(size=n)
    y = 0.5 * x - z + rng.normal(size=n) + 1e3 * c
    x[rng.random(n) < 0.1] = np.nan
    units = pa.table({"_c": c, "_g": ["a" if i % 2 else "b" for i in c], "v0": y, "v1": x, "v2": z, "w0": rng.integers(1, 9, n).astype(float)})
    models = [(("v0", "v1", "v2"), None, "w0"), (("v0", "v1", "v2"), None, None)]

    def sums(*cuts):
        out = {}
        for a, b in zip((0, *cuts), (*cuts, 30), strict=True):
            part = units.filter(pa.array((c >= a) & (c < b)))
            for r in O._model_sums(models)(iter([(part, R._starts(part))])):
                one, key = O.Sums.read({k: v[0] for k, v in r.items()}), (r["model"][0], r["grp"][0])
                out[key] = out[key] + one if key in out else one
        return out

    whole, parts = sums(), sums(3, 11, 20)
    assert whole.keys() == parts.keys() == {(m, g) for m in (0, 1) for g in "ab"}
    for key, one in whole.items():
        many = parts[key]
        assert (one.n, one.clusters, one.singletons, one.varying, one.split) == (many.n, many.clusters, many.singletons, many.varying, many.split)
        assert np.allclose(one.gram, many.gram) and np.allclose(one.mean, many.mean) and np.allclose(one.spread, many.spread) and np.isclose(one.w, many.w)
        assert not np.allclose(one.pilot, many.pilot) and np.allclose(one.moments, O._moved(many.moments, 2, one.pilot - many.pilot))
