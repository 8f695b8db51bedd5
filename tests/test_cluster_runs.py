"""Whole clusters as arrays: runs, designs of one table of units, and what a unit costs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fieldloom.operators import cluster_runs as R
from fieldloom.operators import designs as D
from fieldloom.operators import regress as G
from fieldloom.plans import designs as P
from fieldloom.plans.base import Tables


def test_runs_hold_whole_clusters(monkeypatch):
    monkeypatch.setattr(R, "RUN", 10)
    clusters = np.sort(np.random.default_rng(1).integers(0, 12, 97)).tolist() + [99] * 25
    batches = [pa.RecordBatch.from_pydict({"_c": clusters[i : i + 4]}) for i in range(0, len(clusters), 4)]
    runs = list(R.whole_clusters(iter(batches)))
    assert len(runs) > 3 and [v for table, _ in runs for v in table.column("_c").to_pylist()] == clusters
    seen = [set(table.column("_c").to_pylist()) for table, _ in runs]
    assert all(a.isdisjoint(b) for i, a in enumerate(seen) for b in seen[:i])
    assert all([table.column("_c").to_pylist()[s] for s in starts] == sorted(k) for (table, starts), k in zip(runs, seen, strict=True))
    monkeypatch.setattr(D, "CELLS_AT_ONCE", 20)
    parts = [(p.column("_c").to_pylist(), s.tolist()) for table, starts in runs for p, s in D._runs_of(2, table, starts)]
    assert [v for p, _ in parts for v in p] == clusters and all(s == [i for i in range(len(p)) if i == 0 or p[i] != p[i - 1]] for p, s in parts)
    assert all(len(p) <= 10 or len(s) == 1 for p, s in parts if 99 not in p)


def test_designs_of_units_equal_designs_of_rows(spark, monkeypatch):
    """a unit is one row, whatever the number of designs that it is in."""
    rng = np.random.default_rng(4)
    gap = lambda v: None if rng.random() < 0.1 else float(v)
    units = [(i % 23, float(rng.integers(1, 5)), gap(rng.normal() + 1e6), gap(rng.normal()), gap(rng.normal()), gap(1), str(rng.integers(0, 4)) if i % 5 else None, bool(rng.random() < 0.7), None if i % 7 == 0 else True) for i in range(500)]
    df = spark.createDataFrame(units, "g int, w double, a double, b double, z double, y double, year string, first boolean, second boolean")
    designs = {f"{s}/{x}/{n}": D.Design((x, "z"), s, (y,) if y else ()) for s in ("first", "second") for x in ("a", "b") for n, y in (("all", None), ("known", "y"))}
    got = D.within(df, designs, "g", ["e", "z"], ["year"], "w")
    assert set(got) == set(designs)
    for name, d in designs.items():
        own = df.where(d.sample).where(" and ".join(["true", *[f"{y} is not null" for y in d.needs]])).select("g", "w", "z", "year", F.col(d.dense[0]).alias("e"), F.lit(name).alias("design"))
        one, g = D.within(own, "design", "g", ["e", "z"], ["year"], "w")[name], got[name]
        assert (g.names, g.n, g.clusters, g.singletons, g.varying) == (one.names, one.n, one.clusters, one.singletons, one.varying)
        assert np.allclose(g.gram, one.gram) and np.allclose(g.spread, one.spread) and np.isclose(g.weight, one.weight)


def test_the_designs_of_g38_read_one_row_a_unit(spark, sf_dir):
    t = Tables(spark, sf_dir)
    assert P.design_rows(t).count() == t.lineitem.count() and len(P.designs()) == 144


def test_few_and_many_clusters_have_equal_fits(spark, monkeypatch):
    """rows of few clusters do not move; F32, F36: both weights share one table, and clusters may lie in several scopes."""
    rng = np.random.default_rng(3)
    rows = [(i % 17, None if i % 11 == 0 else str(i % 3), float(rng.normal() + 1e3 * (i % 17)), float(rng.normal()), float(rng.normal()), float(rng.integers(1, 4)), None if i % 5 == 0 else 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, s string, x double, z double, y double, w double, one double")
    specs, found = {"a": ("y", ["x"]), "b": ("y", ["x", "z"])}, []
    for few in (5, 100):
        monkeypatch.setattr(G, "FEW", few)
        found.append(G.absorbed_grids(df, specs, ["w", "one"], "g", "s"))
    assert len(found[0]["w"]) == 8
    for w in ("w", "one"):
        for (scope, name), f in found[0][w].items():
            other = found[1][w][scope, name]
            one = G.fit_absorbed((df if scope == "ALL" else df.where(F.col("s") == scope)).where(f"{w} > 0"), *(specs[name][0], specs[name][1][:1], specs[name][1][1:]), w, "g")
            assert (f.status, f.n, f.clusters) == (other.status, other.n, other.clusters) == (one.status, one.n, one.clusters)
            assert np.allclose(f.beta, one.beta, atol=1e-7) and np.allclose(f.cov, one.cov, atol=1e-7) and np.allclose(other.beta, one.beta, atol=1e-7) and np.allclose(other.cov, one.cov, atol=1e-7)
