"""The one-pass absorbed grid against single fits, and the comparison of runs."""

import numpy as np
from pyspark.sql import functions as F

from fieldloom.operators import regress as G
from fieldloom.operators import runs


def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        x, z, cluster = rng.normal(), rng.normal(), i % 37
        rows.append((i, cluster, cluster % 3, x, z, 2.0, float(cluster), 0.05 * x - z + cluster + rng.normal(), float(rng.integers(1, 9))))
    rows.append((600, 999, 0, 1.0, 1.0, 2.0, 1.0, 5.0, 1.0))  # a singleton
    return spark.createDataFrame(rows, "id int, cluster int, level int, x double, z double, flat double, held double, y double, w double")


def test_absorbed_grid_equals_single_fits(spark):
    df = table(spark)
    fits = G.absorbed_grid(df, {"a": ("y", ["x"]), "b": ("y", ["x", "z"])}, "w", "cluster", "level")
    assert set(fits) == {(s, m) for s in ("ALL", "0", "1", "2") for m in "ab"}
    for (scope, model), f in fits.items():
        one = G.fit_absorbed(df if scope == "ALL" else df.where(F.col("level") == int(scope)), "y", ["x"], ["z"] if model == "b" else [], "w", "cluster")
        assert np.allclose(f.beta, one.beta, atol=1e-9) and np.allclose(f.cov, one.cov, atol=1e-9)
        assert (f.n, f.clusters, f.k, f.law) == (one.n, one.clusters, one.k, one.law)


def test_absorbed_grid_refuses(spark):
    df = table(spark).withColumn("same", F.col("x") * 2)
    fits = G.absorbed_grid(df, {"absorbed": ("y", ["held", "x"]), "constant": ("y", ["flat"]), "copied": ("y", ["x", "same"]), "sound": ("y", ["x", "flat"])}, "w", "cluster")
    assert {m: f.status for (_, m), f in fits.items()} == {"absorbed": "non_estimable_exposure_absorbed", "constant": "non_estimable_exposure_absorbed", "copied": "non_estimable_rank_deficient", "sound": "estimated"}
    assert all(f.beta is None for f in fits.values() if f.status != "estimated") and fits["ALL", "sound"].terms == ["x"]
    assert G.absorbed_grid(df.limit(0), {"a": ("y", ["x"])}, "w", "cluster") == {}


def test_run_comparison(spark):
    schema = "k int, v double"
    inf, nan = float("inf"), float("nan")
    first = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, nan), (5, inf), (6, -inf), (7, nan), (8, None), (9, 1.0)], schema)
    second = spark.createDataFrame([(1, 1.0), (2, nan), (3, 3.5), (4, nan), (5, inf), (6, inf), (7, inf), (8, None), (10, 1.0), (10, 1.0), (3, 3.5)], schema)
    got = {r.outcome: r.n for r in runs.compare_runs(first, second, "k", ["v"]).collect()}
    assert got == {"same": 4, "finite to nan": 1, "repeated_key": 1, "-inf to +inf": 1, "nan to +inf": 1, "only_a": 1, "only_b": 1}


SPEC = "id string, outcome string, status string, beta double, se double, n long"
FITS = [(f"m{i:04d}", "y", "estimated", 0.1 * i, 0.01, 100 + i) for i in range(1, 6)]
NOT_A_NUMBER, INFINITE = float("nan"), float("inf")


def changed(i, **values):
    names = ["id", "outcome", "status", "beta", "se", "n"]
    return [tuple(values.get(k, v) for k, v in zip(names, r, strict=True)) if at == i else r for at, r in enumerate(FITS)]


def test_run_report_cases(spark):
    required = ["outcome", "status", "beta", "se"]
    made = lambda rows: spark.createDataFrame(rows, SPEC)
    compare = lambda a, b: runs.report(made(a), made(b), "id", required)
    cases = {
        "unchanged": (FITS, FITS, []), "finite to nan": (FITS, changed(0, se=NOT_A_NUMBER), ["numbers_differ"]), "repeated": (FITS, [*FITS, FITS[0]], ["repeated_keys"]), "missing": (FITS, [*FITS[:2], *FITS[3:]], ["missing_or_extra_keys"]),
        "nan to +inf": (changed(1, beta=NOT_A_NUMBER), changed(1, beta=INFINITE), ["numbers_differ"]), "-inf to +inf": (changed(3, se=-INFINITE), changed(3, se=INFINITE), ["numbers_differ"]),
        "status": (FITS, changed(2, status="non_estimable"), ["texts_differ"]), "null status": (FITS, changed(2, status=None), ["texts_differ"]), "spec": (FITS, changed(4, outcome="z"), ["texts_differ"]), "near": (FITS, changed(0, beta=0.1 + 1e-12), []), "equal classes": (changed(0, se=NOT_A_NUMBER), changed(0, se=NOT_A_NUMBER), []),
    }
    for name, (a, b, reasons) in cases.items():
        assert compare(a, b).reasons == reasons, name
    r = compare(FITS, changed(0, se=NOT_A_NUMBER))
    assert [tuple(x) for x in r.listed.collect()] == [("values", "m0001", "se", "finite to nan")]
    assert {(x.item, x.outcome): x.n for x in r.counts.collect()}["se", "finite to nan"] == 1
    r = compare([*FITS, (None, "y", "estimated", 1.0, 1.0, 1)], [*FITS[1:], FITS[1], ("m9", "y", "estimated", 1.0, 1.0, 1), (None, "y", "estimated", 3.5, 1.0, 1)])
    assert r.reasons == ["repeated_keys", "missing_or_extra_keys", "numbers_differ"]
    assert {(x.key, x.outcome) for x in r.listed.where("section = 'keys'").collect()} == {("m0001", "only_a"), ("m9", "only_b"), ("m0002", "repeated_in_b")}
    assert [(x.n, x.largest) for x in r.counts.where("item = 'beta' and outcome = 'differs'").collect()] == [(1, 2.5)]


def test_run_report_of_other_schemas(spark):
    a = spark.createDataFrame(FITS, SPEC)
    r = runs.report(a, a.drop("se"), "id", ["beta", "se"])
    assert r.reasons == ["missing_required_columns"] and r.listed is None and {(x.item, x.outcome) for x in r.counts.collect()} == {("se", "only_a"), ("se", "required_missing")}
    r = runs.report(a, a.drop("n").withColumns({"more": F.lit(1), "status": F.lit(1)}), "id", ["beta"])
    assert r.reasons == ["unequal_columns", "other_types"]
    assert runs.report(a.limit(0), a.limit(0), "id").reasons == []


def test_both_runs_come_from_one_computation(spark, sf_dir):
    """A mean worked out twice may end on another last digit, which at a tolerance of zero is a difference."""
    from fieldloom.plans import QUERIES

    files = QUERIES["g42_compare_runs"](spark, sf_dir).inputFiles()
    assert files and all("/run-" in f for f in files)
