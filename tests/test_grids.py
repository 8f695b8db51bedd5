"""The two-pass model grid against one fit at a time."""

import numpy as np
from pyspark.sql import functions as F

from fieldloom.operators import regress
from fieldloom.plans import QUERIES, grids
from fieldloom.plans.base import Tables


def test_grid_equals_single_fits(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 30, i % 3, *map(float, rng.normal(size=3)), float(rng.uniform(0.5, 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, s int, x double, z double, y double, w double").withColumns({"fe": (F.col("s") == 1).cast("double"), "twin": 2 * F.col("x")})
    fits = regress.fit_grid(df, {"a": ("y", ["x"]), "b": ("y", ["x", "z"]), "bad": ("y", ["x", "twin"])}, "w", "g", "s", ["fe"])
    assert len(fits) == 12 and all(fits[k].status == ("non_estimable_rank_deficient" if k[1] == "bad" else "estimated") for k in fits)
    for scope in ("ALL", "0", "1"):
        part = df if scope == "ALL" else df.where(F.col("s") == int(scope))
        want = regress.fit_explicit(part, "y", ["x", "z", *(["fe"] if scope == "ALL" else [])], "w", "g")
        got = fits[scope, "b"]
        assert got.terms == want.terms and (got.n, got.clusters, got.k) == (want.n, want.clusters, want.k)
        assert np.allclose(got.beta, want.beta) and np.allclose(got.cov, want.cov)


def test_grid_without_rows(spark):
    df = spark.createDataFrame([], "g int, x double, y double, w double")
    assert regress.fit_grid(df, {"a": ("y", ["x"])}, "w", "g") == {}


def test_second_route_agrees(spark, sf_dir):
    assert all(r.agrees for r in QUERIES["e21_second_route"](spark, sf_dir).collect())


def test_model_grid_is_whole(spark, sf_dir):
    """Every outcome, design and scope, and one model of a later region against a fit of its own."""
    rows = QUERIES["g10_model_grid"](spark, sf_dir).collect()
    assert {(r.scope, r.model) for r in rows} == {(s, f"{y}/{d}") for s in ("ALL", "0", "1", "2", "3", "4") for y in grids.OUTCOMES for d in "1234"}
    assert all(r.status == "estimated" for r in rows)
    k = {(r.scope, r.model): r.k for r in rows}
    assert k["ALL", "y1/1"] == 3 and k["ALL", "y1/2"] == 5 and k["ALL", "y1/3"] == 8 and k["ALL", "y1/4"] == 12 and k["3", "y1/4"] == 8
    df = grids.grid_units(Tables(spark, sf_dir)).na.drop(subset=["community", "community_broad"]).cache()
    for scope, model, extra in (("ALL", "y1/4", grids.EFFECTS), ("3", "y2/3", []), ("4", "low/2", [])):
        y, design = model.split("/")
        want = regress.fit_explicit(df if scope == "ALL" else df.where(F.col("n_regionkey") == int(scope)), y, [*grids.DESIGNS[design], *extra], "weight", "o_custkey")
        got = {r.term: (r.beta, r.se) for r in rows if (r.scope, r.model) == (scope, model)}
        assert got.keys() == set(want.terms) and all(np.allclose(got[term], (beta, se), atol=1e-6) for term, beta, se, *_ in want.rows())


def test_cascade_of_every_model(spark, sf_dir):
    """72 cascades of four steps, with rows lost to missing exposures, end at hand-counted rows."""
    rows = QUERIES["g11_full_cascade"](spark, sf_dir).collect()
    assert len(rows) == 288 and len({(r.scope, r.outcome, r.design) for r in rows}) == 72
    left = {(r.scope, r.outcome, r.design, r.name): r.left for r in rows}
    assert all(r.excluded == (0 if r.step == 0 else left[r.scope, r.outcome, r.design, ["start", "after_outcome", "after_exposure"][r.step - 1]] - r.left) for r in rows)
    df = grids.grid_units(Tables(spark, sf_dir)).where("n_regionkey = 4")
    used = df.na.drop(subset=["y2", *grids.DESIGNS["3"]])
    assert left["4", "y2", "3", "start"] == df.count() and left["4", "y2", "3", "after_controls"] == used.count()
    assert {r.clusters for r in rows if (r.scope, r.outcome, r.design) == ("4", "y2", "3")} == {used.select("o_custkey").distinct().count()}
    assert sum(r.excluded for r in rows if r.name == "after_exposure") > 0


def test_grid_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(x):
        seen.add(1)
        return float(x)

    rows = spark.range(60).select((F.col("id") % 7).alias("g"), F.lit(1.0).alias("w"), (F.col("id") % 2).cast("string").alias("s"), F.udf(passed, "double").asNondeterministic()("id").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    fits = regress.fit_grid(rows, {"a": ("y", ["x"])}, "w", "g", "s")
    assert {k: f.n for k, f in fits.items()} == {("ALL", "a"): 60, ("0", "a"): 30, ("1", "a"): 30} and fits["ALL", "a"].clusters == 7
    assert seen.value == 60


def test_families_share_one_reading(spark):
    """families with rows of their own come from one reading; a cluster may lie in several scopes or in none."""
    rng, seen = np.random.default_rng(5), spark.sparkContext.accumulator(0)
    rows = [(i % 19, None if i % 13 == 0 else "abc"[(i % 19 + (i % 7 == 0)) % 3], float(rng.normal()), None if i % 5 == 0 else float(rng.normal()), float(rng.normal()), float(rng.uniform(0.5, 2))) for i in range(300)]

    def passed(x):
        seen.add(1)
        return x

    df = spark.createDataFrame(rows, "g int, s string, x double, z double, y double, w double")
    families = {"short": regress.Family({"a": ("y", ["x"])}), "long": regress.Family({"a": ("y", ["x"]), "b": ("y", ["z", "x"])})}
    found = regress.fit_grids(df.withColumn("y", F.udf(passed, "double").asNondeterministic()("y")), families, "w", "g", "s")
    assert seen.value == 300 and {k: len(v) for k, v in found.items()} == {"short": 4, "long": 8}
    for family, fits in found.items():
        for (scope, model), f in fits.items():
            part = (df if scope == "ALL" else df.where(F.col("s") == scope)).na.drop(subset=["z"] if family == "long" else ["x"])
            want = regress.fit_explicit(part, *families[family].specs[model], "w", "g")
            assert (f.n, f.clusters, f.terms) == (want.n, want.clusters, want.terms) and np.allclose(f.beta, want.beta) and np.allclose(f.cov, want.cov)


def test_checks_read_the_units_once(spark, sf_dir):
    """seven families, the events and the sample sizes of the checks come from units that are joined once, and equal the single queries."""
    from fieldloom.plans import final

    seen = []

    class Counted(Tables):
        def __getattr__(self, name):
            seen.append(name)
            return super().__getattr__(name)

    rows = final.q13_all_checks(Counted(spark, sf_dir)).collect()
    assert seen.count("lineitem") == 1 and len(rows) == 24
    t = Tables(spark, sf_dir)
    units = grids.written_units(t)
    found = grids.all_families(t, units)
    single = {"severe": "g13_severe_family", "variants": "g14_exposure_variants", "household": "g15_household_baseline", "weights": "g16_weight_variants", "support": "g17_support_sensitivity"}
    for k, name in single.items():
        sides = [sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(found[k].columns).collect()) for df in (found[k], QUERIES[name](spark, sf_dir))]
        assert sides[0] == sides[1] and sides[0], k
    flow = {(r.scope, f"{r.outcome}/{r.design}"): r.left for r in QUERIES["g11_full_cascade"](spark, sf_dir).where("name = 'after_controls'").collect()}
    assert {(r.scope, r.model): r.left for r in grids.sample_sizes(units).collect()} == flow
