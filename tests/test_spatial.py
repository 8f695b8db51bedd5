"""Disks over grids and exposure windows: cases with known answers and a brute-force integration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import exposure, spatial

GRID = spatial.Grid(0.0, 1.0, 0.01, -0.01, 100, 100)


def point(spark, radius, x=0.503, y=0.497):
    return spark.createDataFrame([(1, x, y, float(radius))], "k long, x double, y double, r double")


def constant(spark, value, columns=range(100)):
    cells = spark.range(100).select(F.col("id").cast("int").alias("row")).withColumn("col", F.explode(F.array(*[F.lit(i) for i in columns])))
    return cells.withColumns({"layer": F.lit("a"), "value": F.lit(value).cast("double")})


def extract(spark, radius, pixels, **at):
    w = spatial.overlap_weights(point(spark, radius, **at), GRID, "x", "y", "r", "k")
    return spatial.extract(w, pixels, [("a",)], ["layer"], "k").first()


def test_whole_disk_for_each_radius(spark):
    pixels = constant(spark, 7.0)
    for radius in (1000, 2000, 5000, 10000):
        got = extract(spark, radius, pixels)
        assert abs(got.value - 7) < 1e-9 and got.status == "full" and got.reason == ""
        assert abs(got.total_area / (math.pi * radius**2) - 1) < 1e-9


def test_half_plane_corner_and_missing(spark):
    half = extract(spark, 5000, constant(spark, 40.0, range(50, 100)))
    assert half.status == "partial" and abs(half.value - 40) < 1e-9 and 0.4 < half.valid_fraction < 0.6
    none = extract(spark, 5000, constant(spark, None))
    assert (none.status, none.reason, none.value) == ("missing", "nodata", None)
    corner = extract(spark, 5000, constant(spark, 7.0), x=0.001, y=0.999)
    assert corner.status == "partial" and corner.valid_fraction < 0.5
    away = extract(spark, 1000, constant(spark, 7.0), x=5.0)
    assert (away.status, away.reason) == ("missing", "outside_grid")


@pytest.mark.parametrize("seed", range(3))
def test_overlap_equals_integration(spark, seed):
    rng = np.random.default_rng(seed)
    boxes = [tuple(map(float, (a, b, a + w, b + h))) for a, b, w, h in zip(rng.uniform(-2, 1, 20), rng.uniform(-2, 1, 20), rng.uniform(0.1, 3, 20), rng.uniform(0.1, 3, 20), strict=True)]
    df = spark.createDataFrame(boxes, "x0 double, y0 double, x1 double, y1 double")
    c = F.col
    area = spatial.disk_overlap([(c("x0"), c("y0")), (c("x1"), c("y0")), (c("x1"), c("y1")), (c("x0"), c("y1"))], F.lit(1.0))
    for row in df.withColumn("area", area).collect():
        x = np.linspace(max(row.x0, -1), max(min(row.x1, 1), max(row.x0, -1)), 200_001)
        top = np.sqrt(np.clip(1 - x**2, 0, None))
        want = np.trapezoid(np.clip(np.minimum(row.y1, top) - np.maximum(row.y0, -top), 0, None), x)
        assert abs(row.area - want) < 1e-5


def index(year, month):
    return (year - 1900) * 12 + month


@pytest.mark.parametrize(("window", "year", "month", "want"), [
    ("birth_year", 2010, 6, 2010), ("prenatal", 2010, 12, 2010), ("post_12", 2010, 7, 2010.5), ("post_12", 2010, 1, 2010), ("prenatal", 2010, 2, 2009.1111), ("post_24", 2010, 3, 2010.6667),
])
def test_windows_over_a_panel_of_years(spark, window, year, month, want):
    units = spark.createDataFrame([(1, 1, index(year, month), index(2015, 1))], "u long, g long, b long, t long")
    panel = spark.range(2000, 2018).select(F.lit(1).cast("long").alias("g"), F.lit("p").alias("product"), F.col("id").alias("year"), F.col("id").cast("double").alias("value"), F.lit("full").alias("state"), F.lit(1.0).alias("valid_fraction"))
    got = exposure.exposures(units, panel, ["p"], (2000, 2017), "u", "g", "b", "t").where(F.col("window") == window).first()
    assert got.status == "eligible_complete" and abs(got.exposure - want) < 1e-3


def test_window_statuses(spark):
    units = spark.createDataFrame(
        [(1, 1, index(2017, 12), index(2019, 12)), (2, 1, index(2010, 1), index(2010, 7)), (3, 1, index(2005, 1), index(2009, 1)), (4, None, index(2010, 1), index(2012, 1)), (5, 1, None, index(2012, 1)), (6, 1, index(2010, 2), index(2010, 1))],
        "u long, g long, b long, t long",
    )
    panel = spark.range(2000, 2018).where("id <> 2005").select(F.lit(1).cast("long").alias("g"), F.lit("p").alias("product"), F.col("id").alias("year"), F.lit(1.0).alias("value"), F.lit("full").alias("state"), F.lit(1.0).alias("valid_fraction"))
    rows = exposure.exposures(units, panel, ["p"], (2000, 2017), "u", "g", "b", "t").where("window = 'post_12'").collect()
    got = {r.u: (r.status, r.exposure) for r in rows}
    assert {u: s for u, (s, _) in got.items()} == {1: "window_outside_years", 2: "postnatal_incomplete", 3: "spatial_missing_year", 4: "unmatched_cluster", 5: "dates_missing", 6: "birth_after_interview"}
    assert got[3][1] is None and got[5][1] is None


def test_empty_tables(spark):
    w = spatial.overlap_weights(point(spark, 1000).limit(0), GRID, "x", "y", "r", "k")
    assert spatial.extract(w, constant(spark, 1.0), [("a",)], ["layer"], "k").count() == 0


def test_weights_are_not_broadcast(spark, sf_dir):
    """Each cluster has many weights, though Spark takes them for as small as the clusters' file."""
    from fieldloom.plans import QUERIES

    for name in ("q16_ordered_bounds", "g34_extraction_validation", "g46_spatial_spot_checks", "g35_exposure_windows"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        for i, line in enumerate(plan):
            if "BroadcastExchange" in line:
                below = plan[i + 1 : next((j for j in range(i + 1, len(plan)) if depth(plan[j]) <= depth(line)), len(plan))]
                assert not any("c_custkey" in x for x in below), name


def test_large_grid_gives_the_same(spark, monkeypatch):
    pixels = constant(spark, 7.0).where("(row + col) % 3 <> 0").withColumn("value", F.col("row") + F.col("col") / 10.0)
    pixels = pixels.unionByName(pixels.where("col < 50").withColumn("layer", F.lit("b")))
    sites = spark.createDataFrame([(1, 0.503, 0.497, 3000.0), (2, 0.001, 0.999, 2000.0), (3, 5.0, 0.5, 1000.0), (4, 0.8, 0.2, 500.0)], "k long, x double, y double, r double")
    found = []
    for most in (10**6, 0):
        monkeypatch.setattr(spatial, "MOST_VALUES", most)
        out = spatial.extract(spatial.overlap_weights(sites, GRID, "x", "y", "r", "k"), pixels, [("a",), ("b",)], ["layer"], "k", GRID)
        found.append([(*r[:2], *(round(v, 9) if isinstance(v, float) else v for v in r[2:])) for r in out.orderBy("k", "layer").collect()])
    assert found[0] == found[1] and len(found[0]) == 8 and found[0][7][3] == "missing"


def moved_above(df, mark):
    """The exchanges of a plan whose input holds a mark, each with the operator right below."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found = []
    for i, line in enumerate(plan):
        below = plan[i + 1 : next((j for j in range(i + 1, len(plan)) if depth(plan[j]) <= depth(line)), len(plan))]
        if "Exchange" in line and any(mark in x for x in below):
            found.append((line, below[0]))
    return found


def test_windows_do_not_move(spark, sf_dir):
    """units move to their cluster before they fan out to windows; above them only partial counts do."""
    from fieldloom.plans import QUERIES

    assert moved_above(QUERIES["g35_exposure_windows"](spark, sf_dir), "post_24") == []
    for name in ("g36_window_validation", "g37_analysis_samples"):
        moved = moved_above(QUERIES[name](spark, sf_dir), "post_24")
        assert len(moved) == 1 and "partial_count" in moved[0][1] and "o_orderkey" not in moved[0][0], name


@pytest.mark.parametrize("name", ["g37_exclusion_flow", "g37_candidate_patterns"])
def test_candidates_move_as_counts(spark, sf_dir, name):
    """an order's candidates share its windows; above these only counts by status move."""
    from fieldloom.plans import QUERIES

    moved = moved_above(QUERIES[name](spark, sf_dir), "post_24")
    assert moved and all("HashAggregate" in below and ("partial_count" in below or "partial_sum" in below) for _, below in moved)
    assert not any(x in line for line, _ in moved for x in ("o_orderkey", "unit", "key#"))


def test_exposures_equal_months_one_by_one(spark):
    """Gaps, partial years, clusters without a panel or without a number, and windows at the ends, against plain Python."""
    products, years, rng = ["p", "q"], (2000, 2004), np.random.default_rng(11)
    panel = {(g, p, y): (None if rng.random() < 0.15 else float(rng.uniform(0, 100)), str(rng.choice(["full", "full", "full", "partial"])), float(rng.random())) for g in range(4) for p in products for y in range(2000, 2005) if rng.random() < 0.9}
    units = [(u, [0, 1, 2, 3, 9, None][u % 6], None if u % 17 == 0 else index(1999, 6) + u % 66, None if u % 19 == 0 else index(1999, 6) + u % 66 + u % 31 - 1) for u in range(300)]
    table = spark.createDataFrame([(*k, *v) for k, v in panel.items()], "g long, product string, year long, value double, state string, valid_fraction double")
    got = exposure.exposures(spark.createDataFrame(units, "u long, g long, b long, t long"), table, products, years, "u", "g", "b", "t", F.col("u") % 23 == 0, ["b"]).collect()
    assert len(got) == 300 * 2 * 4 and len({(r.u, r.product, r.window) for r in got}) == len(got)
    dates = {u: (g, b, t) for u, g, b, t in units}
    for r in got:
        g, b, t = dates[r.u]
        kind, months = exposure.WINDOWS[r.window]
        start = None if b is None else {"birth": (b - 1) // 12 * 12 + 1, "pre": b - 9, "post": b}[kind]
        touched = [] if b is None else [1900 + (m - 1) // 12 for m in range(start, start + months)]
        held = {y: panel.get((g, r.product, y), (None, None, 0.0)) for y in touched}
        value = sum(held[y][0] for y in touched) / months if touched and all(v is not None for v, _, _ in held.values()) else None
        status = (
            "unmatched_cluster" if g is None else "not_applicable" if r.u % 23 == 0 else "dates_missing" if b is None or t is None else "birth_after_interview" if b > t else "window_outside_years" if min(touched) < 2000 or max(touched) > 2004
            else "postnatal_incomplete" if kind == "post" and t < b + months else "spatial_missing_year" if value is None else "spatial_partial_year" if any(s != "full" for _, s, _ in held.values()) else "eligible_complete"
        )
        assert (r.status, r.b) == (status, b) and (r.exposure is None) == (value is None) and (value is None or abs(r.exposure - value) < 1e-9)
        assert r.n_years == (len(held) if held else None) and r.interview_year_used == (None if b is None else t is not None and 1900 + (t - 1) // 12 in held)
        assert r.min_valid_fraction == (min(f for _, _, f in held.values()) if held else None)
    assert len({r.status for r in got}) == 9


def test_arrays_equal_rows(spark):
    """The arrays of a cluster hold what extract gives in rows, for both kinds of grids."""
    pixels = constant(spark, 7.0).where("(row + col) % 3 <> 0 and col < 60").withColumn("value", F.col("row") + F.col("col") / 10.0)
    pixels = pixels.unionByName(pixels.where("col < 50").withColumn("layer", F.lit("b"))).unionByName(constant(spark, 1.0).withColumn("layer", F.lit("c")))
    sites = spark.createDataFrame([(1, 0.503, 0.497, 3000.0), (2, 0.001, 0.999, 2000.0), (3, 5.0, 0.5, 1000.0), (4, 0.8, 0.2, 500.0)], "k long, x double, y double, r double")
    weights, listed = spatial.overlap_weights(sites, GRID, "x", "y", "r", "k"), [("a",), ("b",), ("c",)]
    rows = {(r.k, r.layer): (r.value, r.status == "full", r.valid_fraction) for r in spatial.extract(weights, pixels, listed, ["layer"], "k", GRID).collect()}
    for grid in (GRID, None):
        arrays = spatial.extract_arrays(weights, pixels, listed, ["layer"], "k", grid).collect()
        got = {(r.k, x): v for r in arrays for x, v in zip("abc", zip(r["values"], r.full, r.valid_fractions, strict=True), strict=True)}
        assert got.keys() == rows.keys() and len(got) == 12 and any(f for _, f, _ in got.values())
        assert all(a[1] == b[1] and abs(a[2] - b[2]) < 1e-12 and (a[0] is None) == (b[0] is None) and (a[0] is None or abs(a[0] - b[0]) < 1e-9) for a, b in ((got[k], rows[k]) for k in rows))
