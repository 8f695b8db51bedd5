"""Survey operators: synthetic cases with known answers, and registered queries against their SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import calendar, smallmath
from fieldloom.operators import contracts, joins, recode, regress, weights
from fieldloom.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def test_special_codes_states(spark):
    df = spark.createDataFrame([(None,), (9996,), (9997,), (9998,), (9999,), (123,)], "raw int")
    state, flag, z = recode.special_codes(F.col("raw"), {9996: "height", 9997: "age", 9998: "flagged", 9999: "not_measured"})
    rows = df.select(state.alias("s"), flag.alias("f"), z.alias("z")).collect()
    assert [r.s for r in rows] == ["missing", "height", "age", "flagged", "not_measured", "valid"]
    assert [r.z for r in rows] == [None] * 5 + [1.23] and [r.f for r in rows] == [None, 9996, 9997, 9998, 9999, None]


def test_threshold_and_service_level(spark):
    df = spark.createDataFrame([(-2.01,), (-2.0,), (None,)], "z double")
    assert [r[0] for r in df.select(recode.below(F.col("z"), -2)).collect()] == [1, 0, None]
    df = spark.createDataFrame([("Improved", 0), ("Improved", 1), ("Improved", 7), ("Improved", None), ("Open", 1)], "c string, s int")
    assert [r[0] for r in df.select(recode.service_level(F.col("c"), F.col("s"))).collect()] == ["Basic", "Limited", "StructuralNotApplicable", None, "Open"]


def test_leave_one_out_keeps_excluded_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, 0.0), (2, 1.0)], "c int, v double")
    rows = {(r.c, r.v): (r.others_n, r.others_rate) for r in joins.leave_one_out(df, "c", F.col("v")).collect()}
    assert rows == {(1, 1.0): (1, 0.0), (1, None): (2, 0.5), (1, 0.0): (1, 1.0), (2, 1.0): (0, None)}


def test_other_calendar_anchors(spark):
    df = spark.createDataFrame([(2008,), (2009,), (1900,)], "y int")
    got = [str(r[0]) for r in df.select(calendar.other_to_gregorian(F.col("y"), F.lit(1), F.lit(1))).collect()]
    assert got == ["2015-09-12", "2016-09-11", "1907-09-12"]


@pytest.mark.parametrize(("start", "months", "want"), [(2010 * 12 + 5, 1, 2010.0), (2010 * 12 + 6, 12, 2010.5), (2009 * 12 + 4, 9, 2009.1111)])
def test_window_weights(spark, start, months, want):
    df = spark.createDataFrame([(1, start)], "k int, s long")
    got = joins.spread_years(df, F.col("s"), F.lit(months), ["k"]).agg(F.sum(F.col("weight") * F.col("year")), F.sum("weight")).first()
    assert abs(got[1] - 1) < 1e-12 and abs(got[0] - want) < 1


def fixture(spark, absorbed=False, duplicate=False, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(40):
        base = rng.normal()
        for _ in range(6):
            x = base if absorbed else rng.normal()
            z = rng.normal()
            rows.append((g, g % 4, float(x), float(z), float(2 * z if duplicate else rng.normal()), float(0.05 * x + 0.3 * z + base + rng.normal() / 50), float(rng.uniform(0.5, 2))))
    return spark.createDataFrame(rows, "g int, r int, x double, z double, d double, y double, w double")


def test_absorbed_equals_explicit_dummies(spark):
    df = fixture(spark)
    a = regress.fit_absorbed(df, "y", ["x"], ["z"], "w", "g")
    rows, fe = regress.region_dummies(df, "g")
    b = regress.fit_explicit(rows, "y", ["x", "z", *fe], "w", "g")
    assert a.status == b.status == "estimated" and abs(a.beta[0] - 0.05) < 0.02
    assert np.allclose(a.beta, b.beta[1:3], atol=1e-6) and a.k == 2 and b.k == 42
    ratio = np.sqrt(a.cov[0, 0] / b.cov[1, 1])
    assert abs(ratio - np.sqrt((a.n - 42) / (a.n - 2))) < 1e-6


def test_refused_fits(spark):
    assert regress.fit_absorbed(fixture(spark, absorbed=True), "y", ["x"], ["z"], "w", "g").status == "non_estimable_exposure_absorbed"
    refused = regress.fit_absorbed(fixture(spark, duplicate=True), "y", ["x"], ["z", "d"], "w", "g")
    assert refused.status == "non_estimable_rank_deficient" and refused.rows() == []


def test_partial_beta_and_inflation(spark):
    df = weights.demean(fixture(spark), "g", ["x", "z", "d", "y"], F.col("w"))
    g, _ = regress.gram(df, ["x", "z", "d", "y"], "w")
    beta = np.linalg.solve(g[:3, :3], g[:3, 3])
    assert np.allclose([regress.partial_beta(g, i, 3) for i in range(3)], beta)
    assert (regress.inflation(g[:3, :3]) >= 1).all()


def test_distribution_functions():
    assert abs(smallmath.t_quantile(0.95, 10) - 2.2281388520) < 1e-8
    assert abs(smallmath.normal_quantile(0.95) - 1.9599639845) < 1e-8
    assert abs(smallmath.chi2_p(3.841458820694124, 1) - 0.05) < 1e-10 and abs(smallmath.chi2_p(30, 10) - 0.000857) < 1e-6


def test_contracts_find_faults(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k int, v string")
    assert {tuple(r) for r in contracts.unique_key(df, ["k"]).collect()} == {(1, 2), (None, 1)}
    assert [r.k for r in contracts.depends(df, "k", "v").collect()] == [1]
    assert contracts.schema_report(df, [("k", "int"), ("w", "string")]) == [("w", "missing"), ("v", "surplus")]


@pytest.mark.parametrize("name", ["w1_leave_one_out", "p1_special_codes", "a5_weighted_shares", "a26_exclusion_cascade", "e1_design_mean", "e7_absorbed_fe", "j9_interval_lookup", "j4_outer_sides", "f6_candidate_dates", "f17_possible_month", "q13_result_integrity", "s9_csv_round_trip", "e13_residual_variation", "g33_spatial_extraction", "g37_analysis_samples", "g1_measurement_flags", "g3_weights_and_design", "g6_descriptives", "g31_calendar_audit", "g41_dataset_checks", "s7_layout_reconciliation", "s8_layout_gaps"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    a, b = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    for c in a.columns:
        x, y = (sorted(map(str, d[c].astype(object).where(d[c].notna(), None).map(lambda v: round(float(v), 6) if isinstance(v, (int, float)) else v))) for d in (a, b))
        assert x == y, c


def test_all_queries_are_registered():
    assert len(QUERIES) > 120 and set(ORACLES) <= set(QUERIES)
