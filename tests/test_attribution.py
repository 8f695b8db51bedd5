"""Exclusion flows and candidate patterns on small tables."""

from pyspark.sql import functions as F

from fieldloom.operators import aggregates
from fieldloom.operators import attribution as A


def test_flow_counts_each_record_once(spark):
    df = spark.createDataFrame([("s", 1, 1), ("s", None, 5), ("s", 3, 9), ("r", 9, 1), ("r", 9, 9)], "g string, x int, y int")
    rules = {"small_x": F.col("x") < 2, "large_y": F.col("y") > 8}
    outcomes = {"a": {"odd_x": F.col("x") % 2 == 1}, "b": {}}
    flow = A.exclusion_flow(df, ["g"], rules, outcomes, 1)
    assert {tuple(r) for r in flow.collect()} == {
        ("s", "a", "small_x", 1), ("s", "a", "included", 1), ("s", "a", "odd_x", 1), ("r", "a", "odd_x", 2), ("s", "b", "small_x", 1), ("s", "b", "included", 1), ("s", "b", "large_y", 1), ("r", "b", "included", 1), ("r", "b", "large_y", 1),
    }
    assert all(r.equal for r in A.reconciles(flow, df.groupBy("g").agg(F.count(F.lit(1)).alias("records")), ["g"]).collect())
    assert not any(r.equal for r in A.reconciles(flow.where("category <> 'included'"), df.groupBy("g").agg(F.lit(3).cast("long").alias("records")), ["g"]).where("g = 's'").collect())
    assert {tuple(r) for r in A.exclusion_flow(df, ["g"], rules).collect()} == {("s", "small_x", 1), ("s", "included", 1), ("s", "large_y", 1), ("r", "included", 1), ("r", "large_y", 1)}


def test_flow_of_counted_records(spark):
    """rows that stand for several records give the same flow."""
    df = spark.createDataFrame([("s", 1, 1), ("s", None, 5), ("s", 1, 1), ("s", 3, 9), ("r", 9, 1), ("r", 9, 9), ("r", 9, 9)], "g string, x int, y int")
    rules, outcomes = {"small_x": F.col("x") < 2, "large_y": F.col("y") > 8}, {"a": {"odd_x": F.col("x") % 2 == 1}, "b": {}}
    counts = df.groupBy("g", "x", "y").agg(F.count(F.lit(1)).alias("records"))
    for more in ((outcomes, 1), ()):
        want, got = A.exclusion_flow(df, ["g"], rules, *more), A.exclusion_flow(counts, ["g"], rules, *(more or (None, 0)), "records")
        assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect())) and want.columns == got.columns


def test_patterns(spark):
    rows = [(1, "c1", "ok"), (1, "c2", "ok"), (2, "c1", "late"), (2, "c2", "ok"), (3, "c1", "ok"), (3, "c2", "dates"), (4, "c1", "late"), (5, "c1", "strange"), (5, "c2", "ok"), (6, "c1", "late"), (6, "c2", "ok"), (6, "c2", "dates")]
    got = A.candidate_patterns(spark.createDataFrame(rows, "u int, c string, s string"), ["u"], "c", "s", ["c1", "c2"], ["dates", "late", "ok"])
    assert {tuple(r) for r in got.collect()} == {("late", "ok", "late", 1), ("ok", "dates", "dates", 1), ("late", "absent", "late", 1), ("other", "ok", "ok", 1), ("late", "dates", "dates", 1)}


def test_patterns_of_statuses_in_one_row(spark):
    """statuses in columns, and rows that stand for several units, give the patterns of candidates in rows."""
    order = ["dates", "late", "ok"]
    rows = [("x", u, a, b) for u, (a, b) in enumerate([("ok", "ok"), ("late", "ok"), ("ok", "dates"), ("late", None), ("strange", "ok"), ("late", "ok"), (None, None)])] + [("y", 9, "late", "ok")]
    wide = spark.createDataFrame(rows, "g string, u int, c1 string, c2 string")
    long = wide.unpivot(["g", "u"], ["c1", "c2"], "c", "s").where("s is not null")
    want = {tuple(r) for r in A.candidate_patterns(long, ["u"], "c", "s", ["c1", "c2"], order, ["g"]).collect()}
    counts = wide.groupBy("g", "c1", "c2").agg(F.count(F.lit(1)).alias("units"))
    assert ("x", "late", "ok", "late", 2) in want and ("x", "late", "absent", "late", 1) in want and len(want) == 5
    assert {tuple(r) for r in A.status_patterns(wide, ["c1", "c2"], order, ["g"]).collect()} == want == {tuple(r) for r in A.status_patterns(counts, ["c1", "c2"], order, ["g"], "units").collect()}


def test_shift_sensitivity_equals_rows_one_by_one(spark):
    """Statuses under shifts, ties at both bounds and nulls, against plain Python."""
    rows = [(g, b, t) for g in ("x", "y", None) for b in (None, 0, 3, 4, 9, 10) for t in (None, 4, 5, 6, 11)] * 2
    table = spark.createDataFrame(rows, "g string, b int, t int")
    windows, shifts = {"early": (-3, -1), "late": (1, 2)}, {"b_up": {"b": 1}, "t_down": {"t": -1}, "t_up": {"t": 1}, "both": {"b": 1, "t": 1}}
    status = lambda w, b, t: F.when(b + w[0] < 0, "before").when(b + w[1] >= t, "open").when(b.isNotNull() & t.isNotNull(), "eligible")
    plain = lambda w, b, t: b is not None and t is not None and b + w[0] >= 0 and b + w[1] < t
    got = {(r.g, r.window, r["shift"]): (r.eligible_base, r.eligible_shifted, r.gained, r.lost) for r in aggregates.shift_sensitivity(table, status, {"b": F.col("b"), "t": F.col("t")}, windows, shifts, ["g"]).collect()}
    assert len(got) == 3 * 2 * 4
    for (g, w, s), numbers in got.items():
        pairs = [(plain(windows[w], b, t), plain(windows[w], None if b is None else b + shifts[s].get("b", 0), None if t is None else t + shifts[s].get("t", 0))) for k, b, t in rows if k == g]
        assert numbers == (sum(a for a, _ in pairs), sum(b for _, b in pairs), sum(b and not a for a, b in pairs), sum(a and not b for a, b in pairs))
    assert aggregates.shift_sensitivity(table.limit(0), status, {"b": F.col("b"), "t": F.col("t")}, windows, shifts, ["g"]).count() == 0
