"""Final tables from hand-made results."""

from pyspark.sql import functions as F

from fieldloom.operators import final_tables as T

SCHEMA = "scope string, model string, term string, beta double, se double, low double, high double, n long, clusters long"
RESULTS = [
    ("ALL", "1", "x", 0.12345, 0.01, 0.1, 0.14, 90, 7), ("ALL", "1", "intercept", 1.0, 0.1, 0.8, 1.2, 90, 7), ("ALL", "2", "x", -0.5, 0.25, -1.0, 0.0, 80, 6), ("ALL", "2", "age", 2.0, 0.5, 1.0, 3.0, 80, 6), ("ALL", "2", "region_1", 2.0, 0.5, 1.0, 3.0, 80, 6),
    ("ALL", "3", None, None, None, None, None, 5, 1),
]


def cells(df):
    return {(r.panel, r.row, r.column): r.cell for r in df.collect()}


def test_models_panel(spark):
    df = spark.createDataFrame(RESULTS, SCHEMA)
    got = cells(T.models_panel(df, "P", "model", {"x": "Exposure", "age": "Age"}, {"Controls": ["age"], "Region effects": ["region_1", "region_2"]}))
    want = {
        "Exposure": ("0.123 (0.010)", "-0.500 (0.250)", ""), "Age": ("", "2.000 (0.500)", ""), "Controls": ("No", "Yes", "No"), "Region effects": ("No", "Yes", "No"), "N": ("90", "80", "5"), "Clusters": ("7", "6", "1"),
    }
    assert got == {("P", row, str(i + 1)): v for row, values in want.items() for i, v in enumerate(values)}
    wide = T.wide(T.models_panel(df, "P", "model", {"x": "Exposure"}, style="ci", digits=2, sizes=False).unionByName(T.notes(df, "P", "a note")), ["1", "2", "3", "4"])
    assert [tuple(r) for r in wide.collect()] == [("P", 0, "Exposure", "0.12 [0.10, 0.14]", "-0.50 [-1.00, 0.00]", "", ""), ("P", 1_000_000, "a note", "", "", "", "")]


def test_records_and_characteristics(spark):
    df = spark.createDataFrame([("a", None, 1, 2.0, 10.0), ("a", "u", 1, 1.0, None), ("b", "u", 1, 1.0, 4.0), (None, "r", 1, 4.0, 1.0)], "g string, kind string, k int, w double, x double")
    got = cells(T.records_panel(df.select("g", "kind", "w", "x"), "R", ["g", "kind"], {"x": 1}))
    assert got["R", "a | u", "x"] == "" and got["R", "a | ", "x"] == "10.0" and got["R", " | r", "w"] == "4.0" and len(got) == 8
    got = cells(T.characteristics(df, "C", "g", ["kind"], {"x": 1}, "w"))
    assert got["C", "kind: (missing)", "ALL"] == "25.0% (n=1)" and got["C", "kind: u", "a"] == "33.3% (n=1)" and got["C", "kind: u", "b"] == "100.0% (n=1)"
    assert got["C", "x", "ALL"] == "4.0 (3.9)" and got["C", "x", "b"] == "4.0 (0.0)" and ("C", "x", "None") not in got
    assert T.characteristics(df.limit(0), "C", "g", ["kind"], {"x": 1}, "w").count() == 0


def test_empty_results(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert T.models_panel(df, "P", "model", {"x": "Exposure"}).count() == 0 and T.notes(df, "P", "n").count() == 1 and df.select(F.lit(1)).count() == 0
