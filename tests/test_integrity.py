"""Every check of a set of results passes on sound ones and fails on the damage that it is for."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import integrity as I

SCHEMA = "scope string, model string, term string, status string, beta double, se double, low double, high double, p double, n long"
ROWS = [("ALL", "m", x, "estimated", 1.0 + i, 0.1, 0.8, 1.2, 0.01, 50) for i, x in enumerate("xyz")] + [("1", "m", "x", "refused", None, None, None, None, None, 3)]


def test_checks(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    flow = spark.createDataFrame([("ALL", "m", 50), ("1", "m", 3)], "scope string, model string, left long")
    key = ["scope", "model"]
    cases = [
        (lambda d: I.shape("t", d, 4, 10), df.limit(3)), (lambda d: I.shape("t", d, 4, 10), df.drop("p")), (lambda d: I.no_duplicates("t", d), df.unionByName(df.limit(1))), (lambda d: I.no_missing("t", d), df.withColumn("se", F.lit(float("nan")))),
        (lambda d: I.no_missing("t", d), df.withColumn("p", F.lit(None).cast("double"))), (lambda d: I.same_sizes("t", d, flow, key), df.withColumn("n", F.col("n") + 1)), (lambda d: I.same_sizes("t", d, flow, key), df.withColumn("model", F.lit("other"))),
        (lambda d: I.equal_estimates("t", df.where("beta is not null"), d, ["scope", "term"]), df.withColumn("beta", F.col("beta") + 1e-6)), (lambda d: I.equal_estimates("t", df.where("beta is not null"), d, ["scope", "term"]), df.where("term <> 'z'")),
        (lambda d: I.one_value("t", d, "model"), df.withColumn("model", F.col("term"))), (lambda d: I.one_value("t", d, "model"), df.drop("model")), (lambda d: I.only_scopes("t", d, ["ALL", "1"]), df.withColumn("scope", F.lit("2"))),
    ]
    sound, damaged = (I.audit([f(d) for f, d in made]).collect() for made in ([(f, df) for f, _ in cases], cases))
    assert [(r.check, r.detail) for r in sound if not r.passed] == [] and [(r.check, r.detail) for r in damaged if r.passed] == []
    assert [r.passed for r in sound] == [True] * len(cases) and [r.passed for r in damaged] == [False] * len(cases)
    I.refuse(I.audit([cases[0][0](df)]))
    with pytest.raises(ValueError, match="shape:t: expected 4 x 10, found 3 x 10"):
        I.refuse(I.audit([cases[0][0](df.limit(3))]))
