"""Quantiles by distributed selection against sorted lists."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import quantiles as N

QS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def values():
    rng = np.random.default_rng(9)
    return {"even": rng.normal(size=400), "ties": rng.integers(0, 3, 300).astype(float), "one": np.array([7.5]), "two": np.array([-1.0, 3.0]), "tail": rng.standard_cauchy(300) ** 9, "same": np.full(50, 2.0), "far": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, 1.0]), None: rng.normal(size=60) * 1e-9 + 1e6}


@pytest.mark.parametrize("parts,small", [(256, 10_000), (2, 0), (7, 20)])
def test_equals_sorted_values(spark, monkeypatch, parts, small):
    monkeypatch.setattr(N, "PARTS", parts)
    monkeypatch.setattr(N, "SMALL", small)
    groups = values() if parts > 2 else {k: v for k, v in values().items() if k not in ("tail", "far")}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("even", None), ("even", float("nan")), ("nothing", None)]
    got = {r.g: r for r in N.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", QS, "g").collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g].n == len(xs)
        s = sorted(xs)
        for q, v in zip(QS, got[g].q, strict=True):
            h = (len(s) - 1) * q
            low, high = s[math.floor(h)], s[min(math.floor(h) + 1, len(s) - 1)]
            assert v == low + (high - low) * (h - math.floor(h))


def test_one_group_and_none(spark):
    df = spark.range(101).select(F.col("id").cast("int").alias("v"))
    assert N.quantiles(df, "v", [0.5, 0.25]).collect() == [("ALL", 101, [50.0, 25.0])]
    assert N.quantiles(df.limit(0), "v", [0.5]).count() == 0
    ends = N.quantiles(spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,)], "v double"), "v", [0.0, 0.5, 1.0]).first().q
    assert ends == [-N.LARGEST, 1.0, N.LARGEST]
