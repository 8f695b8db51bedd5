"""Integrity of a set of result tables before they are published: named checks with what they found, none of which stops the others.

Result tables of models have a row a term: scope, model, term, status, beta, se, low, high, p, n. Checks read the small tables
and return counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = ["beta", "se", "low", "high", "p"]
KEY = ["scope", "model", "term"]


def check(name: str, found: DataFrame, passed: Column, detail: Column) -> DataFrame:
    """found: one row."""
    return found.select(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("string").alias("detail"))


def shape(name: str, df: DataFrame, rows: int, columns: int) -> DataFrame:
    found = df.agg(F.count(F.lit(1)).alias("n"))
    return check(f"shape:{name}", found, (F.col("n") == rows) & F.lit(len(df.columns) == columns), F.format_string(f"expected {rows} x {columns}, found %d x {len(df.columns)}", "n"))


def no_duplicates(name: str, df: DataFrame, key: list[str] = KEY) -> DataFrame:
    found = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    return check(f"no_duplicates:{name}", found, F.col("n") == 0, F.col("n"))


def no_missing(name: str, df: DataFrame, columns: list[str] = NUMBERS) -> DataFrame:
    """Missing or NaN numbers of estimated models."""
    bad = [F.count_if(F.col(x).isNull() | F.isnan(F.col(x).cast("double"))) for x in columns]
    found = df.where("status = 'estimated'").agg(reduce(lambda a, b: a + b, bad).alias("n"))
    return check(f"no_missing:{name}", found, F.col("n") == 0, F.col("n"))


def same_sizes(name: str, df: DataFrame, flow: DataFrame, key: list[str]) -> DataFrame:
    """Every model's n is the flow's (key, left); a model without exactly one flow row is a mismatch."""
    sizes = df.select(*key, "n").distinct()
    flows = flow.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.max("left").alias("left"))
    found = sizes.join(flows, key, "left").agg(F.count_if(~((F.col("rows") == 1) & F.col("n").eqNullSafe(F.col("left"))) | F.col("rows").isNull()).alias("n"))
    return check(f"sample_sizes:{name}", found, F.col("n") == 0, F.col("n"))


def equal_estimates(name: str, a: DataFrame, b: DataFrame, key: list[str], tolerance: float = 1e-8) -> DataFrame:
    """Every row of a has one in b, with the same coefficient."""
    sides = a.select(*key, "beta").join(b.select(*key, F.col("beta").alias("beta_b"), F.lit(1).alias("there")), key, "left")
    found = sides.agg(F.count(F.lit(1)).alias("n"), F.count("there").alias("matched"), F.max(F.abs(F.col("beta") - F.col("beta_b"))).alias("gap"))
    return check(f"equal_estimates:{name}", found, (F.col("n") == F.col("matched")) & (F.col("gap") < tolerance), F.format_string("matched %d/%d, gap %.2e", "matched", "n", "gap"))


def one_value(name: str, df: DataFrame, column: str) -> DataFrame:
    """A column of metadata is there and has one value."""
    if column not in df.columns:
        return check(f"metadata:{name}", df.agg(F.count(F.lit(1)).alias("n")), F.lit(False), F.lit("no such column"))
    found = df.agg(F.countDistinct(column).alias("n"), F.count_if(F.col(column).isNull()).alias("missing"), F.min(column).alias("value"))
    return check(f"metadata:{name}", found, (F.col("n") == 1) & (F.col("missing") == 0), F.col("value"))


def only_scopes(name: str, df: DataFrame, allowed: list[str]) -> DataFrame:
    found = df.agg(F.array_sort(F.collect_set("scope")).alias("scopes"))  # scopes are few
    return check(f"scopes:{name}", found, F.size(F.array_except("scopes", F.array(*map(F.lit, allowed)))) == 0, F.array_join("scopes", ","))


def audit(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def refuse(report: DataFrame) -> None:
    """Raises if a check failed, naming all that did."""
    failed = report.where("not passed").select("check", "detail").collect()
    if failed:
        raise ValueError("; ".join(f"{r['check']}: {r['detail']}" for r in failed))
