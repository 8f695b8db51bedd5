"""Joins with their contracts, set operations, and order-dependent selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: duplicate keys on either side, matched and unmatched left rows. A one-to-one join needs all but matched at zero."""
    counts = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{side}")) for df, side in ((left, "left"), (right, "right"))]
    both = counts[0].join(counts[1], keys, "full_outer")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(
        F.count_if(F.col("n_left") > 1).alias("dup_left"), F.count_if(F.col("n_right") > 1).alias("dup_right"),
        n(F.when(F.col("n_right").isNotNull(), F.col("n_left"))).alias("matched"), n(F.when(F.col("n_right").isNull(), F.col("n_left"))).alias("unmatched"),
    )


def outer_sides(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join with side (both, only_left, only_right) and the values of each side."""
    a = left.select(*keys, F.struct(*values).alias("a"))
    b = right.select(*keys, F.struct(*values).alias("b"))
    side = F.when(F.col("a").isNull(), "only_right").when(F.col("b").isNull(), "only_left").otherwise("both")
    return a.join(b, keys, "full_outer").select(*keys, side.alias("side"), *[F.col(f"{s}.{v}").alias(f"{v}_{s}") for v in values for s in "ab"])


def leave_one_out(df: DataFrame, cluster: str, value: Column) -> DataFrame:
    """Adds others_n and others_rate: the mean of the cluster's other rows with a value; NULL if there is none.

    A row without a value still gets the others' mean. Sums per cluster are made first, map-side, and joined back, so a
    cluster's rows are never sorted in one task.
    """
    rows = df.withColumn("_v", value.cast("double"))
    sums = rows.groupBy(cluster).agg(F.sum("_v").alias("_sum"), F.count("_v").alias("_n"))
    n, rate = others(F.col("_v"), F.col("_sum"), F.col("_n"))
    return rows.join(sums, cluster, "left").withColumns({"others_n": n, "others_rate": rate}).drop("_v", "_sum", "_n")


def others(value: Column, total: Column, n: Column) -> tuple[Column, Column]:
    """The number and the mean of a cluster's other values, from its sum and number of values."""
    rest = n - value.isNotNull().cast("int")
    return rest, F.try_divide((F.coalesce(total, F.lit(0)) - F.coalesce(value, F.lit(0))).cast("double"), rest)


def spread_years(df: DataFrame, start: Column, months: Column, key: list[str]) -> DataFrame:
    """Fans a window of months (start as months since year 0) out to its calendar years: year, weight (its share of the months)."""
    end = start + months - 1
    rows = df.select(*key, start.alias("_s"), end.alias("_e"), F.explode(F.sequence(F.floor(start / 12), F.floor(end / 12))).alias("year"))
    inside = F.least(F.col("_e"), F.col("year") * 12 + 11) - F.greatest(F.col("_s"), F.col("year") * 12) + 1
    return rows.select(*key, "year", (inside / (F.col("_e") - F.col("_s") + 1)).alias("weight"))


def top_by(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts each task's rows to k a group before they move."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def sample_rows(df: DataFrame, n: int, order: Column, *ties: str) -> DataFrame:
    """A seeded, repeatable sample of n rows: the first n by a hash of the key."""
    return df.orderBy(order, *ties).limit(n)


def union_same(frames: list[DataFrame]) -> DataFrame:
    """Row concatenation; schemas must be the same, in order."""
    kinds = [[(f.name, f.dataType) for f in df.schema.fields] for df in frames]
    if any(k != kinds[0] for k in kinds):
        raise ValueError("schemas differ")
    return reduce(DataFrame.unionByName, frames)


def union_panels(panels: dict[str, DataFrame]) -> DataFrame:
    """Column-union concatenation with the panel's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("panel", F.lit(name)) for name, df in panels.items()])


def column_sets(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    left, right = set(a.columns), set(b.columns)
    return {"only_left": sorted(left - right), "only_right": sorted(right - left), "both": sorted(left & right)}
