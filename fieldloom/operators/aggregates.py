"""Aggregates of survey tables: weighted shares and means, grouping sets, cascades, correlations."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_shares(df: DataFrame, category: str, weight: Column, by: list[str] = ()) -> DataFrame:
    """n and 100 * sum of weights over the group's total, per category. Totals come from the small per-category table."""
    parts = df.groupBy(*by, category).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    total = parts.groupBy(*by).agg(F.sum("w").alias("total"))
    joined = parts.join(total, list(by)) if by else parts.crossJoin(F.broadcast(total))  # the total is one row
    return joined.select(*by, category, "n", (100 * F.col("w") / F.col("total")).alias("share"))


def weighted_mean(x: Column, w: Column) -> Column:
    """The mean over rows where x is known."""
    return F.sum(F.when(x.isNotNull(), w * x)) / F.sum(F.when(x.isNotNull(), w))


def weighted_sd(x: Column, w: Column) -> Column:
    """The descriptive (population) standard deviation, from sums about zero."""
    m = weighted_mean(x, w)
    return F.sqrt(F.greatest(weighted_mean(x * x, w) - m * m, F.lit(0.0)))


def with_pooled(df: DataFrame, group: str, aggregates: list[Column], label: str = "ALL") -> DataFrame:
    """Every aggregate for each group and, as group `label`, for all rows together."""
    out = df.groupingSets([[F.col(group)], []], F.col(group)).agg(F.grouping(group).alias("_g"), *aggregates)
    return out.withColumn(group, F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col(group).cast("string"))).drop("_g")


def cascade(df: DataFrame, steps: list[tuple[str, Column]], by: list[str] = ()) -> DataFrame:
    """Rows left after each step in turn and rows that the step excludes, in one aggregate."""
    kept, counts = F.lit(True), [F.count(F.lit(1)).alias("start")]
    for name, condition in steps:
        kept = kept & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(kept).alias(name))
    out = df.groupBy(*by).agg(*counts)
    names = ["start", *[n for n, _ in steps]]
    pairs = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(n).alias("left"), (F.col(names[max(i - 1, 0)]) - F.col(n)).alias("excluded")) for i, n in enumerate(names)])
    return out.select(*by, F.inline(pairs))


def shift_sensitivity(df: DataFrame, status: Callable[..., Column], inputs: dict[str, Column], windows: dict[str, object], shifts: dict[str, dict[str, int]], by: list[str] = ()) -> DataFrame:
    """How eligibility changes if inputs are shifted: per group, window and shift eligible_base, eligible_shifted, gained and lost.

    status(window, **inputs) gives a status, of which "eligible" counts; a null one is not eligible. shifts say what is added
    to which input. All windows and shifts are counted in one aggregate.
    """
    counts, rows = [], []
    for w, (name, window) in enumerate(windows.items()):
        held = lambda moved: F.coalesce(status(window, **{k: x + moved.get(k, 0) for k, x in inputs.items()}) == "eligible", F.lit(False))  # noqa: B023, E731
        base = held({})
        counts.append(F.count_if(base).alias(f"base{w}"))
        for i, (shift, moved) in enumerate(shifts.items()):
            other = held(moved)
            counts += [F.count_if(other).alias(f"shifted{w}_{i}"), F.count_if(other & ~base).alias(f"gained{w}_{i}"), F.count_if(base & ~other).alias(f"lost{w}_{i}")]
            numbers = [F.col(f"base{w}").alias("eligible_base"), F.col(f"shifted{w}_{i}").alias("eligible_shifted"), F.col(f"gained{w}_{i}").alias("gained"), F.col(f"lost{w}_{i}").alias("lost")]
            rows.append(F.struct(F.lit(name).alias("window"), F.lit(shift).alias("shift"), *numbers))
    return df.groupBy(*by).agg(*counts).select(*by, F.inline(F.array(*rows)))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for every pair, in one pass."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def value_counts_json(df: DataFrame, group: str, column: str) -> DataFrame:
    """Per group a map of value to count as JSON, keys in order."""
    counts = df.groupBy(group, F.col(column).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).alias("counts"))


def by_each(df: DataFrame, columns: list[str], aggregates: list[Column]) -> DataFrame:
    """The aggregates by every column in turn, long: variable, level. One scan: rows fan out to their levels, combined before they move."""
    levels = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in columns])
    return df.withColumn("_l", F.explode(levels)).groupBy(F.col("_l.variable").alias("variable"), F.col("_l.level").alias("level")).agg(*aggregates)
