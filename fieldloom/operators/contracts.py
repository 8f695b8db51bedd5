"""Data-quality contracts: each gives rows (contract, detail, violations); zero violations pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule(df: DataFrame, name: str, violation: Column, detail: str = "") -> DataFrame:
    """Rows for which a violation holds (a NULL condition is none)."""
    return df.agg(F.lit(name).alias("contract"), F.lit(detail).alias("detail"), F.count_if(violation).alias("violations"))


def rules(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Many rules in one pass."""
    row = df.agg(*[F.count_if(v).alias(k) for k, v in checks.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("contract"), F.col(k).alias("violations")) for k in checks])))


def unique_key(df: DataFrame, key: list[str]) -> DataFrame:
    """Offending keys: NULL in a part, or held by several rows."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | missing)


def same_rows(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose number of rows a step has changed."""
    a, b = (d.groupBy(*key).agg(F.count(F.lit(1)).alias(n)) for d, n in ((before, "n_before"), (after, "n_after")))
    return a.join(b, key, "full_outer").where(~F.col("n_before").eqNullSafe(F.col("n_after")))


def unchanged(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per column the joined rows whose value differs, NULL equal to NULL."""
    b = after.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = before.join(b, F.col(key) == F.col("_k"))
    return rules(joined, {c: ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns})


def depends(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with several values: key must determine value."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def weight_totals(df: DataFrame, group: str, weight: str, target: float, tolerance: float = 1e-9) -> DataFrame:
    """Groups whose weights do not sum to the target."""
    return df.groupBy(group).agg(F.sum(weight).alias("total")).where(F.abs(F.col("total") - target) > tolerance)


def schema_report(df: DataFrame, expected: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(column, problem) for missing, surplus, misplaced or mistyped columns."""
    actual = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    names, wanted = [n for n, _ in actual], dict(expected)
    out = [(n, "missing") for n, _ in expected if n not in names] + [(n, "surplus") for n in names if n not in wanted]
    out += [(n, f"type {k}, not {wanted[n]}") for n, k in actual if n in wanted and k != wanted[n]]
    if not out and names != [n for n, _ in expected]:
        out.append((names[0], "order"))
    return out
